"""Small chats as message frames."""

import datetime as dt

SCHEMA = "room_id string, line bigint, ts timestamp_ntz, sender string, message string"
START = dt.datetime(2026, 3, 1, 9, 0, 0)


def chat(spark, rows, room="r"):
    """rows: (seconds after the start, sender, message)."""
    data = [(room, i, START + dt.timedelta(seconds=s), who, text) for i, (s, who, text) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def day_counts(spark, counts, room="r", gaps=None):
    day, out = dt.date(2026, 3, 1), []
    for i, n in enumerate(counts):
        day = day + dt.timedelta(days=(gaps or {}).get(i, 1) if i else 0)
        out.append((room, day, n))
    return spark.createDataFrame(out, "room_id string, day date, messages bigint")
