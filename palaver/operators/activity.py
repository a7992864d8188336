"""Activity tables. One heavy aggregate feeds them all.

``sender_day`` (counters per room, sender and day) and ``hour_counts`` (counts per
room, day and hour) are the only jobs that read the messages; both combine on the
map side, so a hot room or sender ships one row per task and day. Rankings,
series, histograms and summaries are roll-ups of these two small tables, which
also avoids multi-distinct aggregates over the messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.numeric import half_up, percent
from palaver.functions.text import mask_name
from palaver.operators.ordered import CHUNK_ROWS, ordered_rank
from palaver.operators.topk import top_k

ROOM = ["room_id"]


def sender_day(features: DataFrame) -> DataFrame:
    user = ~F.col("is_system")
    count = lambda cond, name: F.count_if(cond).alias(name)
    return features.groupBy("room_id", "sender", "day").agg(
        F.count("*").alias("all_messages"),
        count(user, "messages"),
        F.sum(F.when(user, F.col("chars")).otherwise(0)).alias("characters"),
        count(user & F.col("has_attachment"), "attachment_messages"),
        count(user & F.col("has_link"), "link_messages"),
        count(user & F.col("is_night"), "night_messages"),
        count(user & F.col("is_weekend"), "weekend_messages"),
        count(user & F.col("has_question"), "question_messages"),
        count(user & F.col("is_laugh"), "laugh_messages"),
        count(user & F.col("is_pure_laugh"), "pure_laugh_messages"),
        count(user & F.col("is_short"), "short_messages"),
        count(user & F.col("has_plan"), "plan_messages"),
        count(user & F.col("has_emoji"), "emoji_messages"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.min_by("ts", "line").alias("first_ts"),
        F.max_by("ts", "line").alias("last_ts"),
    )


def plain_sender_day(messages: DataFrame) -> DataFrame:
    """The counts of ``sender_day`` for sources without notices or text flags."""
    return messages.groupBy("room_id", "sender", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("all_messages"),
        F.count("*").alias("messages"),
        F.sum(F.length("message")).alias("characters"),
        F.count_if(F.hour("ts").isin(23, 0, 1, 2, 3, 4, 5)).alias("night_messages"),
        F.count_if(F.dayofweek("ts").isin(1, 7)).alias("weekend_messages"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.min_by("ts", "line").alias("first_ts"),
        F.max_by("ts", "line").alias("last_ts"),
    )


def hour_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("room_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.count("*").alias("messages")
    )


# ---- series and histograms -----------------------------------------------------

def daily(cells: DataFrame, messages: str = "messages") -> DataFrame:
    return cells.groupBy("room_id", "day").agg(F.sum(messages).alias("messages"))


def monthly(cells: DataFrame) -> DataFrame:
    return cells.groupBy("room_id", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("messages").alias("messages")
    )


def _dense(counts: DataFrame, key: str, last: int) -> DataFrame:
    """Every room gets all values 0..last of ``key`` (a fixed, tiny spine)."""
    rooms = counts.groupBy("room_id").agg(
        F.map_from_entries(F.collect_list(F.struct(key, "messages"))).alias("_m")
    )
    return rooms.select(
        "room_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias(key), "_m"
    ).select("room_id", key, F.coalesce(F.try_element_at("_m", F.col(key)), F.lit(0)).alias("messages"))


def hourly(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy("room_id", "hour").agg(F.sum("messages").alias("messages"))
    return _dense(counts, "hour", 23)


def weekdays(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy("room_id", (F.dayofweek("day") - 1).alias("weekday")).agg(
        F.sum("messages").alias("messages")
    )
    return _dense(counts, "weekday", 6)


def time_profile(cells: DataFrame) -> DataFrame:
    """Day, month, hour and weekday counts in one pass over the hour cells."""
    d = cells.withColumn("month", F.date_format("day", "yyyy-MM")).withColumn("weekday", F.dayofweek("day") - 1)
    keys = ["room_id", "day", "month", "hour", "weekday"]
    grouped = d.groupingSets(
        [["room_id", "day"], ["room_id", "month"], ["room_id", "hour"], ["room_id", "weekday"]], *keys
    ).agg(F.sum("messages").alias("messages"), *[F.grouping(c).alias(f"no_{c}") for c in keys[1:4]])
    grain = (
        F.when(F.col("no_day") == 0, "day").when(F.col("no_month") == 0, "month")
        .when(F.col("no_hour") == 0, "hour").otherwise("weekday")
    )
    bucket = F.coalesce(F.col("day").cast("string"), "month", F.col("hour").cast("string"), F.col("weekday").cast("string"))
    return grouped.select("room_id", grain.alias("grain"), bucket.alias("bucket"), "messages")


def peaks(cells: DataFrame) -> DataFrame:
    """Peak hour, busiest weekday (first maximum) and number of active hours."""
    first_max = lambda c: F.max_by(c, F.struct(F.col("messages"), -F.col(c)))
    hours = hourly(cells).groupBy("room_id").agg(
        first_max("hour").alias("peak_hour"), F.count_if(F.col("messages") > 0).alias("active_hours")
    )
    days = weekdays(cells).groupBy("room_id").agg(first_max("weekday").alias("busiest_weekday"))
    return hours.join(days, ROOM)


def dayparts(cells: DataFrame) -> DataFrame:
    """Shares of four six-hour bands; the largest band absorbs the rounding drift."""
    names = F.array(*[F.lit(x) for x in ("dawn", "morning", "afternoon", "evening")])
    counts = hourly(cells).groupBy("room_id", F.floor(F.col("hour") / 6).cast("int").alias("band")).agg(
        F.sum("messages").alias("messages")
    )
    room = Window.partitionBy("room_id")
    shares = counts.withColumn("_p", percent(F.col("messages"), F.sum("messages").over(room)))
    drift = F.lit(100.0) - F.sum("_p").over(room)
    last_max = F.row_number().over(room.orderBy(F.desc("_p"), F.desc("band"))) == 1
    fixed = F.when(last_max & (F.abs(drift) >= 0.05), half_up(F.col("_p") + drift, 1)).otherwise(F.col("_p"))
    return shares.select("room_id", "band", F.element_at(names, F.col("band") + 1).alias("daypart"), fixed.alias("percent"))


# ---- participants ---------------------------------------------------------------

def participants(cells: DataFrame, flags: bool = True) -> DataFrame:
    """One row per (room, sender), also for senders of system rows only."""
    names = ["all_messages", "messages", "characters", "night_messages"]
    if flags:
        names += ["attachment_messages", "link_messages", "laugh_messages", "short_messages"]
    per = cells.groupBy("room_id", "sender").agg(
        *[F.sum(n).alias(n) for n in names], F.min("first_line").alias("first_line")
    )
    room = per.groupBy("room_id").agg(
        F.sum("all_messages").alias("_total"), F.sum("characters").alias("_chars")
    )
    return per.join(room, ROOM).select(
        "room_id", "sender", "first_line", *[n for n in names if n != "all_messages"],
        half_up(F.col("characters") / F.greatest(F.col("messages"), F.lit(1)), 1).alias("average_length"),
        percent(F.col("messages"), F.col("_total")).alias("share_percent"),
        percent(F.col("characters"), F.col("_chars")).alias("character_share_percent"),
    )


def top_participants(people: DataFrame, k: int, by: str = "messages") -> DataFrame:
    if by == "characters":
        order = [F.desc("characters"), F.desc("messages"), F.asc("first_line")]
    else:
        order = [F.desc("messages"), F.asc("first_line")]
    return top_k(people, ROOM, order, k)


def aliases(people: DataFrame, privacy: str = "masked", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(room, sender) -> public name, in order of first appearance."""
    base = people.select("room_id", "sender", "first_line")
    if privacy == "anonymous":
        ranked = ordered_rank(base, ROOM, "first_line", "n", chunk_rows)
        digits = F.greatest(F.lit(3), F.length(F.col("n").cast("string")))
        return ranked.select(
            "room_id", "sender", "first_line",
            F.concat(F.lit("User "), F.lpad(F.col("n").cast("string"), digits, F.lit("0"))).alias("alias"),
        )
    masked = base.withColumn("_mask", mask_name(F.col("sender")))
    ranked = ordered_rank(masked, ["room_id", "_mask"], "first_line", "n", chunk_rows)
    name = F.when(F.col("n") == 1, F.col("_mask")).otherwise(F.concat("_mask", F.lit("·"), F.col("n").cast("string")))
    return ranked.select("room_id", "sender", "first_line", name.alias("alias"))


def first_appearances(cells: DataFrame) -> DataFrame:
    """New senders per day of first appearance (file order)."""
    first = cells.groupBy("room_id", "sender").agg(F.min_by("day", "first_line").alias("day"))
    return first.groupBy("room_id", "day").agg(F.count("*").alias("new_senders"))


def sender_day_counts(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("messages") > 0).select("room_id", "day", "sender", "messages")


# ---- room level -------------------------------------------------------------------

def room_totals(cells: DataFrame) -> DataFrame:
    """Plain sums per room; participants and days are counted on pre-aggregated keys."""
    counters = [
        c for c in cells.columns
        if c.endswith("messages") or c == "characters"
    ]
    per_sender = cells.groupBy("room_id", "sender").agg(
        *[F.sum(c).alias(c) for c in counters],
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"),
        F.min_by("first_ts", "first_line").alias("first_ts"), F.max_by("last_ts", "last_line").alias("last_ts"),
    )
    rooms = per_sender.groupBy("room_id").agg(
        F.count("*").alias("participants"),
        *[F.sum(c).alias(c) for c in counters],
        F.min_by("first_ts", "first_line").alias("first_ts"), F.max_by("last_ts", "last_line").alias("last_ts"),
    )
    days = cells.groupBy("room_id", "day").agg(F.sum("all_messages").alias("m")).groupBy("room_id").agg(
        F.count("*").alias("active_days"), F.max("m").alias("peak_day_messages"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    return rooms.join(days, ROOM)


def density(first_ts: Column, last_ts: Column, total: Column) -> Column:
    """Messages per calendar day between the first and the last row."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    span = F.greatest(F.lit(1), F.floor((us(last_ts) - us(first_ts)) / F.lit(86_400_000_000)) + 1)
    return F.when(total > 0, half_up(total / span, 2))


def room_summary(cells: DataFrame) -> DataFrame:
    r = room_totals(cells)
    total = F.col("all_messages")
    return r.select(
        "room_id", total.alias("total_messages"), "participants", "active_days", "first_ts", "last_ts",
        "first_day", "last_day",
        half_up(F.col("characters") / F.greatest(total, F.lit(1)), 1).alias("average_length"),
        half_up(total / F.col("active_days"), 1).alias("messages_per_active_day"),
        percent(F.col("night_messages"), total).alias("night_percent"),
        percent(F.col("weekend_messages"), total).alias("weekend_percent"),
        percent(F.col("peak_day_messages"), total).alias("peak_day_percent"),
        density(F.col("first_ts"), F.col("last_ts"), total).alias("density_per_day"),
        *[
            F.col(c) for c in (
                "link_messages", "attachment_messages", "emoji_messages", "question_messages",
                "laugh_messages", "pure_laugh_messages", "short_messages",
            ) if c in r.columns
        ],
        *[
            percent(F.col(c), total, 2).alias(n) for c, n in (
                ("link_messages", "links_per_100"), ("attachment_messages", "attachments_per_100"),
                ("question_messages", "questions_per_100"),
            ) if c in r.columns
        ],
    )


def tone_rates(summary: DataFrame) -> DataFrame:
    """Laughs, short replies and pictographs per 100 messages; pure-laugh share."""
    total = F.col("total_messages")
    return summary.select(
        "room_id", "laugh_messages", "short_messages", "emoji_messages", "pure_laugh_messages",
        percent(F.col("laugh_messages"), total).alias("laugh_per_100"),
        percent(F.col("short_messages"), total).alias("short_per_100"),
        percent(F.col("emoji_messages"), total).alias("emoji_per_100"),
        percent(F.col("pure_laugh_messages"), total).alias("pure_laugh_percent"),
    )


def range_totals(days: DataFrame, start: str, end: str) -> DataFrame:
    """Messages and active days within [start, end]; reversed bounds are swapped."""
    lo, hi = sorted((start, end))
    inside = days.filter(F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return inside.groupBy("room_id").agg(
        F.sum("messages").alias("messages"), F.count_if(F.col("messages") > 0).alias("active_days")
    )
