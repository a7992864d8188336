"""Conversation flow from keyed state with event-time timers.

A room is cut into slots of event time (an hour by default); a slot of a room is one key, so the
rows of a busy room spread over as many tasks as it has open slots. A key holds its rows until the
watermark passes the end of its slot. Then a timer puts them in order, gives one summary, and
clears the state: only open slots take memory. Summaries are small (first and last message,
switches, pieces of sessions) and are linked across slots when they are read.

Rows behind the watermark are not seen by the state; Spark counts them, and ``run`` hands the
count on. A stream that is stopped goes on from its checkpoint, open slots included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palaver.operators.flow import IDLE_MS
from palaver.streaming.rooms import ON_DISK, append

SLOT_MS = 3_600_000
SUMMARY = (
    "room_id string, slot_ms bigint, messages bigint, switches bigint, first_us bigint, first_sender string, last_us bigint, "
    "last_sender string, pieces array<struct<start_us: bigint, end_us: bigint, messages: bigint>>"
)


def summary(rows: list[tuple], idle_us: int = IDLE_MS * 1000) -> dict:
    """Of a slot's rows (us, line, sender): ends, changes of the speaker, pieces of sessions."""
    rows = sorted(rows)
    pieces, switches = [], 0
    for k, (us, _, sender) in enumerate(rows):
        if k and us - rows[k - 1][0] <= idle_us:
            pieces[-1]["end_us"] = us
            pieces[-1]["messages"] += 1
        else:
            pieces.append({"start_us": us, "end_us": us, "messages": 1})
        switches += bool(k) and sender != rows[k - 1][2]
    return {
        "messages": len(rows), "switches": switches, "first_us": rows[0][0], "first_sender": rows[0][2],
        "last_us": rows[-1][0], "last_sender": rows[-1][2], "pieces": pieces,
    }


class SlotProcessor(StatefulProcessor):
    """Rows of one slot of one room, until its end has passed."""

    def __init__(self, slot_ms: int):
        self.slot_ms = slot_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us bigint, line bigint, sender string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.rows.appendList([(int(u), int(n), s) for u, n, s in zip(batch["us"], batch["line"], batch["sender"])])
        self.handle.registerTimer(int(key[1]) + self.slot_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = summary(list(self.rows.get()))
        self.rows.clear()
        yield pd.DataFrame([{"room_id": key[0], "slot_ms": key[1], **found}])

    def close(self) -> None:
        pass


def slots(messages: DataFrame, delay: str = "1 hour", slot_ms: int = SLOT_MS) -> DataFrame:
    """Summaries of closed slots of a message stream."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = messages.withWatermark("ts", delay).select("room_id", "ts", us.alias("us"), "line", "sender")
    keyed = rows.withColumn("slot_ms", F.floor(F.col("us") / (slot_ms * 1000)) * slot_ms)
    return keyed.groupBy("room_id", "slot_ms").transformWithStateInPandas(SlotProcessor(slot_ms), SUMMARY, "Append", "EventTime")


def run(messages: DataFrame, delay: str = "1 hour", slot_ms: int = SLOT_MS, resume: str | None = None) -> tuple[DataFrame, int]:
    """(summaries so far, late rows of this run) over all data that is there."""
    return append(slots(messages, delay, slot_ms), "slots", resume, **ON_DISK)


# ---- linked across slots; a room has one row per slot here ------------------------------


def switches(summaries: DataFrame) -> DataFrame:
    """Messages and changes of the speaker per room over its closed slots."""
    room = Window.partitionBy("room_id").orderBy("slot_ms")
    border = (F.lag("last_sender").over(room) != F.col("first_sender")).cast("int")
    return summaries.withColumn("border", F.coalesce(border, F.lit(0))).groupBy("room_id").agg(
        F.sum("messages").alias("messages"), F.sum(F.col("switches") + F.col("border")).alias("switches")
    )


def sessions(summaries: DataFrame, idle_us: int = IDLE_MS * 1000) -> DataFrame:
    """(room, start_us, end_us, messages): pieces of neighbouring slots that belong together are one session."""
    pieces = summaries.select("room_id", F.explode("pieces").alias("p")).select("room_id", "p.*")
    room = Window.partitionBy("room_id").orderBy("start_us")
    new = F.coalesce((F.col("start_us") - F.lag("end_us").over(room) > idle_us).cast("int"), F.lit(1))
    numbered = pieces.withColumn("new", new).withColumn("session", F.sum("new").over(room.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("room_id", "session").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("messages").alias("messages")
    ).drop("session")
