"""Structured Streaming versions of the room metrics.

Built-in windowed aggregates where Spark has them; order-dependent state (previous
message, runs, sessions, samples) lives in small versioned tables that
``foreachBatch`` reads and writes. Batch ``n`` only reads version ``n - 1`` and
overwrites version ``n``, so a repeated batch gives the same result, and the work of a
batch is an ordinary distributed job: a hot room is cut into chunks as in batch mode.

Late rows: rows at or before the last position of their room are counted in
``late`` and left out of the flow; windowed counts drop rows behind the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.operators.flow import IDLE_MS, gap_histogram, gaps
from palaver.operators.keywords import token_docs
from palaver.operators.ordered import CHUNK_ROWS, link_rows
from palaver.operators.sampling import hash_sample
from palaver.operators.sketches import TRACKED, count_items, merge_items
from palaver.session import work_dir
from palaver.sources.tables import table

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table_stream(
    spark: SparkSession, folder: str, schema: StructType | str, pattern: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A table of a folder as a stream: all files, or folders of part files, whose names fit the pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{pattern}")


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder as a stream of messages (one room per language), all on one day."""
    docs = table(spark, folder, "documents").schema
    return table_stream(spark, folder, docs, "documents*.parquet").select(
        F.col("lang").alias("room_id"), F.col("doc_id").alias("line"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.col("lang").alias("sender"), F.col("text").alias("message"),
    )


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None, pattern: str = "events*.parquet") -> DataFrame:
    """Events files of a folder as a stream of messages (one room per event type)."""
    return table_stream(spark, folder, EVENT_SCHEMA, pattern, files_per_trigger).select(
        F.col("event_type").alias("room_id"), F.col("event_id").alias("line"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("sender"), F.col("event_type").alias("message"),
    )


# ---- running a query over what is there --------------------------------------------

def _base(spark: SparkSession, name: str, resume: str | None) -> str:
    """Folder of a stream: ``resume`` names one that goes on where it stopped."""
    return f"{work_dir(spark)}/{name}-{resume or uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings while a stream is started and runs; the former values come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Touching rows of a session merge before they are shuffled; state is kept on the executors' disks.
LOCAL_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def append(stream: DataFrame, name: str, resume: str | None = None, **options: str) -> tuple[DataFrame, int]:
    """(finished rows so far, rows behind the watermark in this run) over all available data."""
    spark = stream.sparkSession
    base = _base(spark, name, resume)
    with settings(spark, **options):
        query = (
            stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), late


def run_append(stream: DataFrame, name: str, resume: str | None = None, **options: str) -> DataFrame:
    """Process all available data, append finished rows to a table, read it back."""
    return append(stream, name, resume, **options)[0]


def run_batches(
    stream: DataFrame, name: str, handle: Callable[[DataFrame, int, str], None], mode: str = "append", resume: str | None = None
) -> str:
    """Process all available data with ``handle(batch, id, base)``; returns the base folder.

    Batches of a resumed stream go on counting; a batch that was cut off is repeated and
    overwrites what it had written.
    """
    base = _base(stream.sparkSession, name, resume)
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(lambda d, i: handle(d, i, base)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return base


def _put(d: DataFrame, base: str, table: str, batch: int) -> None:
    d.write.mode("overwrite").parquet(f"{base}/{table}/batch={batch}")


# ---- windowed counts ------------------------------------------------------------------

def latest_counts(counts: DataFrame, name: str, keys: list[str], resume: str | None = None) -> DataFrame:
    """All windows so far, open ones too: the log of updates, of which the largest count is the newest.

    State is bounded by the watermark; closed windows live in the log only.
    """
    log = _log(counts, name, resume)
    return log.groupBy(*keys).agg(F.max("messages").alias("messages"))


def hourly_counts(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    w = F.window("ts", "1 hour")
    return messages.withWatermark("ts", delay).groupBy("room_id", w.alias("w")).agg(F.count("*").alias("messages")).select(
        "room_id", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "messages"
    )


def daily_counts(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    w = F.window("ts", "1 day")
    return messages.withWatermark("ts", delay).groupBy("room_id", w.alias("w")).agg(F.count("*").alias("messages")).select(
        "room_id", F.to_date("w.start").alias("day"), "messages"
    )


def sliding_activity(messages: DataFrame, size: str = "7 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Overlapping windows for burst watching on live data."""
    w = F.window("ts", size, step)
    return messages.withWatermark("ts", delay).groupBy("room_id", w.alias("w")).agg(F.count("*").alias("messages")).select(
        "room_id", F.to_date("w.start").alias("from_day"), "messages"
    )


def sessions(messages: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Closed sessions."""
    w = F.session_window("ts", gap)
    return messages.withWatermark("ts", delay).groupBy("room_id", w.alias("w")).agg(F.count("*").alias("messages")).select(
        "room_id", F.unix_micros("w.start").alias("start_us"), "messages"
    )


# ---- update logs: the newest value of a key wins when the table is read ------------------

def _log(stream: DataFrame, name: str, resume: str | None = None) -> DataFrame:
    base = run_batches(stream, name, lambda d, i, b: _put(d, b, "log", i), "update", resume)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/log")


SEEN = "room_id string, sender string, line bigint, day date"


def first_seen(messages: DataFrame, resume: str | None = None) -> DataFrame:
    """New senders per day, without streaming state.

    A batch keeps one row per sender it holds, drops those that older batches know with an earlier
    line, and seals the rest under its own number: a sender is written once, unless rows arrive out
    of order.
    """
    def handle(batch: DataFrame, number: int, base: str) -> None:
        first = F.min(F.struct("line", F.to_date("ts").alias("day"))).alias("first")
        seen = batch.groupBy("room_id", "sender").agg(first).select("room_id", "sender", "first.*")
        if number > 0:
            sealed = batch.sparkSession.read.schema(f"{SEEN}, batch int").parquet(f"{base}/sealed").filter(F.col("batch") < number)
            old = sealed.select("room_id", "sender", F.col("line").alias("_line"))
            same = F.col("s.room_id").eqNullSafe(F.col("o.room_id")) & F.col("s.sender").eqNullSafe(F.col("o.sender"))
            seen = seen.alias("s").join(old.alias("o"), same & (F.col("o._line") <= F.col("s.line")), "left_anti")
        _put(seen, base, "sealed", number)

    base = run_batches(messages, "first-seen", handle, resume=resume)
    sealed = messages.sparkSession.read.schema(SEEN).parquet(f"{base}/sealed")
    best = sealed.groupBy("room_id", "sender").agg(F.min(F.struct("line", "day")).alias("first"))
    return best.groupBy("room_id", F.col("first.day").alias("day")).agg(F.count("*").alias("new_senders"))


def term_counts(texts: DataFrame, text: str = "message", resume: str | None = None) -> DataFrame:
    """Document frequency per term; state is keyed by (room, term)."""
    terms = token_docs(texts, text).select("room_id", F.explode("tokens").alias("term"))
    log = _log(terms.groupBy("room_id", "term").agg(F.count("*").alias("df")), "terms", resume)
    return log.groupBy("room_id", "term").agg(F.max("df").alias("df"))


def top_terms(texts: DataFrame, text: str = "message", tracked: int = TRACKED, resume: str | None = None) -> DataFrame:
    """(room, items, rows): counters of the frequent terms of each room.

    The state is one sketch per room, whatever the size of the vocabulary; version n of it is
    version n - 1 merged with the batch.
    """
    def handle(batch: DataFrame, number: int, base: str) -> None:
        terms = token_docs(batch, text).select("room_id", F.explode("tokens").alias("term"))
        counted = count_items(terms, ["room_id"], "term", tracked)
        if number > 0:
            held = batch.sparkSession.read.schema(counted.schema).parquet(f"{base}/terms/batch={number - 1}")
            counted = merge_items(held.unionByName(counted), ["room_id"], tracked)
        _put(counted, base, "terms", number)

    return _newest(texts.sparkSession, run_batches(texts, "top-terms", handle, resume=resume), "terms")


def _newest(spark: SparkSession, base: str, table: str, schema: str | None = None) -> DataFrame:
    """The last version of a state table."""
    versions = spark.read.schema(f"{schema}, batch int").parquet(f"{base}/{table}") if schema else spark.read.parquet(f"{base}/{table}")
    last = versions.agg(F.max("batch")).first()[0]
    return versions.filter(F.col("batch") == last).drop("batch")


# ---- order-dependent state ----------------------------------------------------------------

FLOW = "room_id string, line bigint, sender string, us bigint, prev_sender string, gap_ms bigint, run_id bigint, session_id bigint"
CARRY = "room_id string, line bigint, sender string, us bigint, run_id bigint, session_id bigint"


def flow_step(batch: DataFrame, carry: DataFrame | None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flow rows of the batch, late rows, new carry) from a batch and the last rows seen."""
    spark = batch.sparkSession
    rows = batch.select("room_id", "line", "sender", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    carry = carry if carry is not None else spark.createDataFrame([], CARRY)
    last = carry.select("room_id", F.col("line").alias("_last"), F.col("run_id").alias("_run"), F.col("session_id").alias("_session"))
    rows = rows.join(last, ["room_id"], "left")
    late = rows.filter(F.col("line") <= F.col("_last")).select("room_id", "line", "sender", "us")
    fresh = rows.filter(F.col("_last").isNull() | (F.col("line") > F.col("_last")))
    old = carry.select(
        "room_id", "line", "sender", "us", F.col("line").alias("_last"), F.col("run_id").alias("_run"), F.col("session_id").alias("_session")
    )
    linked = link_rows(
        fresh.unionByName(old), ["us", "sender"],
        {
            "run": lambda cur, prev: cur["sender"] != prev["sender"],
            "session": lambda cur, prev: (cur["us"] - prev["us"]) > IDLE_MS * 1000,
        },
        chunk_rows=chunk_rows,
    )
    # the carried row is island 1 of this batch and keeps its own numbers
    d = linked.select(
        "room_id", "line", "sender", "us", F.col("prev.sender").alias("prev_sender"),
        F.floor((F.col("us") - F.col("prev.us")) / F.lit(1000)).alias("gap_ms"),
        (F.col("run_id") - 1 + F.coalesce("_run", F.lit(1))).alias("run_id"),
        (F.col("session_id") - 1 + F.coalesce("_session", F.lit(1))).alias("session_id"),
        (F.col("line") == F.coalesce("_last", F.lit(-1))).alias("_old"),
    )
    state = d.groupBy("room_id").agg(F.max_by(F.struct("line", "sender", "us", "run_id", "session_id"), "line").alias("s"))
    return d.filter(~F.col("_old")).drop("_old"), late, state.select("room_id", "s.*")


def flow(messages: DataFrame, chunk_rows: int = CHUNK_ROWS, resume: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(flow, late) tables of a message stream: gaps, previous speaker, runs, sessions."""
    def handle(batch: DataFrame, number: int, base: str) -> None:
        spark = batch.sparkSession
        carry = spark.read.schema(CARRY).parquet(f"{base}/carry/batch={number - 1}") if number > 0 else None
        rows, late, state = flow_step(batch, carry, chunk_rows)
        _put(rows, base, "flow", number)
        _put(late, base, "late", number)
        _put(state, base, "carry", number)

    base = run_batches(messages, "flow", handle, resume=resume)
    read = lambda t, s: messages.sparkSession.read.schema(s).parquet(f"{base}/{t}")
    return read("flow", FLOW), read("late", "room_id string, line bigint, sender string, us bigint")


def stream_gap_histogram(messages: DataFrame) -> DataFrame:
    """Mergeable gap histogram: counts per (room, bin) of every batch add up."""
    rows, _ = flow(messages)
    return gap_histogram(gaps(rows))


def sample(messages: DataFrame, cap: int = 480, seed: int = 42, resume: str | None = None) -> DataFrame:
    """Uniform sample of all rows so far; version n is drawn from version n - 1 and the batch."""
    schema = "room_id string, line bigint, sender string"

    def handle(batch: DataFrame, number: int, base: str) -> None:
        rows = batch.select("room_id", "line", "sender")
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{base}/sample/batch={number - 1}"))
        caps = rows.select("room_id").distinct().withColumn("cap", F.lit(cap))
        _put(hash_sample(rows, caps, seed).drop("sample_rank"), base, "sample", number)

    base = run_batches(messages, "sample", handle, resume=resume)
    return _newest(messages.sparkSession, base, "sample", schema)
