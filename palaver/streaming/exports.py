"""A folder of chat exports as a stream of new messages.

An export is a snapshot: a later file of a room holds its older messages again. Files are taken by
Spark's file stream, each once, in the order in which they were written; the files of a trigger go
through the batch reader (encoding, records, warnings) as one job. A message's number is its second
and its place within that second, so it is the same in every snapshot; of each room only the
messages behind the last one known are new.

A batch writes its messages and the ends of its rooms under its own number and reads only the
numbers before, so a repeated batch gives the same rows, and a stopped stream goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.text import room_name_from_file
from palaver.session import TASKS
from palaver.sources import export_lines as ex
from palaver.streaming.rooms import _put, run_batches, settings

MESSAGES = "room_id string, line bigint, ts timestamp_ntz, sender string, message string"
ENDS = "room_id string, line bigint"
PLACES = 24  # bits of a number for the place within a second


def export_lines_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None, pattern: str = "*.csv") -> DataFrame:
    """Lines of the files that arrive in a folder."""
    reader = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(folder).select(*ex.line_columns())


def each_once(records: DataFrame) -> DataFrame:
    """Messages of records(room_id, path, line, ts, sender, message) of several snapshots, numbered by time.

    The k-th of a room, second, sender and text is the same message in all files.
    """
    same = Window.partitionBy("room_id", "path", "ts", "sender", "message").orderBy("line")
    d = records.withColumn("copy", F.row_number().over(same))
    d = d.groupBy("room_id", "ts", "sender", "message", "copy").agg(F.min(F.struct("path", "line")).alias("at"))
    place = F.row_number().over(Window.partitionBy("room_id", "ts").orderBy("at.path", "at.line"))
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return d.withColumn("place", place).select(
        "room_id", (F.shiftleft(second, PLACES) + F.col("place")).alias("line"), "ts", "sender", "message"
    )


def new_messages(lines: DataFrame, name: str = "exports", resume: str | None = None, room: Column | None = None) -> DataFrame:
    """All messages so far of a stream of export lines, each once."""
    spark = lines.sparkSession
    room = room_name_from_file(F.col("path")) if room is None else room

    def handle(batch: DataFrame, number: int, base: str) -> None:
        read = batch.sparkSession.read
        found = ex.records(ex.text_lines(ex.numbered(batch)), room, keep_path=True)
        known = batch.sparkSession.createDataFrame([], ENDS)
        if number:  # ends of a room only grow
            known = read.schema(f"{ENDS}, batch int").parquet(f"{base}/ends").where(F.col("batch") < number)
        ends = known.groupBy("room_id").agg(F.max("line").alias("end"))
        new = each_once(found).join(ends, "room_id", "left").where(F.col("end").isNull() | (F.col("line") > F.col("end"))).drop("end")
        _put(new, base, "messages", number)
        rows = read.schema(MESSAGES).parquet(f"{base}/messages/batch={number}")
        _put(rows.groupBy("room_id").agg(F.max("line").alias("line")), base, "ends", number)

    # the files of a batch are listed by path, a task per file unless bounded
    with settings(spark, **{"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(TASKS * spark.sparkContext.defaultParallelism)}):
        base = run_batches(lines, name, handle, resume=resume)
    return spark.read.schema(MESSAGES).parquet(f"{base}/messages").drop("batch")
