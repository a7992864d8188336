"""Gold tables to parquet or JSON, silver messages partitioned by month."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, d in tables.items():
        d.write.mode("overwrite").format(fmt).save(f"{folder.rstrip('/')}/{name}")


def write_silver(messages: DataFrame, folder: str) -> None:
    """Messages partitioned by month: dates prune, and one huge room spreads over files.

    Partitioning by room would make one directory per room and one hot directory.
    """
    d = messages.withColumn("month", F.date_format("ts", "yyyy-MM"))
    d.write.mode("overwrite").partitionBy("month").parquet(folder)


def write_exports(messages: DataFrame, folder: str) -> None:
    """Messages as chat export files, one file per room (``room_id=...``)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.when(F.col("message").contains("\n"), F.col("message")).otherwise(quoted(F.col("message")))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), quoted(F.col("sender")), F.lit(","), body)
    lines = messages.select("room_id", "line", F.posexplode(F.split(text, "\n", -1)).alias("i", "value"))
    head = messages.select("room_id").distinct().select(
        "room_id", F.lit(-1).cast("long").alias("line"), F.lit(0).alias("i"), F.lit("Date,User,Message").alias("value")
    )
    write_rooms(lines.unionByName(head), folder)


#: The room of a file that ``write_rooms`` has written: the name of the file or of its folder.
ROOM_IN_PATH = r"room_id=([^/]+?)(?:\.txt)?(?:/|$)"
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_rooms(lines: DataFrame, folder: str) -> None:
    """lines(room_id, line, i, value) as one text file per room, ``room_id=<room>.txt`` in the folder of its task.

    Rooms are many and small. Spark's writer makes a folder per room, which readers list one by one,
    and on mounted file systems starts a process for the rights of each file. There the tasks write
    the files themselves; a task's folder appears when it is complete. Other stores keep Spark's
    writer, with the rooms as folders.
    """
    d = lines.repartition("room_id").sortWithinPartitions("room_id", "line", "i").select("room_id", "value")
    context = lines.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        d.write.partitionBy("room_id").text(folder)
        return
    root = at.toUri().getPath()
    os.makedirs(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        done, own = f"{root}/part-{task.partitionId():05d}", f"{root}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        room, out, rooms = None, None, 0
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for name, mine in groupby(rows, lambda r: r[0]):
                if out is None or name != room:
                    if out is None:
                        os.makedirs(own)
                    else:
                        out.close()
                    text = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name) if name else _NO_NAME
                    room, out, rooms = name, open(f"{own}/room_id={text}.txt", "ab"), rooms + 1
                out.writelines(b"%b\n" % (value or b"") for _, value in mine)
        if out is not None:
            out.close()
            try:
                os.rename(own, done)
            except OSError:
                if not os.path.isdir(done):
                    raise
                shutil.rmtree(own)  # an earlier attempt of this task was complete
        yield pa.RecordBatch.from_arrays([pa.array([rooms], pa.int64())], ["rooms"])

    d.select("room_id", F.col("value").cast("binary").alias("value")).mapInArrow(write, "rooms bigint").agg(F.sum("rooms")).collect()
