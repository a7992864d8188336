"""Which export files to read: newest per room, minimum size, n-th newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.text import room_name_from_file, safe_file_name


def list_exports(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Files of a folder with size and modification time; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    path = F.col("path")
    return files.select(
        "path", room_name_from_file(path).alias("room_id"), safe_file_name(path).alias("file_name"), "length", "modificationTime"
    )


def latest_exports(files: DataFrame, nth: int = 0, min_bytes: int = 1) -> DataFrame:
    """The n-th newest file (0 = newest) of every room, if it is large enough."""
    w = Window.partitionBy("room_id").orderBy(F.desc("modificationTime"), F.asc("path"))
    d = files.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") == nth).drop("_i")
    return d.filter(F.col("length") >= min_bytes)
