"""Chat exports through Spark's own file layer: any store that Spark reads, any file size.

Files are read as lines by the text source, which cuts large files into splits. A line's
number is the start of its split plus its place in the split: splits are never longer in
lines than in bytes, so numbers are unique and rise through the file, and no task counts the
lines before it. The lines are written once, then encodings are told from all lines of each
file, lines are decoded, and records are put together by ``messages_from_lines``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions.text import room_name_from_file
from palaver.session import materialise
from palaver.sources.chat_export import encoding_score, messages_from_lines

KOREAN = ("cp949", "euc-kr")


def line_columns() -> list[Column]:
    """What is kept of a text source's rows: file, split and bytes of the line."""
    return [
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("bytes"),
    ]


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, bytes) of all files under ``path``."""
    return numbered(spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(*line_columns()))


def numbered(lines: DataFrame) -> DataFrame:
    """(path, line, bytes) of lines(path, block, bytes) in the order of a scan."""
    d = materialise(lines.withColumn("at", F.monotonically_increasing_id()), "export-lines")
    first = d.groupBy("path", "block").agg(F.min("at").alias("first"))
    return d.join(first, ["path", "block"]).select("path", (F.col("block") + F.col("at") - F.col("first")).alias("line"), "bytes")


def encodings(lines: DataFrame) -> DataFrame:
    """(path, encoding) from all lines of each file that are not ASCII.

    A file is UTF-8 if no more of them are invalid than valid, so a damaged line does not
    turn a whole file. Others are scored by line, and the better Korean code page is taken.
    """

    @F.pandas_udf("array<bigint>")
    def scores(data: pd.Series) -> pd.Series:
        return data.map(lambda b: [encoding_score(bytes(b).decode(name, errors="replace")) for name in KOREAN])

    text = F.col("bytes").cast("string")
    valid = F.is_valid_utf8(text)
    beyond = ~valid | (F.octet_length(text) != F.char_length(text))
    d = lines.select("path", "bytes", valid.alias("valid"), beyond.alias("beyond"), F.hex(F.substring("bytes", 1, 3)).alias("mark"), "line")
    files = materialise(d.groupBy("path").agg(
        (F.count_if(F.col("valid") & F.col("beyond")) >= F.count_if(~F.col("valid"))).alias("unicode"),
        F.bool_or((F.col("line") == 0) & (F.col("mark") == "EFBBBF")).alias("marked"),
    ), "export-files")
    unicode = F.col("unicode") | F.col("marked")
    plain = files.where(unicode).select("path", F.when(F.col("marked"), "utf-8-bom").otherwise("utf-8").alias("encoding"))
    other = d.where("beyond").join(files.where(~unicode).select("path"), "path", "left_semi")
    scored = other.select("path", scores("bytes").alias("s")).groupBy("path").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(2)])
    return plain.unionByName(scored.select("path", F.when(F.col("s0") >= F.col("s1"), KOREAN[0]).otherwise(KOREAN[1]).alias("encoding")))


def text_lines(lines: DataFrame) -> DataFrame:
    """(path, line, value, encoding): UTF-8 stays in the JVM, Korean code pages are decoded in batches."""

    @F.pandas_udf("string")
    def decoded(data: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([bytes(b).decode(e, errors="replace") for b, e in zip(data, encoding)], dtype="object")

    d = lines.join(materialise(encodings(lines), "export-encodings"), "path")
    unicode = F.col("encoding").startswith("utf-8")
    plain = d.filter(unicode).withColumn("value", F.col("bytes").cast("string"))
    other = d.filter(~unicode).withColumn("value", decoded("bytes", "encoding"))
    value = F.regexp_replace(F.regexp_replace("value", r"\r$", ""), r"^\x{FEFF}", "")
    return plain.unionByName(other).select("path", "line", value.alias("value"), "encoding")


def records(lines: DataFrame, room: Column | None = None, keep_path: bool = False, since: str | None = None) -> DataFrame:
    """messages(room_id, line, ts, sender, message) from the day ``since`` on; the room is taken from the path."""
    found = messages_from_lines(lines.select(F.col("path").alias("room_id"), "line", "value"), since)
    name = room_name_from_file(F.col("path")) if room is None else room
    return found.withColumnRenamed("room_id", "path").select(
        name.alias("room_id"), "line", "ts", "sender", "message", *(["path"] if keep_path else [])
    )


def warnings(lines: DataFrame, room: Column | None = None) -> DataFrame:
    """(room_id, line, code): what is odd about the files.

    ``record_start_parse_error`` cannot arise: a record only starts where a field delimiter
    follows the date.
    """
    v = F.col("value")
    starts = v.rlike(lex.RECORD_START)
    d = lines.select("path", "line", "value", starts.alias("starts"))
    first = d.filter("starts").groupBy("path").agg(F.min("line").alias("first"))
    d = d.join(first, "path", "left")
    rest = F.regexp_replace(v, "^[^,]*,", "")
    names = F.transform(F.slice(F.split(v, ","), 1, 3), lambda n: F.regexp_replace(F.trim(n), '^"|"$', ""))
    head = (F.col("line") == 0) & ~F.col("starts")
    codes = F.array_compact(F.array(
        F.when(head & (F.regexp_count(v, F.lit('"')) % 2 == 1), "csv_parse_error"),
        F.when(head & (names != F.array(*[F.lit(h) for h in lex.EXPORT_HEADER])), "unexpected_header"),
        F.when((F.col("line") > 0) & (F.trim("value") != "") & (F.col("line") < F.coalesce("first", F.lit((1 << 63) - 1))), "continuation_without_record"),
        F.when(F.col("starts") & rest.startswith('"') & ~rest.rlike('^"(?:[^"]|"")*"'), "sender_parse_error"),
        F.when(F.col("starts") & F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).isNull(), "invalid_date"),
    ))
    name = room_name_from_file(F.col("path")) if room is None else room
    return d.select(name.alias("room_id"), "line", F.explode(codes).alias("code"))
