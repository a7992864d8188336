"""Word lists, glossaries and reference values from small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word or pattern per line; blank lines and ``#`` comments are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r$", "")).alias("word"))
    return lines.filter((F.col("word") != "") & ~F.col("word").startswith("#"))


def words(spark: SparkSession, path: str, limit: int = 20_000) -> tuple[str, ...]:
    """A word list as literals for ``stop_terms`` and pattern arguments.

    Literals travel with every plan, so the size is checked.
    """
    rows = word_list(spark, path).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{path} has more than {limit} words; join it as a table instead")
    return tuple(r["word"] for r in rows)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {room_id, word, tag, score} of domain words."""
    return spark.read.schema("room_id string, word string, tag string, score double").json(path)


def reference_bands(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Breakpoints per metric from a JSON document {"reference": {metric: [..]}}."""
    schema = "reference map<string, array<double>>"
    row = spark.read.schema(schema).option("multiLine", True).json(path).limit(1).collect()
    return dict(row[0]["reference"]) if row else {}
