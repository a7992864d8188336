"""Small tables with nulls, blanks, repeats, very long texts and clashing column names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = (
    "size", "row", "hash", "sha", "fp", "digest", "bucket", "ticket", "score", "label", "lane", "known", "spans", "owner",
    "encoded_length", "offset", "target", "keep_id", "chunk", "item", "valid", "segments", "page_key", "asks", "alike", "__size",
    "__ticket", "__toxicity", "__digest", "__id", "copies",
)
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


ODD = [
    (1, "The same text, said twice.", "a"), (2, "The same text, said twice.", "b"), (2, "The same text, said twice.", "b"),
    (3, None, "a"), (4, "", None), (5, " \t\n ", "c"), (None, "no id here", "a"), (None, "no id here", None),
    (6, LONG, "a"), (7, LONG + " tail", "b"), (8, "ünïcödé — “quotes” 漢字 🙂 é \x1c x", "c"), (9, "one", "c"),
]
