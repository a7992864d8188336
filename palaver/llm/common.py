"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.session import materialise

__all__ = ["materialise", "table", "text_of", "columns_of", "digest", "boxed", "unboxed", "only"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text"):
    """The text column with null counted as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can clash with nothing."""
    return df.select(*[df[name] for name in names])


def digest(text=None):
    """64-bit hash of the whole text; null counts as empty."""
    return F.xxhash64(text_of() if text is None else text)


def boxed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``doc``: columns of its own that are added clash with none."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


def unboxed(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    return boxes.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def only(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest of the text) is in ``keepers``, one row each.

    Null ids match null ids. The rows keep their columns; one shuffle of the texts.
    """
    def keys(doc_id, hash_):
        return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), hash_.alias("hash")]

    wanted = keepers.select(*keys(F.col("doc_id"), F.col("digest"))).distinct()
    box = F.col("doc")
    keyed = boxed(docs).select("doc", *keys(box["doc_id"], digest(F.coalesce(box["text"].cast("string"), F.lit("")))))
    found = keyed.join(wanted, ["id", "no_id", "hash"], "left_semi")
    order = [box[c] for c, kind in docs.dtypes if c not in ("doc_id", "text") and kind.split("(")[0] in ORDERED]
    first = Window.partitionBy("id", "no_id", "hash").orderBy(*(order or [F.col("id")]))
    return unboxed(found.withColumn("place", F.row_number().over(first)).where("place = 1"), docs)


ORDERED = {"string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "decimal"}
