"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept (Parquet, read again) and returns the columns of
``documents``; the last one returns the packed pieces.

Cases: a null text is an empty one, and all empty texts are copies of each other; rows without id
are kept like others, and of rows with one id and text one stays; ties go to the document that a
stage names (the largest id among exact copies, the smallest among near copies); texts of any length
are read whole; columns of the documents that share a name with one a stage adds keep their values;
without labels no document is toxic; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import exact_dedup, mixing, near_copies, packing, tokens, toxicity
from palaver.llm.common import materialise, table
from palaver.llm.queries import VOCABULARY


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs, tokens.vocabulary(VOCABULARY))


STAGES = [
    ("toxicity", clean), ("exact_dedup", deduplicate), ("simhash", deduplicate_near), ("mixing", mix), ("packing", pack),
]
#: The first stage is a trained classifier: no SQL states it; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
