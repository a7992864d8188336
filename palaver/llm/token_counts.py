"""Exact histogram of encoded lengths, and what its suffix sums answer.

One pass turns each text into its number of ids; documents are added up by that number.
Suffix sums over the distinct lengths then answer, for every context limit: how many
documents reach it, how many tokens there are, and how many stay when longer documents are
cut at the limit. Sums run in blocks of lengths, so that no task holds all lengths.

Cases: a null text is empty and has length 0; an empty table gives no rows; repeated rows
count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm import tokens
from palaver.llm.common import columns_of, materialise, text_of

BLOCK = 128  # lengths in a block of the suffix sums


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.words_of(path)
        for batch in batches:
            lengths = [len(tokens.encode(text.as_py(), words)) // 4 for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["encoded_length"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """encoded_length, docs: the number of documents of each encoded length."""
    lengths = columns_of(docs, "text").select(text_of().alias("text"))
    counted = lengths.mapInArrow(_counter(vocabulary), "encoded_length long")
    return counted.groupBy("encoded_length").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length: documents and tokens at or above it, the total if longer documents

    are cut there, and the share of documents up to it.
    """
    cells = histogram.select(
        "encoded_length", "docs", (F.col("docs") * F.col("encoded_length")).alias("tokens"),
        F.floor(F.col("encoded_length") / BLOCK).alias("block"),
    )
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = cells.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("docs_all"),
        F.sum("t").over(everything).alias("tokens_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("encoded_length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.join(blocks, "block").select(
        "*",
        (F.sum("docs").over(inside) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
    )
    below = F.col("tokens_all") - F.col("tokens_at_least")
    return sums.select(
        "encoded_length", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (below + F.col("docs_at_least") * F.col("encoded_length")).alias("truncated_total"),
        (F.lit(1.0) - (F.col("docs_at_least") - F.col("docs")) / F.col("docs_all")).alias("share_up_to"),
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """context_limit, docs_at_least, tokens_at_least, truncated_total for any limits asked for."""
    asked = limits.select(F.col("context_limit").cast("long").alias("encoded_length")).where("encoded_length >= 0").distinct()
    both = histogram.select("encoded_length", "docs").unionByName(asked.withColumn("docs", F.lit(0).cast("long")))
    merged = both.groupBy("encoded_length").agg(F.sum("docs").alias("docs"))
    return suffix_sums(merged).join(asked, "encoded_length", "left_semi").select(
        F.col("encoded_length").alias("context_limit"), "docs_at_least", "tokens_at_least", "truncated_total"
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return sums.where(F.col("share_up_to") >= F.lit(share)).agg(F.min("encoded_length").alias("encoded_length"))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    return suffix_sums(materialise(length_histogram(docs, vocabulary), "lengths"))
