"""Per-group top-k. Spark plans ``row_number() <= k`` with a partial group limit

before the shuffle, so a hot group ships at most k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their ranks (``k`` of None: all rows)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def count_top(rows: DataFrame, keys: Sequence[str], label: str, k: int, longer_first: bool = False) -> DataFrame:
    """Label counts, highest first; ties by label (optionally the longer one first)."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("count"))
    order = [F.desc("count")] + ([F.desc(F.length(label))] if longer_first else []) + [F.asc(label)]
    return top_k(counts, keys, order, k)
