"""Mergeable summaries of bounded size: heavy hitters, distinct senders and gap quantiles.

Each is a column of a gold table that can be added up over any set of rows: days to a range,
batches to a stream, rooms to a corpus. The exact operators stay beside them; a sketch answers
where the raw rows are no longer at hand, within a stated error.

* Heavy hitters (``approx_top_k``): at most ``tracked`` counters a group, whatever the size of the
  vocabulary. An estimate is never below the true count, and above it by no more than
  ``over(rows, tracked)``; every item with more than twice that many rows is among the estimates.
* Distinct senders (HyperLogLog): ``1.04 / sqrt(2 ** LG_K)`` relative standard error.
* Gap quantiles (KLL): a quantile's rank is off by no more than ``RANK_ERROR`` of all gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.flow import MAX_GAP_MS
from palaver.operators.topk import top_k

TRACKED = 4096
LG_K = 12
KLL_K = 400
RANK_ERROR = 0.02
SENDER_ERROR = 5 * 1.04 / 2 ** (LG_K / 2)  # five standard errors

ROOM = ["room_id"]


# ---- heavy hitters -----------------------------------------------------------------


def map_size(tracked: int = TRACKED) -> int:
    """Slots of the counters: a power of two that is at most three quarters full."""
    return 1 << (-(-tracked * 4 // 3) - 1).bit_length()


def over(rows: Column, tracked: int = TRACKED) -> Column:
    """By how much an estimate may exceed the true count of an item among ``rows``."""
    return rows * F.lit(3.5 / map_size(tracked))


def count_items(rows: DataFrame, keys: list[str], item: str, tracked: int = TRACKED) -> DataFrame:
    """(keys, items, rows): counters of each group; a hot group ships one sketch per task."""
    return rows.where(F.col(item).isNotNull()).groupBy(*keys).agg(
        F.expr(f"approx_top_k_accumulate(`{item}`, {tracked})").alias("items"), F.count("*").alias("rows")
    )


def merge_items(sketches: DataFrame, keys: list[str], tracked: int = TRACKED) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(items, {tracked})").alias("items"), F.sum("rows").alias("rows"))


def item_estimates(sketches: DataFrame, keys: list[str], item: str = "item", tracked: int = TRACKED) -> DataFrame:
    """(keys, item, estimate, over, rows) of the items that are frequent for sure."""
    found = F.explode(F.expr(f"approx_top_k_estimate(items, {tracked})"))
    return sketches.select(*keys, "rows", found.alias("e")).select(
        *keys, F.col("e.item").alias(item), F.col("e.count").alias("estimate"), over(F.col("rows"), tracked).alias("over"), "rows"
    )


def top_items(sketches: DataFrame, keys: list[str], k: int, item: str = "item", tracked: int = TRACKED) -> DataFrame:
    """The k items with the largest estimates, ties by name, with the range of their true counts."""
    d = item_estimates(sketches, keys, item, tracked)
    ranked = top_k(d, keys, [F.desc("estimate"), F.asc(item)], k)
    least = F.greatest(F.lit(0), F.col("estimate") - F.floor("over")).alias("at_least")
    return ranked.select(*keys, "rank", item, least, F.col("estimate").alias("at_most"))


# ---- sketches of a day -----------------------------------------------------------------


def day_sketches(flow: DataFrame) -> DataFrame:
    """(room, day, messages, senders, gaps): what the daily table needs to answer any range of days."""
    day = F.to_date(F.timestamp_micros("us"))
    valid = (F.col("gap_ms") > 0) & (F.col("gap_ms") <= MAX_GAP_MS)
    return flow.groupBy("room_id", day.alias("day")).agg(
        F.count("*").alias("messages"), F.expr(f"hll_sketch_agg(sender, {LG_K})").alias("senders"),
        F.expr(f"kll_sketch_agg_bigint(gap_ms, {KLL_K}) filter (where {'gap_ms > 0 and gap_ms <= ' + str(MAX_GAP_MS)})").alias("gaps"),
        F.count_if(valid).alias("gap_rows"),
    )


def between(days: DataFrame, first: str, last: str) -> DataFrame:
    """Days of a range, both ends included; reversed ends are swapped."""
    low, high = sorted((first, last))
    return days.where(F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def merge_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of days."""
    return days.groupBy(*keys).agg(
        F.sum("messages").alias("messages"), F.expr("hll_union_agg(senders)").alias("senders"),
        F.expr(f"kll_merge_agg_bigint(gaps, {KLL_K}) filter (where gap_rows > 0)").alias("gaps"), F.sum("gap_rows").alias("gap_rows"),
    )


def day_estimates(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, messages, senders, gap_rows, p50, p90): senders are a whole number, quantiles milliseconds."""
    there = F.col("gap_rows") > 0
    quantile = lambda p: F.when(there, F.expr(f"kll_sketch_get_quantile_bigint(gaps, {p}D)"))
    return merged.select(
        *keys, "messages", F.expr("hll_sketch_estimate(senders)").alias("senders"), "gap_rows",
        quantile(0.5).alias("p50"), quantile(0.9).alias("p90"),
    )
