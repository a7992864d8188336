"""Exact order statistics without collecting a group into one task.

Values are first counted per distinct value (map-side combined), then located in
two steps: cumulative counts over coarse bins pick the bin of every wanted rank,
cumulative counts inside that bin pick the value. A window never sees more than
``bin_width`` distinct values or the number of bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_WIDTH = 65_536


def values_at_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    bin_width: int = BIN_WIDTH,
) -> DataFrame:
    """One row per key: ``n`` and, per entry ``name -> rank(n)``, the value with that

    0-based rank in ascending order. ``value`` must be an integer column.
    """
    keys = list(keys)
    freq = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    freq = freq.withColumn("_bin", F.floor(F.col(value) / F.lit(bin_width)))
    # spelled out, so that both uses of ``freq`` read one exchange
    present = F.col("_bin").isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    freq = freq.filter(present)
    per_key = Window.partitionBy(*keys)
    ordered = per_key.orderBy("_bin")
    bins = (
        freq.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_m"))
        .withColumn("_end", F.sum("_m").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_m").over(per_key))
        .withColumn("_start", F.col("_end") - F.col("_m"))
    )
    wanted = [r(F.col("n")) for r in ranks.values()]
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((F.col("_start") <= r) & (r < F.col("_end")))
    bins = bins.filter(hit).select(*keys, "_bin", "_start", "n")
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        freq.join(bins, [*keys, "_bin"])
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    picks = [
        F.max(F.when((F.col("_lo") <= r(F.col("n"))) & (r(F.col("n")) < F.col("_hi")), F.col(value))).alias(name)
        for name, r in ranks.items()
    ]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def floor_rank(p: float) -> Callable[[Column], Column]:
    """Rank floor(n * p), kept below n."""
    return lambda n: F.least(F.floor(n * F.lit(p)), n - 1)


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median with the mean of the two middle values for even counts."""
    out = values_at_ranks(
        rows, keys, value,
        {"_low": lambda n: F.floor((n - 1) / F.lit(2)), "_high": lambda n: F.floor(n / F.lit(2))},
    )
    return out.select(*keys, "n", ((F.col("_low") + F.col("_high")) / F.lit(2.0)).alias(name))
