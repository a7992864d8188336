"""Concentration measures. Counts of equal values are merged first, so a window

sees distinct message counts (at most the square root of twice the traffic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions.numeric import half_up, percent
from palaver.operators.quantile import medians
from palaver.operators.topk import top_k

ROOM = ["room_id"]


def gini(people: DataFrame) -> DataFrame:
    """Gini of messages per participant; NULL when nobody wrote anything."""
    freq = people.groupBy("room_id", "messages").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("room_id").orderBy("messages").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("room_id")
    d = freq.withColumn("_end", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(all_))
    # sum over i in [end-c, end-1] of (2i - n + 1) = c * (2*end - c - n)
    weight = F.col("_c") * (2 * F.col("_end") - F.col("_c") - F.col("_n"))
    agg = d.groupBy("room_id").agg(
        F.sum(weight.cast("double") * F.col("messages")).alias("_num"),
        F.sum(F.col("_c") * F.col("messages")).alias("_sum"), F.max("_n").alias("_n"),
    )
    return agg.select(
        "room_id", F.when(F.col("_sum") > 0, half_up(F.col("_num") / (F.col("_n") * F.col("_sum")), 3)).alias("gini")
    )


def top3_share(people: DataFrame, totals: DataFrame) -> DataFrame:
    top = top_k(people, ROOM, [F.desc("messages"), F.asc("sender")], 3)
    s = top.groupBy("room_id").agg(F.sum("messages").alias("_m"))
    return s.join(totals, ROOM).select("room_id", percent(F.col("_m"), F.col("total_messages")).alias("top3_percent"))


def median_messages(people: DataFrame) -> DataFrame:
    return medians(people, ROOM, "messages").select("room_id", half_up(F.col("median"), 2).alias("median_messages"))


def entropy_bits(counts: DataFrame, keys=("room_id",)) -> DataFrame:
    """Shannon entropy in bits of ``count`` within ``keys``: log2 T - sum(c log2 c) / T.

    Needs only two partial sums, no window over the labels.
    """
    c = F.col("count").cast("double")
    agg = counts.groupBy(*keys).agg(F.sum(c).alias("_t"), F.sum(c * F.log2(c)).alias("_s"), F.count("*").alias("labels"))
    return agg.select(*keys, "labels", half_up(F.log2("_t") - F.col("_s") / F.col("_t"), 2).alias("entropy_bits"))


def rhythm_score(gini_value: Column, streak: Column, density: Column) -> Column:
    balance = F.lit(1.0) - F.least(F.lit(0.95), F.coalesce(gini_value, F.lit(0.45)))
    steady = F.least(F.lit(1.0), streak / 28.0)
    dense = F.coalesce(F.least(F.lit(1.0), density / 40.0), F.lit(0.25))
    score = half_up(48.0 * balance + 32.0 * steady + 20.0 * dense)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def reference_bands(metrics: DataFrame, reference: dict | None = None) -> DataFrame:
    """metrics(room_id, gini, night, switch, rhythm, weekend) -> percentile and band.

    The breakpoints are literals, so the range lookup needs no join.
    """
    reference = reference or lex.REFERENCE_BANDS
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("metric"), F.coalesce(F.col(k), F.lit(0.5 if k == "gini" else 0.0)).cast("double").alias("value"),
            F.array(*[F.lit(float(x)) for x in ref]).alias("ref"),
        )
        for k, ref in reference.items()
    ])
    d = metrics.select("room_id", F.explode(rows).alias("_r")).select("room_id", "_r.*")
    below = F.size(F.filter("ref", lambda x: F.col("value") >= x))
    p = F.least(F.lit(99.0), F.greatest(F.lit(1.0), half_up(below / F.size("ref") * 100.0)))
    d = d.withColumn("percentile", p.cast("int"))
    q = F.col("percentile")
    band = F.when(q >= 85, "top").when(q >= 60, "above").when(q >= 40, "middle").when(q >= 20, "below").otherwise("bottom")
    return d.select("room_id", "metric", "value", "percentile", band.alias("band"))
