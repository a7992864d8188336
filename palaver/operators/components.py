"""Connected components by alternating stars, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it reaches.

    Neighbours move to the smallest node in sight until only stars are left, in a number
    of rounds that grows with the logarithm of the longest path. Minima are written first,
    so that the joins on hot nodes can be split.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "stars-least")

    def measure(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "stars"
    )
    before = measure(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(large.filter("u <> v").distinct(), "stars")
        least = smallest(pairs)
        small = pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = measure(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
