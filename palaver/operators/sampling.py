"""Deterministic samples: the rows with the smallest hashes, per room and cap.

The hash is the MD5 of seed and key as text, which any engine can compute, so a sample can be
drawn again elsewhere. A histogram of its first digits tells which bins can hold sampled rows,
so only about ``cap`` rows of a room reach the ranking step, however large the room is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.topk import top_k

ROOM = ["room_id"]
BIN_DIGITS = 5  # hexadecimal


def sample_cap(n: Column) -> Column:
    """Sample size by number of messages in the room."""
    return F.when(n >= 100_000, 2000).when(n >= 50_000, 1200).when(n >= 10_000, 800).otherwise(480)


def hash_sample(rows: DataFrame, caps: DataFrame, seed: int = 42, key: str = "line") -> DataFrame:
    """rows(room_id, <key>, ...), caps(room_id, cap): uniform sample, same for every run."""
    d = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    d = d.withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    ahead = Window.partitionBy("room_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        d.groupBy("room_id", "_bin").agg(F.count("*").alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        .join(caps.select("room_id", "cap"), ROOM)
        .filter(F.col("_before") < F.col("cap"))
        .select("room_id", "_bin", "cap")
    )
    near = d.join(bins, ["room_id", "_bin"])
    w = Window.partitionBy("room_id").orderBy("_bin", "_h", key)
    return near.withColumn("sample_rank", F.row_number().over(w)).filter(
        F.col("sample_rank") <= F.col("cap")
    ).drop("_h", "_bin", "cap")


def text_sample(features: DataFrame, totals: DataFrame, seed: int = 42, least_chars: int = 12) -> DataFrame:
    """Sample of keyword texts of at least ``least_chars`` characters, capped by room size."""
    caps = totals.select("room_id", sample_cap(F.col("total_messages")).alias("cap"))
    texts = features.filter(F.col("keyword_text").isNotNull() & (F.col("chars") >= least_chars))
    return hash_sample(texts.select("room_id", "line", "sender", F.col("keyword_text").alias("text")), caps, seed)


def model_gate(profile: DataFrame, least: int = 48, force: bool = False) -> DataFrame:
    """May a model step run on this room? profile = ``keywords.script_profile``."""
    enough = F.col("texts") >= least
    return profile.select("room_id", "texts", (enough & (F.lit(force) | F.col("primarily_korean"))).alias("run_model"))


def gated(rows: DataFrame, gate: DataFrame) -> DataFrame:
    return rows.join(gate.filter("run_model").select("room_id"), ROOM, "left_semi")


def grow_sample(old: DataFrame, new: DataFrame, caps: DataFrame, seed: int = 42, key: str = "line") -> DataFrame:
    """Sample of (old sample + new rows): equals the sample of all rows seen so far."""
    cols = [c for c in old.columns if c != "sample_rank"]
    return hash_sample(old.select(*cols).unionByName(new.select(*cols)), caps, seed, key)


def context_samples(scored: DataFrame, k: int = 18) -> DataFrame:
    """Best k messages per room and day by score, then length, then position."""
    order = [F.desc("score"), F.desc("length"), F.asc("line")]
    return top_k(scored, ["room_id", "day"], order, k)
