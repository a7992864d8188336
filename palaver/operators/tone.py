"""Tone tables: pictographs, speech level, lexicon sentiment, abuse, scored samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import tone as tone_fn
from palaver.functions.numeric import half_up, percent
from palaver.functions.text import emoji_category, emojis
from palaver.operators.topk import top_k

ROOM = ["room_id"]


def tone_cells(toned: DataFrame) -> DataFrame:
    """Sums per room, sender and day of ``features.with_tone``; read once, rolled up below."""
    style = lambda s: F.count_if(F.col("style") == s).alias(s)
    return toned.filter(~F.col("is_system")).groupBy("room_id", "sender", "day").agg(
        style("honorific"), style("casual"), style("neutral").alias("plain"),
        F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.sum("neutral").alias("neutral"),
        F.sum("profanity").alias("profanity_hits"), F.count_if(F.col("profanity") > 0).alias("profane_messages"),
    )


# ---- pictographs -------------------------------------------------------------------

def emoji_cells(features: DataFrame) -> DataFrame:
    marks = features.filter(~F.col("is_system") & F.col("has_emoji")).select(
        "room_id", "sender", F.explode(emojis(F.col("msg"))).alias("emoji")
    )
    return marks.groupBy("room_id", "sender", "emoji").agg(F.count("*").alias("count"))


def emoji_categories(cells: DataFrame) -> DataFrame:
    return cells.groupBy("room_id", emoji_category(F.col("emoji")).alias("category")).agg(F.sum("count").alias("count"))


def top_emojis(cells: DataFrame, k: int = 5) -> DataFrame:
    counts = cells.groupBy("room_id", "emoji").agg(F.sum("count").alias("count"))
    return top_k(counts, ROOM, [F.desc("count"), F.asc("emoji")], k)


def sender_emojis(cells: DataFrame) -> DataFrame:
    """Per sender: total, three most used, dominant category."""
    keys = ["room_id", "sender"]
    top = top_k(cells, keys, [F.desc("count"), F.asc("emoji")], 3).groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "emoji"))), lambda s: s["emoji"]), " ").alias("top_emojis")
    )
    per_category = cells.groupBy(*keys, emoji_category(F.col("emoji")).alias("category")).agg(F.sum("count").alias("c"))
    total = per_category.groupBy(*keys).agg(F.sum("c").alias("emojis"))
    main = top_k(per_category, keys, [F.desc("c"), F.asc("category")], 1).select(
        *keys, F.col("category").alias("dominant_category")
    )
    return total.join(top, keys).join(main, keys)


# ---- speech level -------------------------------------------------------------------

def speech_levels(cells: DataFrame) -> DataFrame:
    """Style ratios per sender and the dominant style, if there is enough evidence."""
    d = cells.groupBy("room_id", "sender").agg(
        F.sum("honorific").alias("honorific"), F.sum("casual").alias("casual"), F.sum("plain").alias("plain")
    )
    d = d.filter(F.col("honorific") + F.col("casual") + F.col("plain") > 0)
    styled = F.col("honorific") + F.col("casual")
    observed = styled + F.col("plain")
    h = F.when(styled > 0, F.col("honorific") / styled).otherwise(F.lit(0.0))
    c = F.when(styled > 0, F.col("casual") / styled).otherwise(F.lit(0.0))
    style = (
        F.when((styled < 3) | (styled / observed < 0.25), "insufficient")
        .when(h >= 0.7, "honorific").when(c >= 0.7, "casual").otherwise("mixed")
    )
    return d.select(
        "room_id", "sender", "honorific", "casual", observed.alias("samples"),
        h.alias("honorific_ratio"), c.alias("casual_ratio"), (F.col("plain") / observed).alias("neutral_ratio"),
        style.alias("style"),
    )


def room_relationship(levels: DataFrame) -> DataFrame:
    d = levels.groupBy("room_id").agg(
        F.sum("honorific").alias("_h"), F.sum("casual").alias("_c"), F.count("*").alias("_n"),
        F.count_if(F.col("style") == "honorific").alias("honorific_senders"),
        F.count_if(F.col("style") == "casual").alias("casual_senders"),
    )
    styled = F.col("_h") + F.col("_c")
    room_style = (
        F.when((styled > 0) & (F.col("_h") / styled >= 0.7), "formal")
        .when((styled > 0) & (F.col("_c") / styled >= 0.7), "casual").otherwise("mixed")
    )
    h, c = F.col("honorific_senders"), F.col("casual_senders")
    relation = (
        F.when(h / F.col("_n") >= 0.7, "formal").when(c / F.col("_n") >= 0.7, "friendly")
        .when((h > 0) & (c > 0), "hierarchical").otherwise("mixed")
    )
    return d.select("room_id", "honorific_senders", "casual_senders", room_style.alias("room_style"), relation.alias("relationship"))


# ---- abuse and sentiment ---------------------------------------------------------------

def profanity_stats(cells: DataFrame, totals: DataFrame) -> DataFrame:
    d = cells.groupBy("room_id").agg(
        F.sum("profanity_hits").alias("hits"), F.sum("profane_messages").alias("messages_with_hits")
    )
    return d.join(totals.select("room_id", "total_messages"), ROOM).select(
        "room_id", "hits", "messages_with_hits",
        percent(F.col("messages_with_hits"), F.col("total_messages"), 2).alias("per_100_messages"),
    )


def profanity_senders(cells: DataFrame, k: int = 8) -> DataFrame:
    d = cells.groupBy("room_id", "sender").agg(
        F.sum("profanity_hits").alias("hits"), F.sum("profane_messages").alias("messages_with_hits")
    ).filter("hits > 0")
    return top_k(d, ROOM, [F.desc("hits"), F.desc("messages_with_hits"), F.asc("sender")], k)


def daily_sentiment(cells: DataFrame, days: DataFrame) -> DataFrame:
    """Shares and energy of every active day; a day without scored text is neutral."""
    s = cells.groupBy("room_id", "day").agg(*[F.sum(c).alias(f"_{c}") for c in ("positive", "negative", "neutral")])
    d = days.select("room_id", "day").join(s, ["room_id", "day"], "left").na.fill(0)
    total = F.col("_positive") + F.col("_negative") + F.col("_neutral")
    pos, neg = percent(F.col("_positive"), total), percent(F.col("_negative"), total)
    energy = F.when(total > 0, half_up((F.col("_positive") - F.col("_negative")) / total * 100.0)).otherwise(F.lit(0.0))
    return d.select(
        "room_id", "day", pos.alias("positive"), neg.alias("negative"),
        F.when(total > 0, half_up(F.lit(100.0) - pos - neg, 1)).otherwise(F.lit(100.0)).alias("neutral"),
        energy.alias("energy"),
    )


def sentiment_stats(scored: DataFrame) -> DataFrame:
    """scored(room_id, sender, label in positive/negative/neutral) -> shares per room."""
    n = F.count("*")
    c = lambda l: F.count_if(F.col("label") == l)
    return scored.groupBy("room_id").agg(
        n.alias("sample"), percent(c("positive"), n).alias("positive_percent"),
        percent(c("negative"), n).alias("negative_percent"), percent(c("neutral"), n).alias("neutral_percent"),
        half_up((c("positive") - c("negative")) / n * 100.0, 1).alias("compound"),
    )


def sentiment_by_sender(scored: DataFrame, k: int = 12) -> DataFrame:
    n = F.count("*")
    d = scored.groupBy("room_id", "sender").agg(
        n.alias("sample"), percent(F.count_if(F.col("label") == "positive"), n).alias("positive_percent"),
        percent(F.count_if(F.col("label") == "negative"), n).alias("negative_percent"),
    )
    return top_k(d, ROOM, [F.desc("sample"), F.desc("positive_percent"), F.asc("sender")], k)


def toxicity_from_scores(scored: DataFrame) -> DataFrame:
    """scored(room_id, label, score): mean toxic percent and texts at 50 or more."""
    p = scored.select("room_id", tone_fn.toxic_percent(F.col("label"), F.col("score")).alias("p"))
    d = p.groupBy("room_id").agg(
        F.count("*").alias("sample"),
        # tenths summed as integers: the mean does not depend on the order of the rows
        half_up(F.sum(half_up(F.col("p") * 10.0).cast("bigint")) / F.count("*") / 10.0, 1).alias("toxic_percent"),
        F.count_if(F.col("p") >= 50).alias("toxic_messages"),
    )
    return d.withColumn("neutral_percent", half_up(F.lit(100.0) - F.col("toxic_percent"), 1))


def toxicity_from_lexicon(texts: DataFrame) -> DataFrame:
    """Share of texts with any abusive pattern (no model at hand)."""
    n = F.count("*")
    d = texts.groupBy("room_id").agg(
        n.alias("sample"), F.count_if(tone_fn.is_profane(F.col("msg"))).alias("toxic_messages")
    )
    d = d.withColumn("toxic_percent", percent(F.col("toxic_messages"), F.col("sample")))
    return d.withColumn("neutral_percent", half_up(F.lit(100.0) - F.col("toxic_percent"), 1))
