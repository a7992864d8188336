"""Message features: the one wide projection every later table reads.

A pure projection (no shuffle); column pruning drops whatever a query does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions import notices as notice_fn
from palaver.functions import text as text_fn
from palaver.functions import tone as tone_fn
from palaver.functions.frames import once


def attachment_markers(text: Column) -> Column:
    """Markers contained in the text; a photo bundle counts as a photo."""
    marks = F.array(*[F.lit(m) for m in lex.ATTACHMENT_MARKERS])
    return F.filter(marks, lambda m: text.contains(m))


def keyword_eligible(text: Column, markers: Column) -> Column:
    """Texts worth tokenising: letters present, more than attachment markers."""
    t = text_fn.trim_all(text)
    letters = F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    only_one = (F.size(markers) == 1) & (t == F.element_at(markers, 1))
    short_marker = (
        (F.size(markers) > 0)
        & (text_fn.utf16_length(t) <= 16)
        & ~letters.rlike("[가-힣A-Za-z]{3,}")
    )
    return (
        (text_fn.utf16_length(text) >= 2) & text.rlike(lex.LETTER) & (t != "") & ~F.coalesce(only_one, F.lit(False)) & ~short_marker
    )


def since(messages: DataFrame, day: str | None) -> DataFrame:
    """Inclusive lower date bound, written on ``ts`` so that it reaches the scan."""
    if day is None:
        return messages
    return messages.filter(F.col("ts") >= F.lit(day).cast("timestamp_ntz"))


def message_features(messages: DataFrame) -> DataFrame:
    """messages(room_id, line, ts, sender, message) -> one row per message with flags."""
    d = notice_fn.with_split(messages)
    user = F.col("user_text")
    d = d.withColumn("msg", F.when(user != "", user).otherwise(F.col("message"))).withColumn(
        "is_system", (F.size("notices") > 0) & (user == "")
    )
    msg, trimmed = F.col("msg"), text_fn.trim_all(F.col("msg"))
    d = d.withColumn("markers", attachment_markers(msg)).withColumn("domains", text_fn.domains(msg))
    size = text_fn.utf16_length(msg)
    short = text_fn.utf16_length(trimmed)
    return d.select(
        "room_id", "line", "ts", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"),
        "sender", "message", "msg", "is_system", "notices", "tags", "markers", "domains",
        size.alias("chars"),
        (F.size("domains") > 0).alias("has_link"),
        (F.size("markers") > 0).alias("has_attachment"),
        (msg.contains("?") | msg.contains("？")).alias("has_question"),
        msg.rlike(lex.LAUGH).alias("is_laugh"),
        trimmed.rlike(lex.PURE_LAUGH).alias("is_pure_laugh"),
        short.between(1, 3).alias("is_short"),
        msg.rlike(lex.PLAN_SIGNAL).alias("has_plan"),
        (~msg.rlike(text_fn.PLAIN_TEXT) & msg.rlike(lex.PICTOGRAPH)).alias("has_emoji"),
        F.hour("ts").isin(*lex.NIGHT_HOURS).alias("is_night"),
        F.dayofweek("ts").isin(1, 7).alias("is_weekend"),
        notice_fn.is_boilerplate(msg).alias("is_boilerplate"),
        keyword_eligible(msg, F.col("markers")).alias("_eligible"),
    ).withColumn("keyword_text", F.when(
        ~F.col("is_system") & ~F.col("is_boilerplate") & F.col("_eligible"), F.col("msg")
    )).drop("_eligible")


def scored_context(features: DataFrame) -> DataFrame:
    """Scrubbed user texts with their weight as a context sample."""
    user = features.filter(~F.col("is_system")).select("*", text_fn.scrub(F.col("msg")).alias("text"))
    flag = lambda c, w: F.when(F.col(c), w).otherwise(0)
    size = text_fn.utf16_length(F.col("text"))
    score = (
        F.least(F.lit(40), size) + flag("has_plan", 18) + flag("has_question", 10)
        + flag("has_attachment", 10) + flag("has_link", 8) + flag("is_laugh", 5)
    )
    d = user.select(
        "room_id", "day", "line", "sender", "text", score.alias("score"), size.alias("length"),
        "has_plan", "has_question", "has_attachment", "has_link", "is_laugh",
    )
    return d.filter((F.col("length") >= 4) & ~F.col("text").rlike(lex.PURE_LAUGH))


def with_tone(features: DataFrame) -> DataFrame:
    """Add speech level, lexicon sentiment and abuse hits of user texts."""
    styled = ~F.col("is_system") & ~F.col("is_boilerplate")
    features = once(features, "_squeezed", F.when(styled, tone_fn.profanity_text(F.col("msg"))))
    pos, neg, neu = tone_fn.sentiment_hits(F.col("msg"))
    only = lambda c: F.when(styled, c).otherwise(F.lit(0))
    return features.select(
        *[c for c in features.columns if c != "_squeezed"],
        F.when(styled, tone_fn.speech_level(F.col("msg"))).alias("style"),
        only(pos).alias("positive"), only(neg).alias("negative"), only(neu).alias("neutral"),
        only(tone_fn.squeezed_profanity_hits(F.col("_squeezed"))).alias("profanity"),
    )
