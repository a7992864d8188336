"""Tone scores of a single text: speech level, lexicon sentiment, abuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions.numeric import half_up
from palaver.functions.text import trim_all


def speech_level(text: Column) -> Column:
    t = trim_all(text)
    formal = t.rlike("|".join(lex.HONORIFIC))
    casual = t.rlike("|".join(lex.CASUAL))
    return (
        F.when(formal & ~casual, F.lit("honorific"))
        .when(casual & ~formal, F.lit("casual"))
        .otherwise(F.lit("neutral"))
    )


def sentiment_hits(text: Column) -> tuple[Column, Column, Column]:
    """(positive, negative, neutral) lexicon hits; neutral is 1 when there is no hit."""
    positive = F.regexp_count(text, F.lit(lex.POSITIVE_REACTION)) + F.regexp_count(text, F.lit("|".join(lex.POSITIVE_WORDS)))
    negative = F.regexp_count(text, F.lit("|".join(lex.NEGATIVE_WORDS)))
    return positive, negative, ((positive == 0) & (negative == 0)).cast("int")


def profanity_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"[{lex.BLANK}\\x{{200B}}-\\x{{200D}}]+", ""))


def squeezed_profanity_hits(t: Column, patterns: tuple[str, ...] = lex.PROFANITY) -> Column:
    """Non-overlapping hits of every pattern, summed over the patterns.

    One combined regex skips the clean majority of texts.
    """
    total = F.lit(0)
    for p in patterns:
        total = total + ((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("int")
    return F.when(t.rlike("|".join(patterns)), total).otherwise(F.lit(0))


def is_profane(text: Column, patterns: tuple[str, ...] = lex.PROFANITY) -> Column:
    return profanity_text(text).rlike("|".join(patterns))


def sentiment_label(label: Column, score: Column, binary: bool = False, floor: float = 0.72, family: str = "") -> Column:
    """Model label to positive / negative / neutral."""
    id_ = F.lower(label)
    pos, neg, neu = (F.lit(x) for x in ("positive", "negative", "neutral"))
    if binary:
        return (
            F.when(score < floor, neu)
            .when(id_.contains("pos") | (id_ == "label_1"), pos)
            .when(id_.contains("neg") | (id_ == "label_0"), neg)
            .otherwise(neu)
        )
    stars = F.regexp_extract(id_, r"^(\d)\s*stars?$", 1)
    out = F.when(stars.isin("0", "1", "2"), neg).when(stars == "3", neu).when(stars != "", pos)
    if family == "klue":
        out = out.when((id_ == "label_0") | id_.contains("neg"), neg).when(
            (id_ == "label_1") | id_.contains("neu"), neu
        )
    return (
        out.when(id_.contains("pos") | (id_ == "label_2"), pos)
        .when(id_.contains("neg") | (id_ == "label_0"), neg)
        .otherwise(neu)
    )


def toxic_percent(label: Column, score: Column) -> Column:
    id_ = F.lower(label)
    toxic = id_.contains("neg") | (id_ == "label_0") | id_.contains("toxic") | id_.contains("offensive")
    tenths = F.when(toxic, half_up(score * 1000.0)).otherwise(half_up((F.lit(1.0) - score) * 30.0))
    return tenths / 10.0
