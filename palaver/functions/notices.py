"""System notices inside message texts (classification, split, search tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions.frames import once
from palaver.functions.text import squeeze, trim_all, utf16_length


def normalise_line(line: Column) -> Column:
    return squeeze(F.regexp_replace(trim_all(line), '^"+|"+$', ""))


def notice_kind(line: Column) -> Column:
    """Kind of one normalised line, NULL for user text; first match wins."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(lex.NOTICE_PATTERNS):
        hit = line.rlike(pattern)
        if name == "kick":
            hit = hit & ~line.rlike(lex.GIFT_LINE)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return kind


def search_tag(line: Column) -> Column:
    """``#tag`` (at most 80 characters) of a search notice; NULL when it has none."""
    raw = F.regexp_extract(line, r"^샵검색[:\s]+(.+)$", 1)
    raw = F.when(raw == "", F.regexp_extract(line, r"^(#\S{2,80})$", 1)).otherwise(raw)
    raw = F.substring(trim_all(raw), 1, 80)
    tag = F.when(raw.startswith("#"), raw).otherwise(F.concat(F.lit("#"), raw))
    return F.when((raw != "") & (F.length(tag) >= 2), tag)


def marked_lines(message: Column) -> Column:
    """ARRAY<STRUCT<raw, line, kind>> of the non-blank lines of a message.

    The line-wise path costs a dozen regexes, so it runs only when the message
    has several lines or a word that every notice contains.
    """
    clean = lambda l: normalise_line(
        F.regexp_replace(F.regexp_replace(l, f',[{lex.BLANK}]*"",[{lex.BLANK}]*"', ""), '"$', "")
    )
    entry = lambda raw, line, kind: F.struct(raw.alias("raw"), line.alias("line"), kind.alias("kind"))
    lines = F.filter(
        F.transform(F.split(message, "\n", -1), lambda l: F.struct(l.alias("raw"), clean(l).alias("line"))),
        lambda s: s["line"] != "",
    )
    full = F.transform(lines, lambda s: entry(s["raw"], s["line"], notice_kind(s["line"])))
    none = F.lit(None).cast("string")
    # cleaning takes blanks, quotes and commas only, so any other character stays
    some = message.rlike(f'[^{lex.BLANK}",]') | (clean(message) != "")
    plain = F.array_compact(F.array(F.when(some, entry(message, message, none))))
    return F.when(message.contains("\n") | message.rlike(lex.NOTICE_HINT), full).otherwise(plain)


def with_split(rows: DataFrame, message: str = "message") -> DataFrame:
    """Add user_text, notices and tags. Each step is a column of its own, computed once."""
    d = once(rows, "_marked", marked_lines(F.col(message)))
    found = F.filter("_marked", lambda s: s["kind"].isNotNull())
    user = trim_all(F.array_join(F.transform(F.filter("_marked", lambda s: s["kind"].isNull()), lambda s: s["raw"]), "\n"))
    tags = F.array_compact(F.transform(
        found, lambda s: F.when(s["kind"] == "shopSearch", search_tag(s["line"]))
    ))
    d = once(d, "_parts", F.struct(
        user.alias("user_text"), F.transform(found, lambda s: s["kind"]).alias("kinds"), tags.alias("tags")
    ))
    p = F.col("_parts")
    return d.select(
        *rows.columns, p["user_text"].alias("user_text"),
        collapse_tails(p["kinds"], p["user_text"] != "").alias("notices"), p["tags"].alias("tags"),
    )


def collapse_tails(kinds: Column, has_user_text: Column) -> Column:
    """With user text, all hidden/deleted tails count as a single ``hidden``."""
    moderation = lambda k: k.isin("hidden", "deleted")
    collapsed = F.filter(
        F.transform(
            kinds,
            lambda k, i: F.when(~moderation(k), k).when(
                ~F.exists(F.slice(kinds, 1, i), moderation), F.lit("hidden")
            ),
        ),
        lambda k: k.isNotNull(),
    )
    return F.when(has_user_text, collapsed).otherwise(kinds)


def is_boilerplate(text: Column) -> Column:
    """Welcome or house-rules copy-paste of open rooms."""
    t = squeeze(trim_all(text))
    size = utf16_length(t)
    return (F.length(text) >= 12) & (size >= 24) & (  # a character is two units at most
        t.rlike(lex.WELCOME_TEXT) | (t.rlike(lex.RULES_TEXT) & (size >= 48))
    )
