"""Text helpers as column expressions (no Python in the hot path)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex


_BLANKS = "\t\n\x0b\f\r \u00a0" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Texts of ASCII, Hangul letters and syllables alone, told by one run over short ranges.
PLAIN_TEXT = r"^[\x00-\x7F\x{3131}-\x{318E}\x{AC00}-\x{D7A3}]*+\z"


def trim_all(text: Column) -> Column:
    """Trim every Unicode blank, not only the ASCII space."""
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; single spaces are left alone."""
    return F.regexp_replace(text, f"[{lex.BLANK}]{{2,}}|[{lex.BLANK}&&[^ ]]", " ")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units (a pictograph counts twice)."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("bigint")


def mask_name(name: Column) -> Column:
    """First character, one to six stars, last character."""
    n = trim_all(name)
    size = F.length(n)
    stars = F.greatest(F.lit(1), F.least(size - 2, F.lit(6)))
    return (
        F.when(size == 0, F.lit("?"))
        .when(size <= 2, F.concat(F.substring(n, 1, 1), F.lit("*")))
        .otherwise(F.concat(F.substring(n, 1, 1), F.repeat(F.lit("*"), stars), F.right(n, F.lit(1))))
    )


def room_name_from_file(path: Column, default: str = "채팅방") -> Column:
    """Room name out of ``<Messenger>Talk_Chat_<room>_<timestamp>.csv``."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(csv|txt)$", "")
    stamp = r"_\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}$"
    room = trim_all(F.regexp_replace(F.regexp_replace(base, r"(?i)^[a-z]+talk_(chat_)?", ""), stamp, ""))
    fallback = trim_all(F.regexp_replace(base, stamp, ""))
    cut = F.when(F.length(room) > 120, F.concat(F.substring(room, 1, 117), F.lit("..."))).otherwise(room)
    return F.when(room != "", cut).when(fallback != "", fallback).otherwise(F.lit(default))


def safe_file_name(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.length(name) > 80, F.concat(F.substring(name, 1, 77), F.lit("..."))).otherwise(name)


def scrub(text: Column) -> Column:
    """Replace URLs, e-mail addresses and long numbers by neutral words."""
    found = text
    for (pattern, word), marks in zip(lex.SCRUB, (("://", "."), ("@",), ())):
        out = F.regexp_replace(found, pattern, word)
        # a pattern is only tried on texts with a character that each of its matches holds
        found = F.when(reduce(or_, [text.contains(m) for m in marks]), out).otherwise(found) if marks else out
    return trim_all(squeeze(found))


def evidence(text: Column, limit: int = 56) -> Column:
    clean = scrub(text)
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))).otherwise(clean)


def domains(text: Column) -> Column:
    """Host names of the links in a text; cheap substring test before the regex."""
    urls = F.regexp_extract_all(text, F.lit(lex.URL), 0)
    hosts = F.transform(
        urls,
        lambda u: F.regexp_replace(
            F.lower(F.try_parse_url(F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)), F.lit("HOST"))),
            r"^www\.", "",
        ),
    )
    return F.when(
        (text.contains("://") | text.contains(".")) & text.rlike(lex.LINK_HINT), F.filter(hosts, lambda h: h.isNotNull())
    ).otherwise(F.array().cast("array<string>"))


def emojis(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lex.EMOJI), 0)


def _category_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in lex.EMOJI_CATEGORY.items() for x in pair])


def emoji_category(emoji: Column) -> Column:
    return F.coalesce(F.try_element_at(_category_map(), emoji), F.lit("neutral"))


def hashtags(text: Column) -> Column:
    tags = F.array_distinct(F.regexp_extract_all(text, F.lit(lex.HASHTAG), 1))
    return F.filter(tags, lambda t: F.length(t).between(2, 24))


def script_counts(text: Column) -> tuple[Column, Column]:
    """(Hangul letters, Latin letters)."""
    return F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z]"))


def collapse_repeats(text: Column, repeat_to: int = 2) -> Column:
    """Four or more of one character become ``repeat_to``."""
    return F.regexp_replace(text, r"(\S)\1{3,}", "$1" * repeat_to)


def normalise(text: Column, keep_english=True, keep_numbers=True, keep_punctuation=False, repeat_to=2) -> Column:
    """Collapse long repeats, keep letters and digits, squeeze blanks.

    Input must be NFC; ``operators.text_nfc.compose`` brings decomposed rows there.
    """
    allowed = "가-힣" + ("a-zA-Z" if keep_english else "") + ("0-9" if keep_numbers else "")
    if keep_punctuation:
        allowed += ".,?!"
    if repeat_to > 0:
        text = collapse_repeats(text, repeat_to)
    return F.trim(F.regexp_replace(text, f"[^{allowed}]+", " "))


def embedding_text(text: Column, prefix: str | None) -> Column:
    """Model prefix (``query:``), unless the text already carries one."""
    if not prefix:
        return text
    has = F.ltrim(text).rlike("^(query:|passage:)")
    return F.when(has, text).otherwise(F.concat(F.lit(prefix + " "), text))


def json_object(text: Column) -> Column:
    """The JSON object inside a noisy answer (fences, trailing commas); NULL if none."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.when(body != "", F.try_parse_json(body))
