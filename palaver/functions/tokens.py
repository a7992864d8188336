"""Tokens of a text and quality predicates for terms (column expressions)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions.text import collapse_repeats, normalise

Tokenizer = Callable[[Column], Column]


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key)


def canonical(term: Column) -> Column:
    """Lower-case Latin words; well-known brand names get their usual Hangul spelling."""
    low = F.lower(term)
    return F.when(term.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*$"), _lookup(lex.CANONICAL_TERMS, low)).otherwise(term)


# a word with at least one letter; linear in the text (possessive, anchored at word starts)
_WORD = "(?<![가-힣A-Za-z0-9])[0-9]*+[가-힣A-Za-z][가-힣A-Za-z0-9]*+"
_BRAND = "(?i)" + "|".join(lex.CANONICAL_TERMS)


def tokens(text: Column, extra: Tokenizer | None = None) -> Column:
    """Distinct tokens in order: words of 2-32 characters with a letter, each followed

    by its stem when six or more Hangul letters are glued together. ``extra`` is the
    hook for a morphological analyser; its tokens come first.

    One regex cuts the whole text; per-word work is limited to cheap string tests, and
    the rare cases (brand names, glued Hangul) are entered only by texts that have them.
    Words are found in the text itself: what ``normalise`` turns into blanks is no part of a
    word, and rewriting it costs several times the search.
    """
    ascii_lower = lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(t)
    words = F.transform(F.regexp_extract_all(collapse_repeats(text), F.lit(_WORD), 0), ascii_lower)
    words = F.filter(words, lambda t: F.length(t).between(2, 32))
    spelled = F.filter(F.transform(words, lambda t: _lookup(lex.CANONICAL_TERMS, t)), lambda t: F.length(t) >= 2)
    words = F.when(text.rlike(_BRAND), spelled).otherwise(words)
    pair = lambda t: F.array(
        t,
        F.when(
            t.rlike("[가-힣]{6,}") & (F.length(F.regexp_replace(t, lex.GLUED_ENDING, "")) >= 2),
            canonical(F.regexp_replace(t, lex.GLUED_ENDING, "")),
        ),
    )
    found = F.when(
        text.rlike("[가-힣]{6,}"), F.array_compact(F.flatten(F.transform(words, pair)))
    ).otherwise(words)
    if extra is not None:
        found = F.concat(F.coalesce(extra(normalise(text)), F.array().cast("array<string>")), found)
    return F.array_distinct(found)


def normalise_term(term: Column) -> Column:
    """Topic term: canonical spelling, alias, trailing particle removed."""
    t = canonical(F.trim(term))
    stem = F.regexp_replace(t, lex.PARTICLE, "")
    stripped = F.when((F.length(t) > 2) & t.rlike(lex.PARTICLE) & (F.length(stem) >= 2), stem).otherwise(t)
    known = F.create_map(*[F.lit(x) for kv in lex.TERM_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, t), F.try_element_at(known, stripped), stripped)


_ENDING = lex.CHAT_ENDING[:-1]
# drop the ending that starts leftmost, but only if two characters remain
_STEM = f"^(?!.?{_ENDING}$)(.{{2,}}?){_ENDING}$"
_NOISE = r"^\d{1,4}$|^[A-Za-z]{1,3}$|[_/]|^[ㄱ-ㅎㅏ-ㅣ]+$|^(?=.*[^A-Za-z])[^ ]{8,}$"
# four or more Latin letters alone: noise by none of these patterns, and told sooner
_PLAIN_WORD = r"^[A-Za-z]{4,}+\z"


def discourse_stem(term: Column) -> Column:
    """Up to two sentence endings removed."""
    return F.regexp_replace(F.regexp_replace(term, _STEM, "$1"), _STEM, "$1")


def _has_ending(term: Column) -> Column:
    """Endings are Hangul, so plain ASCII words skip the stem patterns."""
    return F.octet_length(term) != F.length(term)


def _small_talk(stop_terms: Iterable[str]) -> list[str]:
    return list(dict.fromkeys([*lex.DISCOURSE_TERMS, *stop_terms, ""]))


def is_discourse(term: Column, stop_terms: Iterable[str] = ()) -> Column:
    """Small talk, also after its sentence endings are removed."""
    words = _small_talk(stop_terms)
    return term.isin(words) | (_has_ending(term) & discourse_stem(term).isin(words))


def is_noise(term: Column, stop_terms: Iterable[str] = ()) -> Column:
    """Single terms of no use as a keyword: one pattern, one word list, one stem test."""
    words = _small_talk(stop_terms)
    listed = [*words, *lex.HANGUL_FRAGMENTS, *lex.AMBIGUOUS_TERMS]
    return (
        (F.length(term) < 2)
        | term.isin(listed)
        | F.lower(term).isin(*lex.NOISE_LATIN)
        | (~term.rlike(_PLAIN_WORD) & term.rlike(_NOISE))
        | (_has_ending(term) & discourse_stem(term).isin(words))
    )


def is_noise_phrase(label: Column, stop_terms: Iterable[str] = ()) -> Column:
    """Labels with blanks are noise when every word is small talk or a fragment."""
    weak = lambda p: is_discourse(p, stop_terms) | p.isin(*lex.HANGUL_FRAGMENTS)
    return F.when(label.contains(" "), F.forall(F.split(label, " "), weak)).otherwise(is_noise(label, stop_terms))


def is_stutter(a: Column, b: Column) -> Column:
    """Word pairs that repeat themselves or hold a filler."""
    nested = a.startswith(b) | b.startswith(a)
    return F.when(
        nested, (a == b) | (F.abs(F.length(a) - F.length(b)) <= 4)
    ).otherwise(a.isin(*lex.WEAK_BIGRAM_PARTS) | b.isin(*lex.WEAK_BIGRAM_PARTS))


def pairs_up(a: Column, b: Column) -> Column:
    """May two neighbouring tokens form a bigram?"""
    return (
        (F.length(a) >= 2) & (F.length(b) >= 2) & (F.length(a) + F.length(b) <= 28)
        & (F.translate(a, "0123456789", "") != "") & (F.translate(b, "0123456789", "") != "")
    )


def is_generic_lead(term: Column) -> Column:
    t = F.trim(term)
    return t.isin(*lex.GENERIC_LEADS) | F.lower(F.element_at(F.split(t, r"\s+"), 1)).isin(*lex.GENERIC_LEADS)
