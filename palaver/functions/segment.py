"""Glued Hangul cut by a dictionary: the best path over scored words (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.tokens import Tokenizer

LONGEST = 8  # characters of a dictionary word
RUN = "[가-힣]{3,32}"


def best_cut(run: Column, words: Column, longest: int = LONGEST) -> Column:
    """Words of the path through ``run`` with the largest sum of score times length.

    ``words`` is a map of word to score. Characters outside words count nothing. Equal sums go to
    fewer words, then to the later words in binary order. A fold over the characters keeps the best
    path to each of them, so the work is length times ``longest``.
    """
    start = F.array(F.struct(
        F.lit(0.0).alias("sum"), F.lit(0).alias("few"), F.array().cast("array<string>").alias("words")
    ))

    def step(best: Column, end: Column) -> Column:
        at = lambda size: F.element_at(best, (end - size + 1).cast("int"))
        word = lambda size: F.substring(run, (end - size + 1).cast("int"), size.cast("int"))
        sizes = F.filter(F.sequence(F.lit(1), F.least(F.lit(longest), end)), lambda n: F.map_contains_key(words, word(n)))
        ending = F.transform(sizes, lambda n: F.struct(
            (at(n)["sum"] + F.try_element_at(words, word(n)) * n).alias("sum"), (at(n)["few"] - 1).alias("few"),
            F.concat(at(n)["words"], F.array(word(n))).alias("words"),
        ))
        return F.array_append(best, F.array_max(F.concat(F.array(at(F.lit(1))), ending)))

    path = F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step)
    return F.element_at(path, -1)["words"]


def dictionary_tokenizer(words: Column, longest: int = LONGEST) -> Tokenizer:
    """A tokenizer hook: the dictionary words in the glued Hangul of a text, in order."""
    def cut(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(f"(?<![가-힣]){RUN}(?![가-힣])"), 0)
        return F.when(words.isNotNull(), F.flatten(F.transform(runs, lambda r: best_cut(r, words, longest))))

    return cut
