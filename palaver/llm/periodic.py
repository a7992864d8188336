"""Periodic runs of words by the branching-tandem test over an enhanced suffix array.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same), at
least ``least`` words and ``times`` periods long, that no neighbouring word extends. Dropping a
run's words after its first period collapses the text.

1. Words become numbers. A run of that length lies wholly under repeated sequences of
   ``gram_of(least, times)`` words, so only the stretches under such sequences (found by a hash
   and a sort, for many documents at once) go on; a clash of hashes only lets more go on.
2. The suffixes of all stretches are sorted by doubling. The ranks of each doubling are kept:
   they give the LCP of neighbours and the common extension of two positions to the left.
3. Between two neighbours with LCP ``d`` two child ranges of one LCP interval meet. For each
   suffix ``i`` of the smaller range, the inverse suffix array says whether ``i + d`` or
   ``i - d`` lies in the other one: a branching square of period ``d``, which is the right end
   of exactly one run. No nodes are built.
4. Squares are rotated to the left as far as they go; of squares that span the same words the
   smallest period stays.

A document's work is n log n in its words, in one task; documents are independent, nothing is
shuffled.

Cases: a null or blank text has no words, no runs and an empty collapsed text; words are split
at blanks and the characters 9 to 13; rows are kept one by one, repeated or without id; a text
of any length is read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, text_of

LEAST = 24
TIMES = 3
WORDS = 200_000  # words handled at once (more if one text has more)
SPACES = "[\\x20\\x09-\\x0D]+"

Runs = np.ndarray  # rows (start, length, period)


def gram_of(least: int, times: int) -> int:
    """Longest sequence of words that must repeat all over a run."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


class Numbers(dict):
    """word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


# ---- stretches that can hold a run ---------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def repeated_stretches(numbers: np.ndarray, owner: np.ndarray, gram: int, least: int) -> np.ndarray:
    """(first, end) of the stretches whose words all lie under a sequence repeated in their document."""
    n = len(numbers)
    starts = n - gram + 1
    if starts < 2:
        return np.zeros((0, 2), np.int64)
    codes, keys = _mixed(numbers), np.zeros(starts, np.uint64)
    for k in range(gram):
        keys = keys * np.uint64(0x100000001B3) + codes[k: k + starts]
    keys += _mixed(owner[:starts] + (1 << 32))
    inside = np.flatnonzero(owner[:starts] == owner[gram - 1:])
    keys = keys[inside]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    at = inside[twice]
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + gram, -1)
    under = np.cumsum(depth[:-1]) > 0
    edge = np.ones(n + 1, bool)
    edge[1:n] = (under[1:] != under[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.flatnonzero(edge)
    spans = np.stack([cuts[:-1], cuts[1:]], 1)
    return spans[under[spans[:, 0]] & (spans[:, 1] - spans[:, 0] >= least)]


# ---- enhanced suffix array ---------------------------------------------------------


def doubled_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ (the last is the ISA).

    Equal ranks at a level mean equal symbols up to there; open suffixes alone are sorted again.
    """
    n = len(symbols)
    place = np.arange(n)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, step = [rank], 1
    alone = new & np.append(new[1:], True)
    left = order[~alone]
    while len(left):
        ahead = left + step
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[left] * (n + 1) + then + 1
        order = np.argsort(key, kind="stable")
        key, left = key[order], left[order]
        old = rank[left]
        place = np.arange(len(left))
        new, first = np.ones(len(left), bool), np.ones(len(left), bool)
        new[1:], first[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        inside = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[left] = old + inside
        levels.append(rank)
        left = left[~(new & np.append(new[1:], True))]
        step *= 2
    return levels


def neighbour_lcp(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """LCP of each suffix in order with the one before it (the first: 0)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        common[1:] += step
        a += step
        b += step
    return common


def to_the_left(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before positions ``a`` equal those before ``b`` (a < b)."""
    a, b = a.copy(), b.copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        step = 1 << k
        inside = a >= step
        same = inside & (levels[k][np.where(inside, a - step, 0)] == levels[k][np.where(inside, b - step, 0)])
        step = np.where(same, step, 0)
        common += step
        a -= step
        b -= step
    return common


def child_ranges(common: np.ndarray) -> np.ndarray:
    """Rows (d, left, middle, right): suffixes of ranks [left, middle) and [middle, right) have LCP d > 0.

    Each pair of suffixes with LCP d lies on both sides of exactly one row: the left side holds all
    children of an interval before a boundary, the right side the child after it.
    """
    values = common.tolist()
    n = len(values)
    left, right = [0] * n, [n] * n
    stack = [0]
    for k in range(1, n):
        h = values[k]
        while stack and values[stack[-1]] >= h:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    middle = np.flatnonzero(common > 0)
    return np.stack([common[middle], np.array(left, np.int64)[middle], middle, np.array(right, np.int64)[middle]], 1)


def branching_squares(order: np.ndarray, isa: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """(i, d): words i to i + d and i + d to i + 2 d are the same, and cannot be rotated to the right."""
    n = len(order)
    d, left, middle, right = ranges.T
    before = middle - left <= right - middle  # the smaller child is the left one
    low, size = np.where(before, left, middle), np.minimum(middle - left, right - middle)
    far, end = np.where(before, middle, left), np.where(before, right, middle)
    row = np.repeat(np.arange(len(d)), size)
    rank = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at, depth = order[rank], d[row]
    found = []
    for other, first in ((at + depth, at), (at - depth, at - depth)):
        inside = (other >= 0) & (other < n)
        r = isa[np.where(inside, other, 0)]
        hit = inside & (r >= far[row]) & (r < end[row])
        found.append(np.stack([first[hit], depth[hit]], 1))
    return np.concatenate(found)


def runs_of(symbols: np.ndarray, least: int, times: int) -> Runs:
    """All runs, by start and period."""
    if not len(symbols):
        return np.zeros((0, 3), np.int64)
    levels = doubled_ranks(symbols)
    isa = levels[-1]
    order = np.empty(len(isa), np.int64)
    order[isa] = np.arange(len(isa))
    squares = branching_squares(order, isa, child_ranges(neighbour_lcp(levels, order)))
    i, d = squares.T
    start = i - to_the_left(levels, i, i + d)
    runs = np.stack([start, i + 2 * d - start, d], 1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # of squares over the same words, the smallest period
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    runs = runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


# ---- documents -----------------------------------------------------------------------


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[Runs]:
    """Runs of each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    known = Numbers()
    numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    spans = repeated_stretches(numbers, owner, gram_of(least, times), least)
    lengths = spans[:, 1] - spans[:, 0]
    span = np.repeat(np.arange(len(spans)), lengths)
    position = np.arange(len(span)) + np.repeat(spans[:, 0] - (np.cumsum(lengths) - lengths), lengths)
    runs = runs_of(span * (len(known) + 1) + numbers[position], least, times)  # no symbol is in two stretches
    at = position[runs[:, 0]]
    begin = np.cumsum(sizes) - sizes
    whose = owner[at]
    runs = np.stack([at - begin[whose], runs[:, 1], runs[:, 2]], 1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0], whose))]
    return np.split(runs, np.cumsum(np.bincount(whose, minlength=len(texts)))[:-1]) if texts else []


def collapse(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words that are in no run or in the first period of every run that holds them."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(least: int, times: int):
    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(texts, least, times)
        kept = [b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass") for words, runs in zip(texts, found)]
        every = np.concatenate(found)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
        runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in every.T], fields=list(_RUN)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column("doc_id"), batch.column("text")):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                ids.append(i.as_py())
                texts.append(words)
                size += len(words)
                if size >= WORDS:
                    yield answer(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield answer(ids, texts)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period by start and period), collapsed text: one row per document."""
    source = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(
        _finder(least, times), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period, ties to the smaller start, then period.

    Quotients of whole numbers below 2^26 that differ, differ as doubles too.
    """
    marked = F.transform(runs, lambda r: F.struct(
        (r["length"].cast("double") / r["period"]).alias("times"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("run")
    ))
    return F.array_max(marked)["run"]


def listed(runs: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def repeating_tail(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose CRC-32 ends in 0, its words from a place on repeat a period of its own."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10).cast("long")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(w[(a + (i - a) % p).cast("int")])), " ")

    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return F.when(crc % 10 == 0, tail).otherwise(F.coalesce(text, F.lit("")))
