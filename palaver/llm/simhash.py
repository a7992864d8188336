"""Near-duplicates by SimHash, with a self-join of a binary trie of fingerprints.

Fingerprints: words in lower-cased A-Z, shingles of three words, XXH64 of each, and a bit is
set if more than half of the hashes have it. Documents with one fingerprint become one node.

Links (at most ``budget`` differing bits): of ``budget + 1`` blocks of bits, two linked
fingerprints agree in at least one. For each block the fingerprints are turned so that it
comes first, and the trie below a block's value is joined with itself: pairs of trie nodes go
down together, bit by bit; a pair adds one to its differing bits where it parts, and leaves
when the budget is passed. Sorted fingerprints are the trie; a node is a range of them, so
all pairs of a level move at once.

A block value with more than ``limit`` fingerprints is first split by the next bits into
pairs of nodes that are traversed by tasks of their own, as often as needed. Every unit
hands on links to its smallest member only (as many as it has members), and the links of all
units are joined into components by alternating stars.

Cases: null or blank text has fingerprint zero and is linked like any other; a null id never
names a component unless all ids of it are null; repeated rows are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, digest, materialise, only, text_of
from palaver.operators.components import components

SHINGLE = 3
SEED = 42
BUDGET = 2
LIMIT = 16_384  # fingerprints in one unit of the join
STEP = 6  # bits by which a large unit is split
FRONTIER = 500_000  # node pairs that move at once

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = np.arange(8) * 256


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    n = max(1, len(words) - width + 1)
    return fingerprint_of(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(values.view(np.int64))], ["doc_id", "digest", "fp"]
        )


# ---- links -----------------------------------------------------------------


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + 1 blocks."""
    edges = [round(64 * k / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


UNIT = ["block", "top", "left", "right", "spent"]


def _units(nodes: DataFrame, budget: int) -> DataFrame:
    """Each fingerprint once per block: its unit, its side there, and the bits still to compare."""
    turns = F.array(*[
        F.struct(
            F.lit(k).alias("block"), F.shiftrightunsigned(_turned(F.col("fp"), at), 64 - width).alias("top"),
            _turned(F.col("fp"), at).bitwiseAND(F.lit((1 << (64 - width)) - 1)).alias("rest"), F.lit(width).alias("depth"),
        ) for k, (at, width) in enumerate(_blocks(budget))
    ])
    zero = F.lit(0).cast("long")
    return nodes.select("fp", F.explode(turns).alias("t")).select(
        "t.block", "t.top", zero.alias("left"), zero.alias("right"), F.lit(0).alias("spent"), F.lit(0).alias("side"),
        "t.depth", "t.rest", "fp",
    )


def _split(units: DataFrame, budget: int, step: int) -> DataFrame:
    """Units by the next ``step`` bits: every pair of nodes below that is within the budget."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= budget])
    mine = F.expr(f"shiftrightunsigned(rest, 64 - depth - {step})")
    spread = units.withColumn("mine", mine).withColumn("mask", F.explode(masks)).where(
        F.col("spent") + F.bit_count("mask") <= budget
    )
    other = F.col("mine").bitwiseXOR(F.col("mask"))
    alike = F.col("left") == F.col("right")
    down = lambda at, bits: F.shiftleft(at, step).bitwiseOR(bits)
    first = F.when(alike, F.least("mine", other)).when(F.col("side") == 0, F.col("mine")).otherwise(other)
    second = F.when(alike, F.greatest("mine", other)).when(F.col("side") == 0, other).otherwise(F.col("mine"))
    side = F.when(alike, (F.col("mine") > other).cast("int")).otherwise(F.col("side"))
    return spread.select(
        "block", "top", down(F.col("left"), first).alias("left"), down(F.col("right"), second).alias("right"),
        (F.col("spent") + F.bit_count("mask")).cast("int").alias("spent"), side.alias("side"),
        (F.col("depth") + step).alias("depth"),
        F.expr(f"rest & (shiftleft(1L, 64 - depth - {step}) - 1)").alias("rest"), "fp",
    )


def traverse(rest: np.ndarray, starts: np.ndarray, budget: int, frontier: int = FRONTIER) -> np.ndarray:
    """Index pairs within the budget. ``starts`` has rows (a0, a1, b0, b1, differing bits), ranges

    of the sorted ``rest``; equal ranges are joined with themselves.
    """
    n = len(rest)
    highest = int(rest.max()).bit_length() if n else 0
    ones = {}
    found = []
    stack = [(highest - 1, starts)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > frontier:
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        a0, a1, b0, b1, spent = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if bit < 0:
            single = np.ones(len(pairs), bool)
        if single.any():
            i, j, s = a0[single], b0[single], spent[single]
            below = np.uint64((1 << (bit + 1)) - 1)  # bits that are still to compare
            near = (i != j) & (s + np.bitwise_count((rest[i] ^ rest[j]) & below) <= budget)
            found.append(np.stack([i[near], j[near]], 1))
            pairs = pairs[~single]
            a0, a1, b0, b1, spent = pairs.T
        if not len(pairs):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((rest >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        alike = (a0 == b0) & (a1 == b1)
        children = np.concatenate([
            np.stack([a0, am, b0, bm, spent], 1), np.stack([am, a1, bm, b1, spent], 1),
            np.stack([a0, am, bm, b1, spent + 1], 1), np.stack([am, a1, b0, bm, spent + 1], 1)[~alike],
        ])
        a0, a1, b0, b1, spent = children.T
        live = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
        stack.append((bit - 1, children[live]))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def smallest_linked(n: int, pairs: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of n items, the smallest value reachable over the pairs."""
    label = value.copy()
    i, j = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def _joiner(budget: int):
    names = ["fp", "to"]

    def join(rows: pa.Table) -> pa.RecordBatch | None:
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in UNIT], 1)
        side = rows.column("side").to_numpy()
        rest = rows.column("rest").to_numpy().view(np.uint64)
        fp = rows.column("fp").to_numpy()
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
        twos = np.concatenate([[0], np.cumsum(side)])
        mid = hi - (twos[hi] - twos[lo])
        alike = keys[lo, 2] == keys[lo, 3]
        starts = np.stack([lo, np.where(alike, hi, mid), np.where(alike, lo, mid), hi, keys[lo, 4]], 1)
        starts = starts[(starts[:, 1] > starts[:, 0]) & (starts[:, 3] > starts[:, 2]) & (~alike | (hi - lo > 1))]
        if not len(starts):
            return None
        pairs = traverse(rest, starts.astype(np.int64), budget)
        if not len(pairs):
            return None
        used, local = np.unique(pairs, return_inverse=True)
        least = smallest_linked(len(used), local.reshape(-1, 2), fp[used])
        linked = fp[used] != least
        return pa.RecordBatch.from_arrays([pa.array(fp[used][linked]), pa.array(least[linked])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = np.stack([held.column(c).to_numpy().astype(np.int64) for c in UNIT], 1)
            open_ = np.flatnonzero((keys != keys[-1]).any(1))
            whole = int(open_[-1]) + 1 if len(open_) else 0  # the last unit may go on in the next batch
            if whole:
                out = join(held.slice(0, whole))
                held = held.slice(whole)
                if out is not None:
                    yield out
        if held is not None:
            out = join(held)
            if out is not None:
                yield out

    return run


def links(nodes: DataFrame, budget: int = BUDGET, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(fp, to): links that join all fingerprints within the budget of each other."""
    units = _units(nodes, budget)
    ready: list[DataFrame] = []
    while True:
        units = materialise(units, "trie-units")
        sizes = units.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("n_right"), F.first("depth").alias("depth"))
        large = materialise(sizes.where((F.col("n") > limit) & (F.col("depth") + step <= 64)).select(*UNIT), "trie-large")
        if large.isEmpty():
            ready.append(units)
            break
        ready.append(units.join(large, UNIT, "left_anti"))
        units = _split(units.join(large, UNIT, "left_semi"), budget, step)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    dealt = every.repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "rest")
    return dealt.select(*UNIT, "side", "rest", "fp").mapInArrow(_joiner(budget), "fp long, to long").distinct()


# ---- documents -----------------------------------------------------------------


def near_groups(docs: DataFrame, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """doc_id, digest, fp, component_id, keeper_digest: one row per document."""
    source = columns_of(docs, "doc_id", "text").select("doc_id", digest().alias("digest"), text_of().alias("text"))
    prints = materialise(source.mapInArrow(_fingerprints, "doc_id long, digest long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    nodes = materialise(prints.groupBy("fp").agg(first), "fingerprint-nodes")
    stars = components(links(nodes.select("fp"), budget, limit), "fp", "to")
    members = materialise(
        stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct()),
        "near-members",
    )
    firsts = members.join(nodes, "fp").groupBy("root").agg(F.min("first").alias("first"))
    joined = members.join(materialise(firsts, "near-firsts"), "root").select("fp", F.col("first").alias("shared"))
    named = materialise(
        nodes.join(joined, "fp", "left").select("fp", F.coalesce("shared", "first").alias("first")), "near-names"
    )
    return prints.join(named, "fp").select(
        "doc_id", "digest", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("keeper_digest")
    )


def drop_near_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One document of each group (the one that names it), in the documents' own columns."""
    groups = near_groups(docs, budget)
    keepers = groups.select(F.col("component_id").alias("doc_id"), F.col("keeper_digest").alias("digest")).distinct()
    return only(docs, keepers)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
