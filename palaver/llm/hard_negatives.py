"""Hard negatives by angular triangle filtering.

Each vector becomes whole numbers and stores its norm and its angles to ``REFERENCES``
reference directions. By the triangle inequality the angle between an anchor and a row lies
between the largest difference and the smallest sum of their stored angles; the cosines of
both ends, times the norms and widened by the rounding error of all steps, bound the integer
score from both sides. Only rows whose bounds overlap what is still wanted are scored.

* Positives: rows of the anchor's label whose upper bound reaches its kth best score so far.
* Negatives: rows of other labels whose bounds overlap the window ``low * p <= 100 * score <=
  high * p`` of one of its positives ``p``, above the kth negative of that window so far.

Rows are kept in the order of label, nearest reference and angle to it, in shards of about
``SHARD`` rows and blocks of ``BLOCK``, each with the extremes of its labels, norms and angles;
anchors in groups of about ``GROUP``. Extremes of groups and shards meet first, in tiles, and
only pairs whose bounds overlap become lanes, which carry the vectors. A lane holds one group
and one shard, so neither all anchors nor all rows are in one place, and gives at most
``negatives`` rows for a positive.

The reference directions are spread over at most ``SAMPLE`` rows (smallest hashes of ids),
each as far as possible from those before. They decide how much is pruned, never the result.

Cases: rows without id or label, null vectors and vectors with null or non-finite components
take no part; vectors of other lengths count missing components as zero; rows of the anchor's
own id are not its candidates; repeated rows are rows of their own; scores are exact, those
beyond 64 bits are held at the largest long; an anchor without positives, and a positive whose
window is empty, give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, materialise

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
REFERENCES = 16
SAMPLE = 2048
BLOCK = 128
SHARD = 4096
GROUP = 1024
PACK = 256  # anchors in one stored row
TILE = 1024  # groups or shards whose extremes meet in one task
LANES = 4096  # tasks among which lanes are dealt
PARTITION = 32  # bits of a stored row's number below its partition's
EXACT = 2.0**53
LONG = np.iinfo(np.int64)

INDEX = (
    "kind int, unit long, row long, n int, dims int, ids binary, labels binary, rows binary, norms binary, angles binary, "
    "floors binary"
)


# ---- bounds --------------------------------------------------------------------


def slack(dims: int) -> float:
    """Largest error of a cosine bound, as a part of the product of the norms."""
    return 4 * np.sqrt((dims + 8) * 2.0**-52)


def norms_of(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def angles_to(rows: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of the rows to the (unit) references; a zero vector is at right angles to all."""
    dims = min(rows.shape[1], references.shape[1])
    along = rows[:, :dims] @ references[:, :dims].T
    return np.arccos(np.clip(along / np.where(norms > 0, norms, 1)[:, None], -1, 1))


def nearest_and_farthest(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and most angle between members of a and b, whose angles to each reference lie in ranges.

    Arguments have a row per item and a column per reference; results a row per a, a column per b.
    """
    least = np.zeros((len(low_a), len(low_b)))
    most = np.full(least.shape, np.pi)
    for r in range(low_a.shape[1]):
        np.maximum(least, low_a[:, r, None] - high_b[None, :, r], out=least)
        np.maximum(least, low_b[None, :, r] - high_a[:, r, None], out=least)
        total = high_a[:, r, None] + high_b[None, :, r]
        back = 2 * np.pi - (low_a[:, r, None] + low_b[None, :, r])
        # over a range of sums both sides of pi, the angle may reach pi
        np.minimum(most, np.where(total <= np.pi, total, np.where(back <= np.pi, back, np.pi)), out=most)
    return least, most


def score_bounds(angles_a, norms_a, angles_b, norms_b, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores; arguments are (lowest, highest) pairs of arrays."""
    least, most = nearest_and_farthest(*angles_a, *angles_b)
    room = slack(dims)
    up, down = np.cos(least) + room, np.cos(most) - room
    small, large = np.multiply.outer(norms_a[0], norms_b[0]), np.multiply.outer(norms_a[1], norms_b[1])
    upper = np.where(up >= 0, large, small) * up
    lower = np.where(down >= 0, small, large) * down
    return lower * (1 - np.sign(lower) * room) - 1, upper * (1 + np.sign(upper) * room) + 1


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers; ``most`` is the largest product of norms."""
    if most < EXACT * 0.99:
        return (a @ b.T).astype(np.int64)
    ours, theirs = [[[int(x) for x in row] for row in side] for side in (a, b)]
    exact = [[min(max(sum(x * y for x, y in zip(u, v)), LONG.min), LONG.max) for v in theirs] for u in ours]
    return np.array(exact, np.int64).reshape(len(a), len(b))


def window_of(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with low * score <= 100 * s <= high * score: from, to. In 64 bits throughout."""
    part, rest = np.divmod(score, 100)
    return part * low - (-(rest * low) // 100), part * high + rest * high // 100


# ---- stored rows ---------------------------------------------------------------


@dataclass
class Part:
    """Rows of the index side by side: a block, or a pack of anchors."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, chosen) -> Part:
        return Part(self.ids[chosen], self.labels[chosen], self.rows[chosen], self.norms[chosen], self.angles[chosen])

    @property
    def spans(self) -> tuple:
        """Angles and norms as (lowest, highest) pairs, row by row."""
        return (self.angles, self.angles), (self.norms, self.norms)


def _stored(part: Part, kind: int, unit: int, row: int, floors: bytes = b"") -> tuple:
    small = np.abs(part.rows).max(initial=0) < 2**24
    return (
        kind, unit, row, len(part), part.rows.shape[1], part.ids.tobytes(), part.labels.tobytes(),
        part.rows.astype(np.float32 if small else np.float64).tobytes(), part.norms.tobytes(), part.angles.tobytes(), floors,
    )


def _loaded(r: dict, dims: int) -> Part:
    n, own = r["n"], r["dims"]
    kind = np.float64 if len(r["rows"]) == 8 * n * own and own else np.float32
    rows = np.frombuffer(r["rows"], kind).reshape(n, own).astype(np.float64)
    rows = rows if own == dims else np.pad(rows, ((0, 0), (0, dims - own)))
    return Part(
        np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), rows,
        np.frombuffer(r["norms"]), np.frombuffer(r["angles"]).reshape(n, -1),
    )


def _extremes(part: Part) -> tuple:
    """Envelope of a part: angles (lowest, highest), norms, labels."""
    return (
        (part.angles.min(0)[None], part.angles.max(0)[None]), (part.norms.min()[None], part.norms.max()[None]),
        (part.labels.min(), part.labels.max()),
    )


# ---- search in one lane ----------------------------------------------------------


class Best:
    """The k best (score, id) of each asker, ties to smaller ids."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((n, k), LONG.min)
        self.ids = np.full((n, k), LONG.max)
        self.held = np.zeros((n, k), bool)
        self.floors = np.full(n, float("-inf")) if floors is None else floors

    def kth(self) -> np.ndarray:
        return np.maximum(np.where(self.held[:, -1], self.scores[:, -1].astype(np.float64), -np.inf), self.floors)

    def add(self, askers: np.ndarray, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        """Offer each of ``askers`` the columns of ``scores`` that are ``wanted``."""
        if scores.shape[1] > 4 * self.k:  # only the k best of each row can stay: find the kth score, keep ties
            worst = np.where(wanted, scores, LONG.min)
            kth = -np.partition(-worst.astype(np.float64), self.k - 1, axis=1)[:, self.k - 1]
            some = (wanted & (worst.astype(np.float64) >= kth[:, None])).any(0)
            scores, ids, wanted = scores[:, some], ids[some], wanted[:, some]
        every = np.concatenate([self.scores[askers], np.where(wanted, scores, LONG.min)], 1)
        names = np.concatenate([self.ids[askers], np.where(wanted, ids[None], LONG.max)], 1)
        held = np.concatenate([self.held[askers], wanted], 1)
        order = np.lexsort((names, np.invert(every), ~held), axis=1)[:, : self.k]
        self.scores[askers] = np.take_along_axis(every, order, 1)
        self.ids[askers] = np.take_along_axis(names, order, 1)
        self.held[askers] = np.take_along_axis(held, order, 1)


def _block_bounds(asked: Part, blocks: list[Part], dims: int) -> tuple[np.ndarray, np.ndarray]:
    edges = [_extremes(b) for b in blocks]
    angles = tuple(np.concatenate([e[0][side] for e in edges]) for side in (0, 1))
    norms = tuple(np.concatenate([e[1][side] for e in edges]) for side in (0, 1))
    return score_bounds(*asked.spans, angles, norms, dims)


def find_positives(asked: Part, blocks: list[Part], k: int, floors: np.ndarray | None = None) -> Best:
    """The k best rows of each asked row's label."""
    best, dims = Best(len(asked), k, floors), asked.rows.shape[1]
    _, upper = _block_bounds(asked, blocks, dims)
    for b in np.argsort(-upper.max(0), kind="stable"):
        block = blocks[b]
        some = np.flatnonzero(
            (asked.labels >= block.labels.min()) & (asked.labels <= block.labels.max()) & (upper[:, b] >= best.kth())
        )
        if not len(some):
            continue
        ours = asked.take(some)
        _, most = score_bounds(*ours.spans, *block.spans, dims)
        wanted = (ours.labels[:, None] == block.labels) & (ours.ids[:, None] != block.ids) & (most >= best.kth()[some, None])
        left = wanted.any(1)
        if left.any():
            cols = wanted.any(0)
            scores = products(ours.rows[left], block.rows[cols], float(ours.norms.max() * block.norms.max()))
            best.add(some[left], scores, block.ids[cols], wanted[np.ix_(left, cols)])
    return best


def find_negatives(asked: Part, start: np.ndarray, end: np.ndarray, blocks: list[Part], k: int) -> Best:
    """The k best rows of other labels with scores in the windows.

    ``start`` and ``end`` have a row per asked row and a column per window. Windows are numbered
    row by row in the result.
    """
    windows = start.shape[1]
    best, dims = Best(start.size, k), asked.rows.shape[1]
    lower, upper = _block_bounds(asked, blocks, dims)
    first, last = start.min(1), end.max(1)
    for b in np.argsort(-upper.max(0), kind="stable"):
        block = blocks[b]
        kth = best.kth().reshape(start.shape)
        # what a row has to reach for a window, and the least of these
        need = np.maximum(start, kth)
        need = np.where(start <= end, need, np.inf).min(1)
        only = (block.labels.min() == block.labels.max()) & (asked.labels == block.labels.min())
        some = np.flatnonzero(~only & (upper[:, b] >= need) & (lower[:, b] <= last))
        if not len(some):
            continue
        ours = asked.take(some)
        least, most = score_bounds(*ours.spans, *block.spans, dims)
        wanted = (ours.labels[:, None] != block.labels) & (ours.ids[:, None] != block.ids)
        wanted &= (most >= need[some, None]) & (least <= last[some, None]) & (most >= first[some, None])
        left = wanted.any(1)
        if not left.any():
            continue
        cols = wanted.any(0)
        scores = products(ours.rows[left], block.rows[cols], float(ours.norms.max() * block.norms.max()))
        wanted, some = wanted[np.ix_(left, cols)], some[left]
        for w in range(windows):
            inside = wanted & (scores >= start[some, w, None]) & (scores <= end[some, w, None])
            inside &= scores >= kth[some, w, None]
            hit = inside.any(1)
            if hit.any():
                best.add(some[hit] * windows + w, scores[hit], block.ids[cols], inside[hit])
    return best


# ---- index ---------------------------------------------------------------------


def pick_references(rows: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of rows, each as far as possible from those before."""
    norms = norms_of(rows) if rows.size else np.zeros(0)
    units = rows[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(1, max(1, rows.shape[1] if rows.ndim == 2 else 1))
    chosen = [int(np.argmin(units @ units.mean(0)))]
    near = units @ units[chosen[0]]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def _matrix(vectors: list) -> np.ndarray:
    dims = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _numbers(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _placer(references: np.ndarray, scale: float):
    """Adds the nearest reference and the angle to it, the order of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.floor(scale * _matrix(_numbers(batch.column("embedding"))))
            angles = angles_to(rows, norms_of(rows), references)
            near = angles.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near])],
                [*batch.schema.names, "near", "angle"],
            )

    return run


def _builder(references: np.ndarray, scale: float, k: int, shard_rows: int, block: int):
    """Stored rows; ``unit`` is the number of rows (or anchors) before it in its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"row": TaskContext.get().partitionId() << PARTITION, "rows": 0, "anchors": 0}
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]

        def shard(ids, labels, vectors, asks) -> pa.RecordBatch:
            rows = np.floor(scale * _matrix(vectors))
            norms = norms_of(rows)
            every = Part(np.array(ids, np.int64), np.array(labels, np.int64), rows, norms, angles_to(rows, norms, references))
            blocks = [every.take(slice(at, at + block)) for at in range(0, len(every), block)]
            out = []
            for part in blocks:
                out.append(_stored(part, 0, state["rows"], state["row"]))
                state["rows"] += len(part)
                state["row"] += 1
            asking = np.flatnonzero(asks)
            for at in range(0, len(asking), PACK):
                some = every.take(asking[at: at + PACK])
                floors = find_positives(some, blocks, k).kth()  # reached inside the own shard
                out.append(_stored(some, 1, state["anchors"], state["row"], floors.tobytes()))
                state["row"] += 1
                state["anchors"] += len(some)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        held: list[list] = [[], [], [], []]
        for batch in batches:
            held[0] += batch.column("vec_id").to_pylist()
            held[1] += batch.column("label").to_pylist()
            held[2] += _numbers(batch.column("embedding"))
            held[3] += batch.column("asks").to_pylist()
            while len(held[0]) >= shard_rows:
                yield shard(*[h[:shard_rows] for h in held])
                held = [h[shard_rows:] for h in held]
        if held[0]:
            yield shard(*held)

    return run


def _numbered(index: DataFrame, shard_rows: int, group_rows: int) -> DataFrame:
    """The index with units numbered over all partitions, so that they are full however many there are."""
    part = F.shiftright("row", PARTITION).alias("part")
    sizes = index.groupBy("kind", part).agg(F.sum("n").alias("held"))  # a row per partition
    before = F.coalesce(F.sum("held").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialise(sizes.select("kind", "part", before.alias("before")), "hard-sizes")
    placed = index.withColumn("part", part).join(sizes, ["kind", "part"])
    at = F.col("before") + F.col("unit")
    unit = F.floor(at / F.when(F.col("kind") == 0, shard_rows).otherwise(group_rows)).cast("long")
    return placed.withColumn("unit", unit).select(*index.columns)


# ---- lanes -----------------------------------------------------------------------


def _wanted(r: dict) -> tuple[float, float]:
    """Range of the scores that the anchors of a stored row still want."""
    floors = np.frombuffer(r["floors"])
    if r["kind"] == 0:
        return float("inf"), float("-inf")
    return (float(floors.min()), float("inf")) if r["positives"] is None else (float(floors[0]), float(floors[1]))


ENVELOPE = (
    "kind int, unit long, ref int, low double, high double, norm_low double, norm_high double, label_low long, label_high long, "
    "want_low double, want_high double, dims int"
)


def _envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extremes of the units (shards and groups) in a batch, a row per reference."""
    names, kinds = zip(*[c.split() for c in ENVELOPE.split(", ")])
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[k] for k in kinds]
    for batch in batches:
        units: dict[tuple, list] = {}
        for r in batch.to_pylist():
            part = _loaded(r, r["dims"])
            (low, high), norms, labels = _extremes(part)
            want = _wanted(r)
            new = [low[0], high[0], norms[0][0], norms[1][0], labels[0], labels[1], *want, r["dims"]]
            old = units.get((r["kind"], r["unit"]), new)
            lowest = (0, 2, 4, 6)
            units[r["kind"], r["unit"]] = [(np.minimum if k in lowest else np.maximum)(x, y) for k, (x, y) in enumerate(zip(old, new))]
        out = [
            (*unit, ref, e[0][ref], e[1][ref], *e[2:]) for unit, e in units.items() for ref in range(len(e[0]))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], list(names))


def _pairs(same_label: bool):
    """Groups and shards of a tile whose bounds overlap."""
    def met(rows: list[dict]) -> pa.RecordBatch | None:
        groups, shards = [r for r in rows if r["kind"]], [r for r in rows if not r["kind"]]
        if not groups or not shards:
            return None
        of = lambda side, name: np.array([r[name] for r in side])
        both = [((of(s, "low"), of(s, "high")), (of(s, "norm_low"), of(s, "norm_high"))) for s in (groups, shards)]
        lower, upper = score_bounds(*both[0], *both[1], max(r["dims"] for r in rows))
        low_a, high_a = of(groups, "label_low")[:, None], of(groups, "label_high")[:, None]
        low_b, high_b = of(shards, "label_low"), of(shards, "label_high")
        labels = (low_a <= high_b) & (high_a >= low_b) if same_label else ~((low_a == high_a) & (low_b == high_b) & (low_a == low_b))
        meet = labels & (upper >= of(groups, "want_low")[:, None]) & (lower <= of(groups, "want_high")[:, None])
        a, b = np.nonzero(meet)
        return pa.RecordBatch.from_arrays([pa.array(of(groups, "unit")[a]), pa.array(of(shards, "unit")[b])], ["group", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["tile"] != tile:
                    if (out := met(rows)) is not None:
                        yield out
                    tile, rows = r["tile"], []
                rows.append(r)
        if (out := met(rows)) is not None:
            yield out

    return run


def _lanes(rows: DataFrame, same_label: bool, tile: int) -> DataFrame:
    """(group, shard) pairs that can hold something wanted, from their extremes alone."""
    lows, highs = ("norm_low", "label_low", "want_low"), ("norm_high", "label_high", "want_high", "dims")
    extremes = [F.min(c).alias(c) for c in lows] + [F.max(c).alias(c) for c in highs]
    spans = rows.mapInArrow(_envelopes, ENVELOPE).groupBy("kind", "unit", "ref").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *extremes
    )
    units = spans.groupBy("kind", "unit").agg(  # one entry a reference
        F.sort_array(F.collect_list(F.struct("ref", "low", "high"))).alias("span"), *extremes
    ).select("kind", "unit", F.col("span.low").alias("low"), F.col("span.high").alias("high"), *lows, *highs)
    units = materialise(units, "hard-extremes")
    held = {r["kind"]: r["count"] for r in units.groupBy("kind").count().collect()}
    across, down = [max(1, -(-held.get(kind, 1) // tile)) for kind in (0, 1)]
    own = F.pmod(F.xxhash64("unit"), F.when(F.col("kind") == 0, across).otherwise(down))
    tiles = F.when(
        F.col("kind") == 0, F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda d: d * across + own)
    ).otherwise(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda a: own * across + a))
    dealt = units.withColumn("tile", F.explode(tiles)).repartition(across * down, "tile").sortWithinPartitions("tile")
    return materialise(dealt.mapInArrow(_pairs(same_label), "group long, shard long"), "hard-lanes")


def _meet(anchors: DataFrame, blocks: DataFrame, same_label: bool, tile: int, answer, schema: str) -> DataFrame:
    """Each lane's answer: the rows of its group and of its shard meet in one place."""
    lanes = _lanes(anchors.unionByName(blocks), same_label, tile)
    asked = anchors.withColumnRenamed("unit", "group").join(lanes, "group")
    both = asked.unionByName(blocks.withColumnRenamed("unit", "shard").join(lanes, "shard"))
    dealt = both.repartition(min(max(1, lanes.count()), LANES), "group", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking, held = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["shard"]) != at:
                    if asking and held:
                        yield from answer(asking, held)
                    at, asking, held = (r["group"], r["shard"]), [], []
                (asking if r["kind"] else held).append(r)
        if asking and held:
            yield from answer(asking, held)

    return dealt.sortWithinPartitions("group", "shard", F.desc("kind"), "row").mapInArrow(run, schema)


def _answer_positives(k: int):
    def answer(asked: list[dict], held: list[dict]) -> Iterator[pa.RecordBatch]:
        dims = max(r["dims"] for r in asked + held)
        blocks = [_loaded(r, dims) for r in held]
        for r in asked:
            part = _loaded(r, dims)
            best = find_positives(part, blocks, k, np.frombuffer(r["floors"]))
            at, place = np.nonzero(best.held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), r["row"])), pa.array(at.astype(np.int32)), pa.array(part.ids[at]),
                 pa.array(best.ids[at, place]), pa.array(best.scores[at, place])],
                ["row", "at", "anchor_id", "positive_id", "positive_score"],
            )

    return answer


def _answer_negatives(k: int, low: int, high: int):
    def answer(asked: list[dict], held: list[dict]) -> Iterator[pa.RecordBatch]:
        dims = max(r["dims"] for r in asked + held)
        blocks = [_loaded(r, dims) for r in held]
        for r in asked:
            part = _loaded(r, dims)
            positives = r["positives"]
            places = max(p["place"] for p in positives)
            score, name = np.zeros((len(part), places), np.int64), np.zeros((len(part), places), np.int64)
            start, end = np.ones(score.shape, np.int64), np.zeros(score.shape, np.int64)  # empty
            for p in positives:
                cell = p["at"], p["place"] - 1
                score[cell], name[cell] = p["positive_score"], p["positive_id"]
                start[cell], end[cell] = window_of(np.int64(p["positive_score"]), low, high)
            best = find_negatives(part, start, end, blocks, k)
            window, rank = np.nonzero(best.held)
            at, place = np.divmod(window, places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), r["row"])), pa.array(at.astype(np.int32)), pa.array((place + 1).astype(np.int32)),
                 pa.array(part.ids[at]), pa.array(name[at, place]), pa.array(best.ids[window, rank]),
                 pa.array(score[at, place]), pa.array(best.scores[window, rank])],
                ["row", "at", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
            )

    return answer


def _with_windows(low: int, high: int):
    """Anchors as wanting what lies between the ends of their positives' windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = []
            for positives in batch.column("positives").to_pylist():
                start, end = window_of(np.array([p["positive_score"] for p in positives], np.int64), low, high)
                some = start <= end
                span = (start[some].min(), end[some].max()) if some.any() else (np.inf, -np.inf)
                wants.append(np.array(span, np.float64).tobytes())
            at = batch.schema.names.index("floors")
            yield batch.set_column(at, "floors", pa.array(wants, pa.binary()))

    return run


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: float = SCALE, references: int = REFERENCES, shard_rows: int = SHARD, group_rows: int = GROUP, block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``anchors`` says which of its rows ask.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    there = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.col("label").isNotNull() & finite
    rows = columns_of(vectors, "vec_id", "embedding", "label").where(there).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    sample = rows.select("embedding", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    away = pick_references(np.floor(scale * _matrix([r["embedding"] for r in sample])), references)

    order = ["label", "near", "angle", "vec_id"]
    placed = rows.mapInArrow(_placer(away, scale), "vec_id long, embedding array<double>, label long, asks boolean, near int, angle double")
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    index = materialise(
        ordered.select("vec_id", "embedding", "label", "asks").mapInArrow(_builder(away, scale, positives, shard_rows, block), INDEX),
        "hard-index",
    )
    index = _numbered(index, shard_rows, group_rows)
    found_none = F.lit(None).cast("array<struct<at:int,place:int,positive_id:bigint,positive_score:bigint>>").alias("positives")
    blocks, asking = [index.where(f"kind = {kind}").select("*", found_none) for kind in (0, 1)]
    found = _meet(asking, blocks, True, tile, _answer_positives(positives), "row long, at int, anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("row", "at").orderBy(F.desc("positive_score"), "positive_id")
    chosen = materialise(
        found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "hard-positives"
    )
    # at most PACK anchors a row, with at most ``positives`` each
    packed = chosen.groupBy("row").agg(F.collect_list(F.struct("at", "place", "positive_id", "positive_score")).alias("positives"))
    wanting = asking.drop("positives").join(packed, "row").select(*asking.columns)
    wanting = materialise(wanting.mapInArrow(_with_windows(low, high), wanting.schema), "hard-anchors")
    got = _meet(
        wanting, blocks, False, tile, _answer_negatives(negatives, low, high),
        "row long, at int, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    ranked = Window.partitionBy("row", "at", "place").orderBy(F.desc("negative_score"), "negative_id")
    return got.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id anchor_id, a.label own, c.vec_id, c.label, cast(list_dot_product(a.e, c.e) as bigint) score
  from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id),
p as (
  select anchor_id, vec_id positive_id, score positive_score from s where label = own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, p.positive_id, s.vec_id negative_id, p.positive_score, s.score negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as "rank"
  from p join s using (anchor_id)
  where s.label <> s.own and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast("rank" as int) as "rank", negative_id, positive_score, negative_score from n where "rank" <= 3
"""
