"""Exact top-k by inner product with block-at-a-time pruning.

Index: vectors become whole numbers and are put in an order that keeps alike ones together
(largest component and its sign, then id). Blocks are ranges of that order; a block has its
forward index (ids and components) and, for each component, its largest and smallest value.
The most a block can score for a query is the sum over components of the query's value times
the block's largest (or, for a negative value, smallest) value.

Search: for each query the blocks are visited by falling bound, several at a time; visiting
ends when the bound is below the kth score (or equal to it with only larger ids). Queries
start from the kth score among their neighbours in the order, found while the index is built.

Queries and blocks meet in lanes: a lane holds a bounded number of queries and a bounded part
of the index, read as two sorted streams, and gives at most k rows for a query. So neither
all queries nor all vectors are ever in one place.

Cases: null vectors, vectors with null or non-finite components and rows without id take no
part; vectors of other lengths count missing components as zero; a query skips rows of its
own id; repeated rows are candidates (and queries) of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, materialise

K = 20
SCALE = 64.0
BLOCK = 32  # vectors in a block
CHUNK = 4096  # vectors of the order that seed each other's queries
LANE_VECTORS = 8192
LANE_QUERIES = 2048
VISIT = 4  # blocks visited by a query in one round
EXACT = 2.0**53
BUILT = (
    "kind int, shard long, n int, dims int, ids binary, rows binary, most binary, least binary, floor binary"
)


def blocks_of(ids: np.ndarray, rows: np.ndarray, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(ids), size):
        yield ids[at: at + size], rows[at: at + size]


def padded(parts: list[tuple[np.ndarray, np.ndarray]], size: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, rows and a mask of places in use, one row per block."""
    ids = np.zeros((len(parts), size), np.int64)
    rows = np.zeros((len(parts), size, dims))
    used = np.zeros((len(parts), size), bool)
    for k, (i, r) in enumerate(parts):
        ids[k, : len(i)], rows[k, : len(i), : r.shape[1]], used[k, : len(i)] = i, r, True
    return ids, rows, used


def search(
    q_ids: np.ndarray, q_rows: np.ndarray, ids: np.ndarray, rows: np.ndarray, used: np.ndarray, k: int,
    floor: np.ndarray | None = None, most: np.ndarray | None = None, least: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Best k (scores, ids) of each query; places without a candidate have score -inf.

    ``floor``: a score that the query's kth result reaches at least.
    """
    n, count = len(q_ids), len(ids)
    big = np.iinfo(np.int64).max
    scores, best = np.full((n, k), -np.inf), np.full((n, k), big)
    if not count or not n:
        return scores, best
    if most is None:
        most = np.where(used[..., None], rows, -np.inf).max(1)
        least = np.where(used[..., None], rows, np.inf).min(1)
    bound = np.maximum(q_rows, 0) @ most.T + np.minimum(q_rows, 0) @ least.T
    bound += np.abs(bound) * 1e-12 * (np.abs(bound) >= EXACT)  # beyond 2^53 sums are rounded
    lowest = np.where(used, ids, big).min(1)
    order = np.lexsort((np.broadcast_to(lowest, bound.shape), -bound), axis=1)
    bound = np.take_along_axis(bound, order, 1)
    floor = np.full(n, -np.inf) if floor is None else floor
    active = np.arange(n)
    for at in range(0, count, VISIT):
        kth = np.maximum(scores[active, -1], floor[active])
        ahead = bound[active, at]
        tied = (ahead == scores[active, -1]) & (lowest[order[active, at:]].min(1) > best[active, -1])
        active = active[(ahead >= kth) & ~tied]
        if not len(active):
            break
        for some in np.array_split(active, max(1, len(active) // 256)):
            chosen = order[some, at: at + VISIT]
            near = rows[chosen].reshape(len(some), -1, rows.shape[2])
            got = np.matmul(near, q_rows[some, :, None])[..., 0]
            found = ids[chosen].reshape(len(some), -1)
            got = np.where(used[chosen].reshape(found.shape) & (found != q_ids[some, None]), got, -np.inf)
            got, found = np.concatenate([scores[some], got], 1), np.concatenate([best[some], found], 1)
            found = np.where(np.isneginf(got), big, found)
            first = np.lexsort((found, -got), axis=1)[:, :k]
            scores[some], best[some] = np.take_along_axis(got, first, 1), np.take_along_axis(found, first, 1)
    return scores, best


def _numbers(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    dims = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _stored(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.float32 if np.abs(rows).max(initial=0) < 2**24 else np.float64).tobytes()


def _loaded(data: bytes, n: int, dims: int) -> np.ndarray:
    kind = np.float64 if len(data) == 8 * n * dims else np.float32
    return np.frombuffer(data, kind).reshape(n, dims).astype(np.float64)


def _builder(k: int):
    names = ["kind", "shard", "n", "dims", "ids", "rows", "most", "least", "floor"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def chunk(ids, vectors, asks, shard: int) -> pa.RecordBatch:
        ids, rows, asks = np.array(ids, np.int64), _matrix(vectors), np.array(asks, bool)
        dims = rows.shape[1]
        parts = list(blocks_of(ids, rows))
        out = []
        for i, r in parts:
            out.append((0, shard, len(i), dims, i.tobytes(), _stored(r), _stored(r.max(0)[None]), _stored(r.min(0)[None]), b""))
        if asks.any():
            scores, _ = search(ids[asks], rows[asks], *padded(parts, BLOCK, dims), k)
            for some in np.array_split(np.flatnonzero(asks), math.ceil(asks.sum() / 256)):
                floor = scores[np.searchsorted(np.flatnonzero(asks), some), -1]
                out.append((1, shard, len(some), dims, ids[some].tobytes(), _stored(rows[some]), b"", b"", floor.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, vectors, asks = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += [np.floor(SCALE * v) for v in _numbers(batch.column(1))]
            asks += batch.column(2).to_pylist()
            while len(ids) >= CHUNK:
                yield chunk(ids[:CHUNK], vectors[:CHUNK], asks[:CHUNK], shard)
                ids, vectors, asks, shard = ids[CHUNK:], vectors[CHUNK:], asks[CHUNK:], shard + 1
        if ids:
            yield chunk(ids, vectors, asks, shard)

    return run


def _lanes(k: int):
    names = ["query", "query_id", "vec_id", "score"]

    def answer(asked: list[dict], held: list[dict]) -> pa.RecordBatch:
        dims = max(r["dims"] for r in asked + held)
        q_ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in asked])
        floor = np.concatenate([np.frombuffer(r["floor"], np.float64) for r in asked])
        key = np.concatenate([(r["row"] << 10) + np.arange(r["n"]) for r in asked])
        q_rows = np.concatenate([_wide(_loaded(r["rows"], r["n"], r["dims"]), dims) for r in asked])
        parts = [(np.frombuffer(r["ids"], np.int64), _loaded(r["rows"], r["n"], r["dims"])) for r in held]
        most = np.concatenate([_wide(_loaded(r["most"], 1, r["dims"]), dims) for r in held])
        least = np.concatenate([_wide(_loaded(r["least"], 1, r["dims"]), dims) for r in held])
        scores, best = search(q_ids, q_rows, *padded(parts, BLOCK, dims), k, floor, most, least)
        at, place = np.nonzero(~np.isneginf(scores) & (scores >= floor[:, None]))
        return pa.RecordBatch.from_arrays([
            pa.array(key[at]), pa.array(q_ids[at]), pa.array(best[at, place]), pa.array(scores[at, place].astype(np.int64)),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, asked, held = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] != lane:
                    if asked and held:
                        yield answer(asked, held)
                    lane, asked, held = row["lane"], [], []
                (asked if row["kind"] else held).append(row)
        if asked and held:
            yield answer(asked, held)

    return run


def _wide(rows: np.ndarray, dims: int) -> np.ndarray:
    return rows if rows.shape[1] == dims else np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))


def top_k(vectors: DataFrame, asks: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` that satisfy ``asks``."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    size = F.transform("embedding", lambda x: F.abs(x))
    top = F.array_position(size, F.array_max(size))
    alike = F.coalesce(top * F.when(F.try_element_at("embedding", top.cast("int")) < 0, -1).otherwise(1), F.lit(0))
    valid = columns_of(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = valid.select("vec_id", values.alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks"), alike.alias("alike"))
    ordered = rows.repartitionByRange("alike", "vec_id").sortWithinPartitions("alike", "vec_id")
    built = materialise(ordered.select("vec_id", "embedding", "asks").mapInArrow(
        _builder(k), BUILT
    ).withColumn("row", F.monotonically_increasing_id()), "topk-index")

    held = {r["kind"]: r["n"] for r in built.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    parts = math.ceil(held.get(0, 1) / LANE_VECTORS)
    groups = math.ceil(held.get(1, 1) / LANE_QUERIES)
    part = F.pmod(F.xxhash64("shard"), F.lit(parts))
    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    blocks = built.where("kind = 0").withColumn("lane", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * parts + part)))
    queries = built.where("kind = 1").withColumn("lane", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: group * parts + p)))
    both = blocks.unionByName(queries)
    found = both.repartition(parts * groups, "lane").sortWithinPartitions("lane", F.desc("kind"), "row").mapInArrow(
        _lanes(k), "query long, query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as "rank" from s)
select query_id, cast("rank" as int) as "rank", vec_id, score from r where "rank" <= 20
"""
