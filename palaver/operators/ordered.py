"""Order-dependent folds that survive a room with a third of all rows.

``Window.partitionBy(room)`` would put such a room into one task. Here a room is
cut into chunks of its line numbers; the window runs inside ``(room, chunk)``, a
summary row per chunk carries the boundary state, and only these summaries
(rows / chunk size) are windowed per room. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 200_000

Flag = Callable[[Column, Column], Column]


def link_rows(
    rows: DataFrame,
    carry: Sequence[str],
    starts: dict[str, Flag] | None = None,
    keys: Sequence[str] = ("room_id",),
    order: str = "line",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``prev`` (struct of the previous row's ``carry`` columns, NULL on the first

    row of a group) and, for each entry ``name -> start(current, previous)`` of
    ``starts``, an island number ``<name>_id`` that grows where a start holds.
    ``order`` must be an integer unique within a group.
    """
    starts = starts or {}
    keys = list(keys)
    group = [*keys, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)

    # The carried columns travel once, inside ``_cur``, and the filter that the join
    # below would infer is spelled out: the rows and their chunk summaries then read
    # the same exchange, and the source is scanned and shuffled once.
    others = [c for c in rows.columns if c not in carry]
    d = _chunked(rows, keys, order, chunk_rows).select(*others, "_chunk", F.struct(*carry).alias("_cur"))
    d = d.withColumn("_prev", F.lag("_cur").over(inside))
    for name, start in starts.items():
        flag = F.when(F.col("_prev").isNull(), 0).when(start(F.col("_cur"), F.col("_prev")), 1).otherwise(0)
        d = d.withColumn(f"_n_{name}", F.sum(flag.cast("bigint")).over(so_far))

    chunks = d.groupBy(*group).agg(
        F.min_by("_cur", order).alias("_first"),
        F.max_by("_cur", order).alias("_last"),
        *[F.max(f"_n_{name}").alias(f"_n_{name}") for name in starts],
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = chunks.withColumn("_carry", F.lag("_last").over(across))
    for name, start in starts.items():
        first = F.when(F.col("_carry").isNull(), 1).when(start(F.col("_first"), F.col("_carry")), 1).otherwise(0)
        chunks = chunks.withColumn(f"_h_{name}", first.cast("bigint"))
        total = F.sum(F.col(f"_n_{name}") + F.col(f"_h_{name}")).over(
            across.rowsBetween(Window.unboundedPreceding, 0)
        )
        chunks = chunks.withColumn(f"_b_{name}", total - F.col(f"_n_{name}"))

    state = chunks.select(*group, "_carry", *[f"_b_{name}" for name in starts])
    out = d.join(state, group)
    for name in starts:
        out = out.withColumn(f"{name}_id", F.col(f"_b_{name}") + F.col(f"_n_{name}"))
    return out.select(
        *[F.col(f"_cur.{c}").alias(c) if c in carry else F.col(c) for c in rows.columns],
        *[f"{name}_id" for name in starts], F.coalesce("_prev", "_carry").alias("prev"),
    )


def _chunked(rows: DataFrame, keys: Sequence[str], order: str, chunk_rows: int) -> DataFrame:
    """``rows`` with their chunk number; rows without key or position have no place in an order."""
    d = rows.withColumn("_chunk", F.expr(f"`{order}` div {int(chunk_rows)}L"))
    present = F.col("_chunk").isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    return d.filter(present)


def ordered_rank(
    rows: DataFrame, keys: Sequence[str], order: str, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """1-based rank by the integer column ``order`` within ``keys``, chunk by chunk."""
    keys = list(keys)
    group = [*keys, "_chunk"]
    d = _chunked(rows, keys, order, chunk_rows)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order)).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        d.groupBy(*group).agg(F.count("*").alias("_n"))
        .select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return d.join(base, group).withColumn(name, F.col("_base") + F.col("_r")).drop("_chunk", "_r", "_base")
