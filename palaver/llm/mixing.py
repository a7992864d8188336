"""Mixing sources to target weights by capped water-filling and seeded repetition.

The mix asks for ``share`` times the words of all documents, dealt to the sources by weight.
A source stops at ``max_epochs`` times its own words; what it can't take goes to the others
by weight, again and again until none is above its stop. A source then repeats all its
documents the whole number of times and, for the fraction, takes documents in a seeded order
until the words come nearest to the target.

Sources are ranked without a global sort in one task (ranges of sources, then offsets of the
ranges); the seeded order is cut by sums over 256 hash buckets of each source, then over 256
parts of the bucket that is cut, so only the documents of one part (1 in 65,536) of a source
are ever sorted. The decision is a comparison with the source's row. Column functions only.

Cases: null text has no words; a null source is a source of its own, last in order; a null
id is hashed as the empty string; repeated rows are rows of their own; documents without
words are taken 0 times; if the sources' stops are below the total, each gets its stop; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import boxed, columns_of, materialise, unboxed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20240
LEVELS = (2, 4)  # hexadecimal digits of the seeded order that name a bucket, level by level


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(totals: DataFrame) -> DataFrame:
    """totals with ``place``: 0, 1, 2 ... by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialise(
        totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return ranged.join(parts, "part").select(
        "source", "source_size",
        (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("place"),
    )


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), by capped water-filling.

    Each round is one small aggregate: the level is what is left for the open sources over
    their weights, and sources above their stop at this level are closed. The level only
    rises, so the rounds end; usually after two or three.
    """
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialise(
        _ranked(totals).withColumn("weight", F.element_at(wheel, (F.col("place") % len(weights) + 1).cast("int"))), "mix-weights"
    )
    stop = F.lit(float(max_epochs)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    asked, left, weight, closed = share * total, share * total, None, -1
    while True:
        over = F.lit(False) if weight is None else F.col("weight") * F.lit(left) > stop * F.lit(weight)
        row = ranked.agg(
            F.sum(F.when(over, stop)).alias("stopped"), F.sum(F.when(~over, F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("closed"),
        ).first()
        if row["closed"] == closed:
            break
        left, weight, closed = asked - (row["stopped"] or 0.0), row["open"], row["closed"]
        if not weight:
            over = F.lit(True)
            break
    level = F.col("weight") * F.lit(left) / F.lit(weight) if weight else stop
    return ranked.select("source", "source_size", F.when(over, stop).otherwise(level).alias("target"))


def ticket(doc_id: Column, seed: int = SEED) -> Column:
    """Place of a document in the seeded order: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: source_size, target, whole repeats, and the end of the seeded order

    up to which documents are repeated once more: all tickets below ``edge``, and in that
    bucket those up to (``last.ticket``, ``last.size``).
    """
    sized = materialise(
        columns_of(docs, "doc_id", "source", "text").select("source", words_in(F.col("text")).alias("size"), ticket(F.col("doc_id"), seed).alias("ticket")),
        "mix-sizes",
    )
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("double")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = goals.withColumn("edge", F.lit("")).withColumn("before", F.lit(0).cast("long"))
    same = F.col("d.source").eqNullSafe(F.col("g.source"))
    for digits in LEVELS:
        # the bucket, at this many digits, in which the words taken in seeded order pass the budget
        inside = sized.alias("d").join(goals.alias("g"), same).where(F.col("d.ticket").startswith(F.col("g.edge")))
        cells = inside.groupBy("g.source", F.substring("ticket", 1, digits).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before")
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = cells.withColumn("upto", F.col("before") + F.sum("words").over(upto)).where("upto > rest")
        cut = running.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        goals = materialise(
            goals.drop("before", "edge").alias("g")
            .join(cut.alias("d"), same, "left").select("g.*", F.col("cut.bucket").alias("edge"), F.col("cut.before").alias("before")),
            "mix-goals",
        )
    order = Window.partitionBy("d.source").orderBy("d.ticket", "d.size").rowsBetween(Window.unboundedPreceding, 0)
    border = sized.alias("d").join(goals.alias("g"), same).where(F.substring("d.ticket", 1, LEVELS[-1]) == F.col("g.edge"))
    middle = F.col("before") + F.sum("d.size").over(order) - F.col("d.size") / 2.0
    last = border.select("d.source", "d.ticket", "d.size", "rest", middle.alias("middle")).where("middle <= rest").groupBy("source").agg(
        F.max(F.struct("ticket", "size")).alias("last")
    )
    return materialise(
        goals.alias("g").join(last.alias("d"), same, "left").select("g.source", "source_size", "target", "whole", "edge", "last"), "mix-plan"
    )


def _dealt(docs: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """(doc, size, source_size, target, repeats): documents against their source's plan."""
    box = F.col("doc")
    sized = boxed(docs).select(
        "doc", box["source"].alias("source"), words_in(box["text"]).alias("size"), ticket(box["doc_id"], seed).alias("ticket")
    )
    both = sized.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    bucket = F.substring("ticket", 1, LEVELS[-1])
    more = (
        F.when(F.col("edge").isNull() | (bucket < F.col("edge")), 1)
        .when((bucket == F.col("edge")) & (F.struct("ticket", "size") <= F.col("last")), 1)
        .otherwise(0)
    )
    repeats = F.when(F.col("size") > 0, F.col("whole").cast("long") + more).otherwise(0).cast("long")
    return both.select("doc", "size", "source_size", "target", repeats.alias("repeats"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken: one row per document."""
    goals = plan(docs, weights, share, max_epochs, seed)
    return _dealt(columns_of(docs, "doc_id", "source", "text"), goals, seed).select(
        "doc.doc_id", "doc.source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The mix itself: each document as often as it is repeated, in its own columns.

    A document without words is kept once: it has no words to weigh.
    """
    goals = plan(docs, weights, share, max_epochs, seed)
    times = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("repeats"))
    copies = F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")
    return unboxed(_dealt(docs, goals, seed).select("doc", copies), docs)


SQL = f"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) ticket
  from documents),
s as (
  select source, cast(sum(size) as bigint) source_size,
    case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double weight
  from d group by source),
o as (
  select *, row_number() over (order by source_size / weight, source is null, source) place,
    cast(sum(source_size) over () as double) total
  from s),
p as (
  select *, cast(coalesce(sum(2 * source_size) over (order by place rows between unbounded preceding and 1 preceding), 0) as double) stopped,
    cast(sum(weight) over (order by place rows between current row and unbounded following) as double) open_weight
  from o),
l as (
  select 1.5 * total - stopped as left_words, open_weight from p
  where weight * (1.5 * total - stopped) <= 2.0 * source_size * open_weight order by place limit 1),
t as (
  select s.source, source_size,
    case when left_words is null or weight * left_words > 2.0 * source_size * open_weight then 2.0 * source_size
      else weight * left_words / open_weight end::double target
  from s left join l on true),
g as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::double whole from t),
r as (
  select d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size rest,
    sum(d.size) over (partition by d.source order by d.ticket, d.size rows between unbounded preceding and current row) upto
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  cast(size * (whole + case when upto - size / 2.0 <= rest then 1 else 0 end) as bigint) taken
from r
"""
