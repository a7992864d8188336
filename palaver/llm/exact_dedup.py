"""Exact duplicates through an extendible-hash index in shared files.

* Each document gives one entry: a 64-bit hash of its text and the text's SHA-256. A task adds
  up the entries of one text it meets in a batch, so a text held by a third of all rows sends a
  row per batch to its owner.
* The directory has ``2 ** depth`` slots, named by the first bits of the hash. A bucket of
  more than ``capacity`` rows is split by its next bit; if no spare bit is left in the
  directory, the directory doubles. It is computed from counts of the first 16 bits (at most
  65,536 numbers, the only thing the driver sees); at that depth buckets simply grow.
* An owner task receives whole buckets, a range of hashes, and decides the groups: under each
  hash it keeps a chain of links, a row joins the link with its SHA-256 or becomes a new one.
  The index holds bucket, chain, copies and keeper of each link; documents look up theirs there.
* The bytes of the texts in links with copies are compared. A link that holds several texts is
  settled by them: its documents are grouped by their bytes instead.

Cases: a null text counts as empty; of rows with the same id and text one stays; a null id
comes after all ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, materialise, only, text_of

CAPACITY = 10_000  # rows in a bucket
DIRECTORY_BITS = 16


class Directory:
    """Slots by hash prefix; each bucket knows how many bits it uses."""

    def __init__(self, capacity: int = CAPACITY, most_bits: int = DIRECTORY_BITS):
        self.capacity, self.most_bits = capacity, most_bits
        self.depth = 0
        self.slots = [0]  # bucket of each prefix
        self.bits = [0]  # bits used by each bucket

    def fill(self, cells: Iterable[tuple[int, int]]) -> Directory:
        """Load counts by the first ``most_bits`` bits and split until no bucket is overfull."""
        count = {0: list(cells)}
        overfull = [0]
        while overfull:
            bucket = overfull.pop()
            held = count[bucket]
            if sum(n for _, n in held) <= self.capacity or self.bits[bucket] == self.most_bits:
                continue
            if self.bits[bucket] == self.depth:
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            self.bits[bucket] += 1
            twin = len(self.bits)
            self.bits.append(self.bits[bucket])
            shift = self.most_bits - self.bits[bucket]
            count[bucket] = [c for c in held if not c[0] >> shift & 1]
            count[twin] = [c for c in held if c[0] >> shift & 1]
            span = self.depth - self.bits[bucket]
            for slot, b in enumerate(self.slots):
                if b == bucket and slot >> span & 1:
                    self.slots[slot] = twin
            overfull += [bucket, twin]
        return self


def _prefix(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits).cast("int") if bits else F.lit(0)


LINK = "hash long, sha binary, copies long, id long, has_id boolean, row long"
_LINK = pa.schema([("hash", pa.int64()), ("sha", pa.binary()), ("copies", pa.int64()), ("id", pa.int64()), ("has_id", pa.bool_()), ("row", pa.int64())])


def _later(a: tuple, b: tuple) -> tuple:
    """Of two links with one text: the copies of both, and the later keeper (has id, id, row)."""
    return a[0] + b[0], max(a[1], b[1])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one text in a batch as one row."""
    for batch in batches:
        found: dict[tuple, tuple] = {}
        for doc_id, hash_, sha, row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "hash", "sha", "row")]):
            mine = 1, (doc_id is not None, doc_id or 0, row)
            held = found.get((hash_, sha))
            found[hash_, sha] = mine if held is None else _later(held, mine)
        rows = [(*key, copies, i, has, row) for key, (copies, (has, i, row)) in found.items()]
        columns = zip(*rows) if rows else [()] * len(_LINK)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINK)], schema=_LINK)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner of sorted buckets: rows with the link's digest join it, others extend the chain of their hash."""
    names = ["bucket", "chain", *_LINK.names]
    kinds = [pa.int32(), pa.int32(), *_LINK.types]
    here, links, out = None, {}, []

    def close() -> None:
        bucket, hash_ = here
        for k, (sha, (copies, (has, i, row))) in enumerate(links.items(), 1):
            out.append((bucket, k, hash_, sha, copies, i, has, row))

    for batch in batches:
        for bucket, hash_, sha, copies, i, has, row in zip(*[batch.column(c).to_pylist() for c in ("bucket", *_LINK.names)]):
            if (bucket, hash_) != here:
                if links:
                    close()
                here, links = (bucket, hash_), {}
            mine = copies, (has, i, row)
            links[sha] = mine if sha not in links else _later(links[sha], mine)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out = []
    if links:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bucket, chain, hash, sha, copies, id, has_id, row) in shared files: a row for each link."""
    rows = materialise(entries.select("doc_id", "hash", "sha", "row").mapInArrow(_combine, LINK), "dedup-rows")
    cells = rows.groupBy(_prefix(F.col("hash"), DIRECTORY_BITS).alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    directory = Directory(capacity).fill((r["cell"], r["keys"]) for r in cells.collect())
    slots = entries.sparkSession.createDataFrame(list(enumerate(directory.slots)), "slot int, bucket int")
    # at most 65,536 slots
    placed = rows.withColumn("slot", _prefix(F.col("hash"), directory.depth)).join(F.broadcast(slots), "slot")
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "hash").select("bucket", *_LINK.names)
    return materialise(owned.mapInArrow(_chain, f"bucket int, chain int, {LINK}"), "dedup-index")


def clashes(docs: DataFrame, index: DataFrame, hash_of, sha_of) -> DataFrame:
    """(hash, sha) of links that hold different texts, by the bytes of all texts in links with copies."""
    repeated = materialise(index.where("copies > 1").select("hash").distinct(), "dedup-repeated")
    texts = docs.select(text_of().alias("text")).withColumn("hash", hash_of(F.col("text")))
    held = texts.join(repeated, "hash", "left_semi").groupBy("hash", "text").agg(F.count(F.lit(1)).alias("copies"))
    held = held.select("hash", sha_of(F.col("text")).alias("sha"))  # each text once
    return materialise(held.groupBy("hash", "sha").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash", "sha"), "dedup-clashes")


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hash_of=F.xxhash64, sha_of=_sha) -> DataFrame:
    """doc_id, row, hash, sha, keep_id, group_size, kept: one row per document."""
    source = columns_of(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    keyed = source.select("doc_id", "text", hash_of(F.col("text")).alias("hash"), sha_of(F.col("text")).alias("sha"))
    entries = materialise(keyed.select("doc_id", "hash", "sha", F.monotonically_increasing_id().alias("row")), "dedup-entries")
    index = build_index(entries, capacity)
    wrong = clashes(source, index, hash_of, sha_of)

    keeper = F.when(F.col("has_id"), F.col("id"))
    links = index.select("hash", "sha", "copies", keeper.alias("keep_id"), F.col("row").alias("keep_row"))
    settled = wrong.isEmpty()
    plain = entries if settled else entries.join(wrong, ["hash", "sha"], "left_anti")
    out = ["doc_id", "row", "hash", "sha", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept")]
    groups = plain.join(links, ["hash", "sha"]).select(*out)
    if settled:
        return groups
    # rows of their own, numbered below zero: the texts of links that hold several
    rows = materialise(keyed.join(wrong, ["hash", "sha"], "left_semi").withColumn("row", -1 - F.monotonically_increasing_id()), "dedup-clashing")
    same = rows.groupBy("hash", "sha", "text").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("doc_id", "row")).alias("keeper"))
    same = materialise(same.select("text", "copies", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.row").alias("keep_row")), "dedup-settled")
    return groups.unionByName(rows.join(same, "text").select(*out))


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents without exact copies, in their own columns."""
    kept = exact_groups(docs, capacity).where("kept").select("doc_id", F.col("hash").alias("digest"))
    return only(docs, kept)


SQL = """
with d as (select doc_id, coalesce(text, '') as txt from documents),
g as (
  select txt, max(doc_id) keep_id, count(*) group_size from d group by txt)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.txt) text_sha256
from d join g using (txt)
"""
