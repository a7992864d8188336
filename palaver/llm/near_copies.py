"""Near copies by the similarity of their shingles, for the pipeline's near-duplicate stage.

Two documents are near copies if the sets of their shingles (five words in lower-cased A-Z;
a shorter text is one shingle) have a Jaccard similarity of ``LEAST`` = 0.8 or more. Links make
components; the first document of each stays.

SimHash. The hashes of a text's shingles make its 64-bit SimHash, and the trie self-join of
``simhash.links`` joins fingerprints within its budget of two bits. These pairs are confirmed
first; what they make one component meets no more below. At similarity 0.8 SimHash differs in
about ten bits, so the prints that follow find the pairs that lie beyond the trie's budget.

Prints. Each text has the smallest values of 96 seeded permutations of its shingle hashes.
Four of them at a time make ``BANDS`` = 24 prints: texts that agree in a print share a unit (of
pairs with similarity 0.8, three in a million share none). One bit of each value makes a binary
fingerprint in which such texts differ in about ten of 96 places; pairs beyond ``BUDGET`` are no
candidates (one in a million at 0.8). Every candidate is confirmed by its exact similarity.

Units of up to ``FEW`` texts give all their candidates. In a crowded one the members meet its
medoid only (the fingerprint closest to the majority of each bit): a group of copies of one text,
each edited on its own, becomes one component there. What stays apart in a crowded unit, mostly
texts that share a passage and little else, is dealt again by ``prefix_units``: shingles are ranked
by how many of these texts hold them, rarest first, and a text enters the units of its first
n - ceil(0.8 n) + 1 shingles. Two near copies share one of these, at places that leave enough
shingles behind them; a passage that many hold lies behind each text's own words and makes no
unit. Crowded ones of these units meet their medoid, too; then members outside the unit's largest
component go down a binary trie of the unit's fingerprints together with it, node pair by node
pair, and meet their nearest texts first and then all that are left and in another component.

No step cuts a unit: one with more than ``LIMIT`` members is dealt over parts, whose medoids meet
in turn and whose outsiders visit every part.

Cases: null or blank texts have no shingles and are copies of each other; a null id never
names a group unless all its ids are null; repeated rows count once; an empty table gives no
rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import simhash
from palaver.llm.common import columns_of, digest, materialise, only, text_of
from palaver.operators.components import components

SHINGLE = 5
LEAST = 0.8
BANDS = 24
ROWS = 4
SEED = 42
BUDGET = 26  # differing bits of 96
TRIE_BUDGET = 20  # differing bits of the first 64
FEW = 40  # texts in one unit that meet in all pairs
LIMIT = 16_384  # texts of one unit in one task
ASKERS = 256  # outsiders that go down the trie at once
NEAREST = 4  # texts that an outsider meets first
SHARE = 256  # pairs of one text in one part

_random = np.random.default_rng(SEED)
_FLIPS, _ODD = (_random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] for _ in range(2))
_ODD = (_ODD << np.uint64(1)) | np.uint64(1)
_SWAP = np.uint64(32)


# ---- texts -----------------------------------------------------------------------


def shingles(text: str, width: int = SHINGLE) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[k:] for k in range(width)])))


def similar(a: set[bytes], b: set[bytes], least: float = LEAST) -> bool:
    """Jaccard similarity of at least ``least``; two empty sets are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(a & b)
    return common >= least * (len(a) + len(b) - common)


def hashes_of(found: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):  # a block of hashes under all permutations stays in the cache
        mixed = (hashes[at: at + 512] ^ _FLIPS) * _ODD
        mixed ^= mixed >> _SWAP
        np.minimum(least, (mixed * _ODD).min(1), out=least)
    return least


def prints_of(least: np.ndarray) -> np.ndarray:
    """BANDS unsigned 64-bit values; equal sets have equal ones."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def bits_of(least: np.ndarray) -> tuple[int, int]:
    """One bit of each value: 64 bits, and the other 32."""
    bits = np.zeros(128, np.uint8)
    bits[: len(least)] = (least >> np.uint64(17)) & np.uint64(1)
    return tuple(int(x) for x in np.packbits(bits).view(">i8"))


# ---- units -----------------------------------------------------------------------


class Members:
    """Rows of one or many units: node, shingles n, place p of the unit in the text, bits, root, and asker."""

    FIELDS = ("unit", "node", "n", "p", "high", "low", "root", "asks")

    def __init__(self, rows: pa.Table):
        for name in self.FIELDS:
            setattr(self, name, rows.column(name).to_numpy())
        self.high, self.low = self.high.view(np.uint64), self.low.view(np.uint64)

    def __len__(self) -> int:
        return len(self.node)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.high[i] ^ self.high[j]).astype(np.int64) + np.bitwise_count(self.low[i] ^ self.low[j])

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs in different components that can reach the similarity, by what follows their places and by their bits."""
        enough = np.ceil(LEAST / (1 + LEAST) * (self.n[i] + self.n[j]) - 1e-9)
        left = np.minimum(self.n[i] - self.p[i], self.n[j] - self.p[j])
        return (self.root[i] != self.root[j]) & (left >= enough) & (self.differing(i, j) <= BUDGET)


PAIR = "a long, b long"


def _by_unit(answer: Callable[[Members], Iterator[tuple]], names: list[str]):
    """Runs ``answer`` on each unit (and part) of sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def answered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            unit, part = rows.column("unit").to_numpy(), rows.column("part").to_numpy()
            edges = np.flatnonzero((unit[1:] != unit[:-1]) | (part[1:] != part[:-1])) + 1
            every = Members(rows)
            out = [answer(every, a, b) for a, b in zip([0, *edges], [*edges, len(unit)])]
            columns = [np.concatenate(c) for c in zip(*out)]
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            unit, part = held.column("unit").to_numpy(), held.column("part").to_numpy()
            before = np.flatnonzero((unit != unit[-1]) | (part != part[-1]))
            whole = int(before[-1]) + 1 if len(before) else 0  # the last unit may go on in the next batch
            if whole:
                yield from answered(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None:
            yield from answered(held)

    return run


def all_pairs(m: Members, start: int, end: int) -> tuple:
    i, j = np.triu_indices(end - start, 1)
    i, j = i + start, j + start
    fit = m.possible(i, j)
    return m.node[i[fit]], m.node[j[fit]]


def medoid_pairs(m: Members, start: int, end: int) -> tuple:
    """The unit, and its medoid with itself and each member it can be alike to."""
    bits = np.unpackbits(np.stack([m.high[start:end], m.low[start:end]], 1).astype(">u8").view(np.uint8).reshape(end - start, 16), axis=1)
    majority = 2 * bits.sum(0, dtype=np.int64) > end - start
    far = (bits != majority).sum(1)
    middle = start + int(np.lexsort((m.node[start:end], far))[0])
    j = np.arange(start, end)
    i = np.full(len(j), middle)
    fit = m.possible(i, j) | (j == middle)  # its own row names the medoid
    return m.unit[j[fit]], m.node[i[fit]], m.node[j[fit]]


def outside_pairs(m: Members, start: int, end: int, nearest: int | None) -> tuple:
    """Askers with members of other components: the ``nearest``, or all that can be alike."""
    place = np.arange(start, end)
    ask, held = place[m.asks[start:end]], place[~m.asks[start:end]]
    if not len(ask) or not len(held):
        return m.node[:0], m.node[:0]
    some = [_outside(m, a, held, nearest) for a in np.array_split(ask, -(-len(ask) // ASKERS))]
    return tuple(np.concatenate(side) for side in zip(*some))


def _outside(m: Members, ask: np.ndarray, held: np.ndarray, nearest: int | None) -> tuple:
    (left, of_left), (right, of_right) = [np.unique(m.high[side], return_inverse=True) for side in (ask, held)]
    found = simhash.traverse(np.concatenate([left, right]), np.array([[0, len(left), len(left), len(left) + len(right), 0]], np.int64), TRIE_BUDGET)
    # values to their members
    by_left, by_right = np.argsort(of_left, kind="stable"), np.argsort(of_right, kind="stable")
    n_left, n_right = np.bincount(of_left), np.bincount(of_right)
    at_left, at_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    x, y = found[:, 0], found[:, 1] - len(left)
    size = n_left[x] * n_right[y]
    pair = np.repeat(np.arange(len(found)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i = ask[by_left[at_left[x[pair]] + k // n_right[y[pair]]]]
    j = held[by_right[at_right[y[pair]] + k % n_right[y[pair]]]]
    fit = m.possible(i, j)
    i, j = i[fit], j[fit]
    if nearest is not None and len(i):
        order = np.lexsort((m.node[j], m.differing(i, j), i))
        i, j = i[order], j[order]
        first = np.maximum.accumulate(np.where(np.append(True, i[1:] != i[:-1]), np.arange(len(i)), 0))
        near = np.arange(len(i)) - first < nearest
        i, j = i[near], j[near]
    return m.node[i], m.node[j]


# ---- jobs -------------------------------------------------------------------------


class Links:
    """Nodes (one per text), their texts, and the components that the pairs confirmed so far make."""

    def __init__(self, docs: DataFrame):
        key = F.unhex(F.md5(F.col("text")))
        self.held: DataFrame | None = None
        self.source = columns_of(docs, "doc_id", "text").select("doc_id", digest().alias("digest"), text_of().alias("text")).withColumn("key", key)
        made = materialise(self.source.mapInArrow(
            self._describe, "doc_id long, digest long, key binary, n int, fp long, prints array<long>, high long, low long"), "near-prints")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
        same = [F.first(c).alias(c) for c in ("n", "fp", "prints", "high", "low")]
        nodes = made.groupBy("key").agg(first, *same).withColumn("node", F.monotonically_increasing_id())
        self.nodes = materialise(nodes, "near-nodes")
        self.roots = self.nodes.sparkSession.createDataFrame([], "node long, root long")

    @staticmethod
    def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column("text"):
                found = shingles(t.as_py())
                hashes = hashes_of(found)
                least = least_values(hashes)
                made.append((len(found), simhash.fingerprint_of(hashes), prints_of(least).view(np.int64), *bits_of(least)))
            n, fp, prints, high, low = zip(*made) if made else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "digest", "key")], pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)),
                 pa.array(prints, pa.list_(pa.int64())), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                ["doc_id", "digest", "key", "n", "fp", "prints", "high", "low"],
            )

    def fingerprint_pairs(self) -> DataFrame:
        """Pairs that the SimHash trie joins: a fingerprint's first node with its others, and with the first of a linked one."""
        firsts = materialise(self.nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
        named = lambda fp, node: firsts.select(F.col("fp").alias(fp), F.col("first").alias(node))
        linked = simhash.links(firsts.select("fp")).join(named("fp", "a"), "fp").join(named("to", "b"), "to")
        same = self.nodes.select("fp", F.col("node").alias("b")).join(named("fp", "a"), "fp").where("a <> b")
        return materialise(linked.select("a", "b").unionByName(same.select("a", "b")), "near-trie-pairs")

    def hold_texts(self, units: DataFrame) -> None:
        """Keep the texts of all nodes that share a unit or a pair: the documents are shuffled once, however often texts are needed."""
        keys = materialise(self.nodes.join(units.select("node").distinct(), "node", "left_semi").select("node", "key"), "near-keys")
        # the keys grow with the documents: never broadcast, so the plan is the same at every size
        found = self.source.select("key", "text").join(keys.hint("merge"), "key")
        self.held = materialise(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted nodes."""
        return materialise(self.held.join(wanted.select("node").distinct(), "node", "left_semi"), "near-some-texts")

    def members(self, units: DataFrame) -> DataFrame:
        """Rows of units (unit, node, p) with what tells their nodes apart and their components."""
        return units.join(self.nodes.select("node", "n", "high", "low"), "node").join(self.roots, "node", "left").select(
            "unit", F.lit(0).alias("part"), "node", "n", "p", "high", "low", F.coalesce("root", "node").alias("root"), F.lit(True).alias("asks")
        )

    def confirm(self, pairs: DataFrame) -> None:
        """Keep the pairs whose texts are near copies. A text's pairs are dealt over parts, each with the text once."""
        one = pairs.where("a <> b").groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct("a", "b")).alias("pair"))
        pairs = materialise(one.select("pair.a", "pair.b"), "near-pairs")
        if pairs.isEmpty():
            return
        parts = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("parts")), "near-parts")
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        first = dealt.select("a", "part").distinct().join(texts.withColumnsRenamed({"node": "a", "text": "a_text"}), "a")
        both = dealt.join(texts.withColumnsRenamed({"node": "b", "text": "b_text"}), "b").join(first, ["a", "part"])
        found = materialise(both.select("a", "b", "a_text", "b_text").mapInArrow(_confirm, PAIR), "near-confirmed")
        self._join(found)

    def _join(self, found: DataFrame) -> None:
        """Add confirmed pairs: only components they connect take part in the new search for components."""
        root = lambda end: self.roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        known = found.join(root("a"), "a", "left").join(root("b"), "b", "left")
        ends = materialise(known.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b"), "near-links")
        if ends.isEmpty():
            return
        stars = components(ends, "a", "b")
        stars = materialise(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "near-stars")
        to = stars.select(F.col("node").alias("root"), F.col("root").alias("to"))
        moved = self.roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        self.roots = materialise(moved.unionByName(stars.join(self.roots, "node", "left_anti")), "near-roots")

    def meet(self, units: DataFrame, answer, *more) -> DataFrame:
        return _dealt(units).mapInArrow(_by_unit(lambda m, a, b: answer(m, a, b, *more), ["a", "b"]), PAIR)

    def settle(self, small: DataFrame, crowded: DataFrame, limit: int) -> None:
        """All pairs of small units; members of crowded ones meet the medoid of their part, and medoids meet in turn."""
        pairs = self.meet(self.members(small), all_pairs)
        rows = crowded
        while not rows.isEmpty():
            rows = materialise(self.members(rows), "near-members")
            sizes = materialise(rows.groupBy("unit").agg(F.ceil(F.count("*") / limit).alias("parts")), "near-sizes")
            part = F.pmod(F.xxhash64("node"), "parts").cast("int")
            dealt = _dealt(rows.join(sizes, "unit").withColumn("part", part))
            run = _by_unit(medoid_pairs, ["unit", "a", "b"])
            met = materialise(dealt.mapInArrow(run, "unit long, a long, b long"), "near-medoids")
            pairs = pairs.unionByName(met.select("a", "b"))
            middles = met.where("a = b").join(sizes.where("parts > 1"), "unit", "left_semi")
            rows = middles.select("unit", F.col("a").alias("node"), F.lit(0).alias("p")).distinct()
        self.confirm(pairs)

    def apart(self, units: DataFrame) -> DataFrame:
        """Members of the units that hold more than one component, with the unit's largest as ``main``."""
        rows = self.members(units)
        counts = materialise(rows.groupBy("unit", "root").agg(F.count("*").alias("held")), "near-shares")
        main = counts.groupBy("unit").agg(F.count("*").alias("roots"), F.max(F.struct("held", "root")).alias("most"), F.sum("held").alias("size"))
        main = materialise(main.where("roots > 1").select("unit", F.col("most.root").alias("main"), "size"), "near-main")
        return materialise(rows.join(main, "unit"), "near-apart")

    def outsiders(self, units: DataFrame, nearest: int | None, limit: int) -> None:
        """Members outside the largest component of their unit meet members of other components."""
        rows = self.apart(units).withColumn("parts", F.ceil(F.col("size") / limit).cast("int"))
        held = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("asks", F.lit(False))
        asking = rows.where("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        self.confirm(self.meet(asking.unionByName(held), outside_pairs, nearest))

    def prefix_units(self, crowd: DataFrame) -> DataFrame:
        """(unit, node, p): the rarest shingles of each text of the crowd, p of its shingles being rarer."""
        texts = self.texts(crowd)
        postings = materialise(texts.mapInArrow(_postings, "unit long, node long, n int"), "near-postings")
        shared = materialise(postings.groupBy("unit").agg(F.count("*").alias("texts")).where("texts > 1"), "near-ranks")
        ranked = postings.join(shared, "unit")
        # a text at a time: the shingles that others hold, rarest first, behind those that none does
        mine = ranked.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "unit"))).alias("ranks"))
        own = F.col("n") - F.size("ranks")
        places = F.transform("ranks", lambda r, k: F.struct(r["unit"].alias("unit"), (own + k).alias("p")))
        first = F.col("n") - F.ceil(LEAST * F.col("n") - 1e-9) + 1
        kept = mine.select("node", F.explode(F.filter(places, lambda x: x["p"] < first)).alias("place"))
        return materialise(kept.select("place.unit", "node", F.col("place.p").cast("int").alias("p")), "near-prefix")


def _dealt(rows: DataFrame) -> DataFrame:
    """Units and parts side by side."""
    return rows.repartition("unit", "part").sortWithinPartitions("unit", "part").select("part", *Members.FIELDS)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, of_last = None, set()
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("a_text"), batch.column("b_text")):
            text = a.as_py()
            if text != last:
                last, of_last = text, shingles(text)
            kept.append(similar(of_last, shingles(b.as_py())))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
            found = hashes_of(shingles(text.as_py())).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(len(found), node)), pa.array(np.full(len(found), len(found), np.int32))], ["unit", "node", "n"]
            )


def _sized(units: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """Units of two to ``few`` members, and larger ones."""
    sizes = materialise(units.groupBy("unit").agg(F.count("*").alias("size")).where("size > 1"), "near-sizes")
    parts = [units.join(sizes.where(rule), "unit", "left_semi") for rule in (F.col("size") <= few, F.col("size") > few)]
    return parts[0], materialise(parts[1], "near-crowded")


def link(docs: DataFrame, few: int = FEW, limit: int = LIMIT) -> Links:
    """All nodes with their components."""
    links = Links(docs)
    bands = links.nodes.select(F.explode("prints").alias("unit"), "node", F.lit(0).alias("p"))
    small, crowded = _sized(bands, few)
    pairs = links.fingerprint_pairs()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links.hold_texts(small.unionByName(crowded).select("node").unionByName(ends))
    links.confirm(pairs)
    links.settle(small, crowded, limit)
    crowd = materialise(links.apart(crowded).select("node").distinct(), "near-crowd-nodes")
    if not crowd.isEmpty():
        small, crowded = _sized(links.prefix_units(crowd), few)
        links.settle(small, crowded, limit)
        for nearest in (NEAREST, None):
            links.outsiders(crowded, nearest, limit)
    return links


def drop_near_copies(docs: DataFrame, few: int = FEW, limit: int = LIMIT) -> DataFrame:
    """One document of each group of near copies (the first), in the documents' own columns."""
    links = link(docs, few, limit)
    named = materialise(links.roots.join(links.nodes.select("node", "first"), "node"), "near-named")
    firsts = materialise(named.groupBy("root").agg(F.min("first").alias("least")), "near-firsts")
    copies = materialise(named.join(firsts, "root").where("first <> least").select("node"), "near-copies")
    return only(docs, links.nodes.join(copies, "node", "left_anti").select("first.doc_id", "first.digest"))
