"""Near copies of the pipeline: edited texts that SimHash within two bits does not link."""

import random

import numpy as np
import pyarrow as pa
from cases import ODD, clashing, documents

import corpus_pipeline
from palaver.llm import near_copies


def brute_kept(rows: list[tuple]) -> list:
    """Ids of the first document of each component of pairs with similarity 0.8 or more, by plain loops."""
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) / either >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(rows[k][0] for k in range(len(rows)) if root[k] == k)


def edited(words: list[str], places: list[int], by: str) -> str:
    return " ".join(f"{by}{k}" if k in places else w for k, w in enumerate(words))


def test_edited_copies_leave(spark):
    rng = random.Random(7)
    rows = []
    for n in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append((10 * n, " ".join(words)))
        rows.append((10 * n + 1, edited(words, [50], "x")))  # similarity 0.83
        rows.append((10 * n + 2, edited(words, [10, 30, 50, 70], "y")))  # below 0.8
    got = corpus_pipeline.deduplicate_near(spark, documents(spark, [(i, t, "a") for i, t in rows]), "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows) == sorted(i for i, _ in rows if i % 10 != 1)


def kept(df, **options):
    return sorted(r["doc_id"] for r in near_copies.drop_near_copies(df, **options).collect())


def cloud(rng, size, edits, start=0):
    """Copies of one text, each edited on its own: many are near copies of the text, few of each other."""
    base = [f"w{k}" for k in range(200)]
    rows = [(start + k, edited(base, rng.sample(range(200), rng.choice(edits)), f"e{k}_")) for k in range(size)]
    return [*rows, (start + size, " ".join(base))]


def test_clouds_of_copies(spark):
    rng = random.Random(8)
    for edits in ([0, 1, 2, 3, 6], [4, 5]):
        rows = cloud(rng, 60, edits)
        docs = documents(spark, [(i, t, "a") for i, t in rows])
        assert kept(docs, few=3) == brute_kept(rows)


def test_chains_of_copies(spark):
    """Each text is a near copy of the next only, so no text is near to many."""
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(words[3 * k: 3 * k + 60])) for k in range(80)]
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    for options in ({}, {"few": 2, "limit": 7}):
        assert kept(docs, **options) == brute_kept(rows) == [0]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    own = [[f"o{rng.randrange(10**6)}" for _ in range(30)] for _ in range(160)]
    rows = [(k, " ".join([*w[:15], *passage, *w[15:]])) for k, w in enumerate(own)]
    rows += [(200 + k, edited(rows[k][1].split(), [40], "x")) for k in range(20)]  # near copies among them
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    sizes = []
    confirm = near_copies.Links.confirm

    def counted(self, pairs):
        pairs = near_copies.materialise(pairs, "counted")
        sizes.append(pairs.where("a <> b").count())
        confirm(self, pairs)

    monkeypatch.setattr(near_copies.Links, "confirm", counted)
    assert kept(docs) == brute_kept(rows) == list(range(160))
    assert sum(sizes) < 24 * len(rows)  # all pairs: 16,110


def test_parts_of_large_units(spark):
    rng = random.Random(12)
    rows = cloud(rng, 90, [0, 2, 4, 6, 7]) + cloud(rng, 30, [1, 9], 100)
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    assert kept(docs, few=3, limit=20) == kept(docs) == brute_kept(rows)


def test_tries_find_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    n = 300
    high = rng.integers(0, 1 << 63, n, np.int64) & rng.integers(0, 1 << 63, n, np.int64) & rng.integers(0, 1 << 63, n, np.int64)
    high[:40] = high[0]
    columns = {"unit": np.zeros(n, np.int64), "part": np.zeros(n, np.int64), "node": np.arange(n), "n": np.full(n, 50), "p": np.zeros(n, np.int64),
               "high": high, "low": np.zeros(n, np.int64), "root": rng.integers(0, 40, n), "asks": rng.random(n) < 0.3}
    m = near_copies.Members(pa.table(columns))
    bits = lambda i, j: (int(high[i]) ^ int(high[j])).bit_count()
    want = {(i, j) for i in range(n) for j in range(n) if m.asks[i] and not m.asks[j] and m.root[i] != m.root[j]
            and bits(i, j) <= near_copies.TRIE_BUDGET}
    assert set(zip(*near_copies.outside_pairs(m, 0, n, None))) == want and len(want) > 1000
    some = list(zip(*near_copies.outside_pairs(m, 0, n, 2)))
    for i in {i for i, _ in want}:
        mine = sorted((bits(i, j), j) for a, j in want if a == i)[:2]
        assert sorted(j for a, j in some if a == i) == sorted(j for _, j in mine)


def test_odd_texts(spark):
    docs = clashing(documents(spark, ODD))
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 3, 6, 8, 9]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_simhash_trie_gives_pairs_and_components(spark):
    """Fingerprints as a plain loop makes them; pairs within two bits are joined before any print is looked at."""
    import random

    import xxhash

    from palaver.llm import near_copies as nc

    dice = random.Random(7)
    base = [[f"w{dice.randrange(5000)}" for _ in range(600)] for _ in range(6)]
    texts = {i: " ".join(words) for i, words in enumerate(base)}
    texts |= {10 + i: " ".join([*words[:-1], "other"]) for i, words in enumerate(base)}
    docs = spark.createDataFrame([*texts.items(), (99, ""), (98, None)], "doc_id long, text string")
    links = nc.Links(docs)
    plain = {}
    for i, text in texts.items():
        words = text.encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k: k + 5]), 42) for k in range(len(words) - 4)]
        hashes = set(hashes)
        plain[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = {r["first"]["doc_id"]: r for r in links.nodes.collect()}
    assert {i: rows[i]["fp"] & (1 << 64) - 1 for i in texts} == plain and rows[98]["fp"] == 0
    near = {(i, j) for i in texts for j in texts if i < j and (plain[i] ^ plain[j]).bit_count() <= 2}
    doc = {r["node"]: i for i, r in rows.items()}
    pairs = links.fingerprint_pairs()
    assert {tuple(sorted((doc[p["a"]], doc[p["b"]]))) for p in pairs.collect()} == near and len(near) >= 4
    links.hold_texts(pairs.selectExpr("explode(array(a, b)) as node"))
    links.confirm(pairs)
    root = {doc[r["node"]]: r["root"] for r in links.roots.collect()}
    assert all(root[i] == root[j] for i, j in near) and set(root) == {i for p in near for i in p}
