import random
import re

import numpy as np
import pytest
import xxhash
from cases import ODD, clashing, documents
from pyspark.sql import functions as F

from palaver.llm import simhash, topk


def brute_top(rows, k):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    for q, a in ok:
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("same", [0, 150])
def test_top_k_equals_brute_force(spark, same):
    rng = random.Random(same)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows[:same] = [(i, rows[0][1]) for i in range(same)]  # ties
    rows += [(1001, None), (None, [1.0] * 8), (1002, [None] * 8), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8),
             (1020, []), (1005, [2.0, -1.0]), (1040, [3e4] * 8)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(rows, 5)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_lanes_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "LANE_VECTORS", 60)
    monkeypatch.setattr(topk, "LANE_QUERIES", 4)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(rows, 3)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, budget):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= budget and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints():
    for _, text, _ in ODD:
        assert simhash.fingerprint(text or "") == brute_print(text)


@pytest.mark.parametrize("limit", [16_384, 12])
def test_trie_join_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:20]:
        for _ in range(4):
            v ^= 1 << rng.randrange(64)
            values.add(v)
            v ^= 1 << rng.randrange(64)
            values.add(v)
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << b) for b in range(30)} | {0, (1 << 64) - 1}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    expected = brute_components([v & (1 << 64) - 1 for v in signed], 2)
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, limit, step=3)
    stars = simhash.components(links, "fp", "to").collect()
    root = {v: v for v in signed} | {r["node"]: r["root"] for r in stars}
    groups = lambda m: sorted(sorted(k & (1 << 64) - 1 for k in m if m[k] == r) for r in set(m.values()))
    assert groups(root) == groups(expected)


def test_near_groups_cases(spark):
    docs = clashing(documents(spark, ODD))
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[1] == by[2] == {1}
    assert by[3] == by[4] == by[5] == {3}  # fingerprint zero
    assert by[6] == by[7] == {6}
    assert by[None] == {None}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 6, 8, 9]
    assert simhash.near_groups(docs.limit(0)).count() == 0
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
