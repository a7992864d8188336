"""Hard negatives against plain loops."""

import random

import numpy as np
import pytest
from cases import clashing
from pyspark.sql import functions as F

from palaver.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3):
    ok = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for a, u, own in ok:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i, label) for i, v, label in ok if i != a)
        for s, p, label in [r for r in scored if r[2] == own][:positives]:
            inside = [(n, m) for m, n, other in scored if other != own and 50 * -s <= 100 * -m <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -m) for k, (n, m) in enumerate(inside)]
    return sorted(out)


def found(df, **options):
    rows = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


def table(seed, same=0, labels=4, n=700, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]
    rows[:same] = [(i, rows[0][1], rows[0][2] if i % 3 else 1 - rows[0][2] % 2) for i in range(same)]  # ties
    return rows


ODD = [
    (1050, None, 1), (None, [1.0] * 6, 1), (1051, [None] * 6, 1), (1052, [float("nan")] * 6, 2), (1053, [float("inf")] * 6, 2),
    (1100, [], 1), (1150, [2.0, -1.0], 2), (1200, [1.0] * 6, None), (1250, [0.0] * 6, 3), (1300, [1.0] * 9, 0), (1301, [1.0] * 9, 0),
    (1302, [0.9] * 9, 1), (1303, [0.7] * 9, 2),
]


@pytest.mark.parametrize("same", [0, 250])
def test_equals_brute_force(spark, same):
    rows = table(same, same) + ODD
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert found(df) == brute(rows)


def test_small_lanes_give_the_same(spark):
    rows = table(3, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    options = {"shard_rows": 60, "group_rows": 2, "block": 16, "tile": 3}
    assert found(df, **options) == found(df, references=1) == brute(rows)


def test_far_groups_make_no_lanes(spark):
    """Two directions at right angles: groups of one and shards of the other hold nothing for each other."""
    rng = random.Random(9)
    rows = [(i, [(10 if (i % 2) == axis else 0) + rng.gauss(0, 0.1) for axis in range(2)], i % 4) for i in range(800)]
    lanes = []
    real = hn._lanes

    def counted(*args):
        lanes.append(real(*args).collect())
        return real(*args)

    hn._lanes = counted
    try:
        got = found(spark.createDataFrame(rows, SCHEMA), shard_rows=50, group_rows=4, block=10)
    finally:
        hn._lanes = real
    assert got == brute(rows)
    # each group meets fewer than half of all shards in either search
    for pairs in lanes:
        groups, shards = {g for g, _ in pairs}, {s for _, s in pairs}
        assert len(pairs) <= 0.6 * len(groups) * len(shards)


def test_huge_components_are_exact(spark):
    rows = [(i, [2.0**17 * (i + 1), float(i)], i % 2) for i in range(0, 60)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = np.floor(256 * rng.normal(size=(40, 5))), np.floor(256 * rng.normal(size=(60, 5)))
    b[:5], b[5] = a[:5] * 2, 0
    away = hn.pick_references(a, 4)
    spans = []
    for rows in (a, b):
        norms = hn.norms_of(rows)
        angles = hn.angles_to(rows, norms, away)
        spans.append(((angles, angles), (norms, norms)))
    lower, upper = hn.score_bounds(*spans[0], *spans[1], 5)
    true = a @ b.T
    assert (lower <= true).all() and (true <= upper).all()
    start, end = hn.window_of(np.arange(-500, 500))
    for p, s, e in zip(range(-500, 500), start, end):
        assert [n for n in range(-600, 600) if 50 * p <= 100 * n <= 95 * p] == list(range(s, e + 1))


def test_few_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)) == []
    twice = [(50, [1.0], 1), (50, [1.0], 1), (1, [1.0], 1), (2, [0.8], 2), (2, [0.8], 2)]
    assert found(spark.createDataFrame(twice, SCHEMA)) == brute(twice)
