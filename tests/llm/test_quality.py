"""Positive-unlabelled quality classifier: gradients, prior, what may be learned from, held-out accuracy."""

import zlib

import numpy as np
import pytest
from cases import ODD, clashing, documents
from pyspark.sql import functions as F

from palaver.llm import quality


def plain_shares(text):
    """The words' part of the description, word by word."""
    words = text.encode().split()
    n = max(1, len(words))
    freq = sorted((words.count(w) for w in set(words)), reverse=True)
    return [np.log1p(len(words)), len(set(words)) / n, (len({(a, b) for a, b in zip(words, words[1:])}) + 1) / n,
            sum(words[k] == words[k - 1] for k in range(1, len(words))) / n, sum(freq[:3]) / n]


def test_shares():
    for _, text, _ in ODD:
        found = quality.shares_of(text or "")
        assert len(found) == len(quality.SHARES) and np.isfinite(found).all()
        if text and len(text) < 1000:
            assert np.allclose(found[7:12], plain_shares(text))
    loud = dict(zip(quality.SHARES, quality.shares_of("AB! a1")))
    assert (loud["upper"], loud["loud"], loud["digit"], loud["wordless"]) == (2 / 6, 1 / 6, 1 / 6, 0)


def synthetic(seed=1, n=3000, prior=0.7):
    rng = np.random.default_rng(seed)
    kinds = len(quality.SHARES)
    good = lambda k: rng.normal(0, 1, (k, kinds))
    bad = lambda k: rng.normal(0, 1, (k, kinds)) + np.where(np.arange(kinds) < 4, 3, 0)
    hidden = rng.random(n) < prior
    return good(n // 2), np.where(hidden[:, None], good(n), bad(n)), hidden


def test_prior_and_accuracy_of_a_known_mixture():
    for prior in (0.3, 0.7, 0.9):
        positive, unlabelled, hidden = synthetic(prior=prior)
        model = quality.learn(positive, unlabelled)
        assert abs(model.prior - prior) < 0.06
        assert ((model.score(unlabelled) >= 0.5) == hidden).mean() > 0.97


def test_slope_of_the_risk(monkeypatch):
    positive, unlabelled, _ = synthetic(2, 400)
    edges = quality.edges_of(positive)
    p, u = quality.bins(positive, edges), quality.bins(unlabelled, edges)
    width = len(edges) * quality.width_of(edges)
    rng = np.random.default_rng(0)
    w = rng.normal(0, 0.05, width + 1)
    seen = []
    monkeypatch.setattr(quality, "_descend", lambda slope, *_: seen.append(slope) or w)
    quality.fit(p, u, 0.6, width, quality.width_of(edges), 0.0)
    for prior_w in (w, w - 3 * np.eye(width + 1)[-1]):
        up, down = quality.risk(prior_w, p, u, 0.6)
        total = lambda x: (lambda a, b: -b if b < 0 else a + b)(*quality.risk(x, p, u, 0.6))
        found = seen[0](prior_w)
        for k in [0, 5, width]:
            step = 1e-6 * np.eye(width + 1)[k]
            assert abs((total(prior_w + step) - total(prior_w - step)) / 2e-6 - found[k]) < 1e-5


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels")]


def scores(docs, labels):
    rows = quality.score_documents(docs, labels).collect()
    return {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in rows}


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = scores(docs, labels)
    assert len(got) == docs.count()
    assert all(h == held(i) and 0 <= s <= 1 and p == (s >= 0.7) for i, (h, s, p) in got.items())
    mine = [(r["quality"], got[r["doc_id"]][1]) for r in labels.collect() if held(r["doc_id"])]
    good, bad = [s for q, s in mine if q], [s for q, s in mine if not q]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([g >= 0.7 for g in good]) > 0.95


def test_only_trusted_positives_are_learned_from(tables):
    docs, labels = tables
    without = labels.where("quality = 1")  # no label 0 anywhere
    turned = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    assert scores(docs, labels) == scores(docs, without) == scores(docs, labels.withColumn("quality", turned))


def test_odd_tables(spark):
    docs = clashing(documents(spark, ODD))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 1), (99, 1), (8, 0)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_bounded_sample_is_exact(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(quality.SPREAD))
    want = [r["doc_id"] for r in ids.orderBy(hash_, "doc_id").limit(100).collect()]
    assert [r["doc_id"] for r in quality.chosen(ids, 100).collect()] == want
