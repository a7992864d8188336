"""Quality classifier by positive-unlabelled learning.

A document is described by shares counted over its whole text: kinds of characters, words
that repeat, lines, lengths. Each share is cut at quantiles of the sample, and the score is the
logistic function of the sum of one weight per share and bin.

Only trusted positives (label 1) and unlabelled text take part in learning; label 0 is never
used. With the class prior ``p``, the risk of a score f over the positives P and the unlabelled U is

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]),    l(f) = log(1 + exp(-f)),

the non-negative form of the unbiased risk: the second term estimates the risk of the unseen
negatives, and where a fit drives it below zero, the step goes back up instead.

The prior is estimated first. A score learned to tell P from U orders all texts; in any range at
its top, U holds at least ``p`` times the share that P holds, and just that share where no negative
is left. The least quotient over all ranges that hold half of P is p; it is taken on texts that the
score was not learned from.

Fitting sees at most ``POSITIVES`` and ``UNLABELLED`` documents, both outside the held-out
quarter and chosen by a hash of their ids; the driver gets their numbers, no texts. Scoring reads
every whole text once, without a shuffle.

Cases: a null text is empty and is scored by its shares, all zero; null labels and labels of
missing documents are not used; of several labels of one id the largest counts; a row without id
is scored, but not learned from, and counts as not held out; without positives every score is
0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, materialise, text_of

POSITIVES = 10_000
UNLABELLED = 20_000
CUTS = (0.002, 0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.97, 0.99, 0.998)  # quantiles between bins
STEPS = 5.0  # weight of a step between neighbouring bins against a weight itself
THRESHOLD = 0.7
SPREAD = 1 << 30


# ---- description of a text ---------------------------------------------------------

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "stop": b".,;:'\"-()", "loud": b"!?", "sign": b"#$%&*+/<=>@[\\]^_`{|}~", "control": bytes([*range(9), *range(14, 32), 127]),
}
_OF_KIND = np.array([[b in chars for chars in _KINDS.values()] for b in range(256)], float)
SHARES = (*_KINDS, "words", "new words", "new pairs", "same as before", "most frequent", "long words", "wordless", "word length",
          "lines", "new lines", "line length")


def shares_of(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(SHARES)
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _OF_KIND / len(data)
    words = data.split()
    n = max(1, len(words))
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        *kinds.tolist(), np.log1p(len(words)), len(counts) / n, (len(pairs) + 1) / n, sum(map(eq, words, words[1:])) / n,
        sum(k for _, k in counts.most_common(3)) / n, sum(c for w, c in counts.items() if len(w) > 18) / n,
        sum(c for w, c in counts.items() if not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) / n,
        sum(len(w) * c for w, c in counts.items()) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        np.log1p(len(data) / max(1, len(lines))),
    ]


# ---- model ------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # a row of inner bin edges per share
    weights: np.ndarray  # one per share and bin
    bias: float
    prior: float

    def score(self, shares: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(shares))
        logit = self.bias + self.weights[bins(shares, self.edges)].sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def edges_of(positive: np.ndarray) -> np.ndarray:
    """Quantiles of the trusted positives: what lies beyond nearly all of them has bins of its own."""
    return np.quantile(positive, CUTS, axis=0).T


def width_of(edges: np.ndarray) -> int:
    return 2 * edges.shape[1] + 1


def bins(shares: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Place of each share's bin among all weights: below, on and above each edge."""
    both = [np.searchsorted(e, s, "left") + np.searchsorted(e, s, "right") for e, s in zip(edges, shares.T)]
    return np.stack([b + k * width_of(edges) for k, b in enumerate(both)], 1)


def _back(numbers: np.ndarray, slope: np.ndarray, width: int) -> np.ndarray:
    return np.bincount(numbers.ravel(), np.repeat(slope, numbers.shape[1]), width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _descend(slope_of, width: int, rounds: int, rate: float) -> np.ndarray:
    """Adam from zero; the last weight is the bias."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        slope = slope_of(w)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate / (1 + step / 100) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Estimated risks of the positives and of the negatives (the latter may be below zero)."""
    p, u = [w[:-1][rows].sum(1) + w[-1] for rows in (positive, unlabelled)]
    loss = lambda f: float(np.logaddexp(0, -f).mean())
    return prior * loss(p), loss(-u) - prior * loss(-p)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, width: int, count: int, ridge: float, rounds: int = 400, rate: float = 0.1) -> np.ndarray:
    """Weights and bias of least non-negative risk; arguments are places of bins, a row per document."""
    def slope(w: np.ndarray) -> np.ndarray:
        p, u = [_sigmoid(w[:-1][rows].sum(1) + w[-1]) for rows in (positive, unlabelled)]
        p_up = prior * (p - 1) / len(p)  # slopes of the positives' risk
        p_down, u_down = -prior * p / len(p), u / len(u)  # and of the negatives'
        if risk(w, positive, unlabelled, prior)[1] < 0:
            on_p, on_u = -p_down, -u_down
        else:
            on_p, on_u = p_up + p_down, u_down
        out = np.append(_back(positive, on_p, width) + _back(unlabelled, on_u, width), on_p.sum() + on_u.sum())
        out[:-1] += roughness(w[:-1], count, ridge)
        return out

    return _descend(slope, width, rounds, rate)


def roughness(w: np.ndarray, count: int, ridge: float) -> np.ndarray:
    """Slope of ``ridge`` times the squared weights and steps between neighbouring bins of a share."""
    steps = np.diff(w.reshape(-1, count), axis=1)
    pull = np.zeros((steps.shape[0], count))
    pull[:, :-1] -= steps
    pull[:, 1:] += steps
    return 2 * ridge * (STEPS * pull.ravel() + w)


def tell_apart(positive: np.ndarray, unlabelled: np.ndarray, width: int, count: int, rounds: int = 200, rate: float = 0.1) -> np.ndarray:
    """Plain logistic weights for 'in P' against 'in U'."""
    def slope(w: np.ndarray) -> np.ndarray:
        p, u = [_sigmoid(w[:-1][rows].sum(1) + w[-1]) for rows in (positive, unlabelled)]
        on_p, on_u = (p - 1) / len(p), u / len(u)
        out = np.append(_back(positive, on_p, width) + _back(unlabelled, on_u, width), on_p.sum() + on_u.sum())
        out[:-1] += roughness(w[:-1], count, 1e-3)
        return out

    return _descend(slope, width, rounds, rate)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both (higher: likelier positive)."""
    cuts = np.unique(positive)
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = above(positive), above(unlabelled)
    enough = p >= 0.5
    return float(np.clip((u[enough] / p[enough]).min(initial=1.0), 0.01, 0.99))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Model from the shares of trusted positives and of unlabelled texts, a row per document."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((len(SHARES), 0)), np.zeros(0), 0.0, 0.0)
    edges = edges_of(positive)
    p, u = bins(positive, edges), bins(unlabelled, edges)
    count = width_of(edges)
    width = len(edges) * count
    priors = []
    for half in (0, 1):  # the prior comes from texts that the score was not learned from
        if len(p) > 1 and len(u) > 1:
            order = tell_apart(p[half::2], u[half::2], width, count)
            priors.append(class_prior(*[order[:-1][rows[1 - half:: 2]].sum(1) for rows in (p, u)]))
    prior = float(np.mean(priors)) if priors else 0.99
    w = fit(p, u, prior, width, count, min(1e-3, 1 / len(u)))
    return Model(edges, w[:-1], float(w[-1]), prior)


# ---- tables -----------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def chosen(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids, those with the smallest hashes. The hash range is cut first, so little is sorted."""
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    total = ids.count()
    if total > 2 * rows:
        ids = ids.where(hash_ < int(SPREAD * min(1.0, (rows + 6 * rows**0.5 + 50) / total)))
    return ids.orderBy(hash_, "doc_id").limit(rows)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [shares_of(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("trusted"), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "trusted", "shares"]
        )


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    texts = columns_of(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = columns_of(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    good = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = good.join(texts.select("doc_id"), "doc_id", "left_semi")
    sample = chosen(good, positives).withColumn("trusted", F.lit(True)).unionByName(
        chosen(texts.select("doc_id"), unlabelled).distinct().withColumn("trusted", F.lit(False))
    )
    sample = materialise(sample, "quality-sample")
    # at most ``positives + unlabelled`` ids
    rows = texts.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    found = rows.mapInArrow(_describe, "doc_id long, trusted boolean, shares array<double>").toPandas()
    found["order"] = [(i, tuple(s)) for i, s in zip(found.doc_id, found.shares)]
    found = found.sort_values("order", kind="stable")  # the fit does not depend on the order of tasks
    sides = [np.array(found.shares[found.trusted == t].tolist(), float).reshape(-1, len(SHARES)) for t in (True, False)]
    return learn(*sides)


def score(text: Column, model: Model) -> Column:
    """Quality between 0 and 1 of a text column."""
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([shares_of(t) for t in texts]).reshape(-1, len(SHARES))))

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = train(docs, labels)
    scored = columns_of(docs, "doc_id", "text").select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
