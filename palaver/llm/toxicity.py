"""Toxicity classifier with counterfactual regularisation.

Logistic regression over the words of a whole text and their first four and five letters
(present or not). It is fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash
of their ids; the features are the ``FEATURES`` ones that tell the labels apart best in that
sample. Every sentence of the sample with an identity term gives counterfactuals: the term
swapped for another of its family, and for a neutral word. The fit adds to the loss the
squared changes of the score between the document and its counterfactuals, so that naming a
group, in itself, moves no score.

Fitting sees a bounded sample (the driver gets feature numbers, no texts); counting features
and scoring run on all tasks, and scoring reads every whole text once.

Cases: a null text is empty and gets the score of a text without known features; null labels
and labels of missing documents are not used; of several labels of one id the largest counts;
a null id counts as not held out; without labels of both kinds every score is 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import boxed, columns_of, materialise, text_of, unboxed

TRAIN_ROWS = 20_000
FEATURES = 4096
LEAST_DOCS = 4  # sample documents that hold a feature, at least
LEAST_ERRORS = 2.5  # standard errors by which its log-odds differ from zero, at least
THRESHOLD = 0.7
CACHE = 250_000

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")

# terms that name groups, by family; a swap stays inside its family
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("africans", "europeans", "americans", "arabs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
NEUTRAL = "people"


@dataclass(frozen=True)
class Model:
    features: dict[int, int]  # hash of a feature -> its number
    weights: list[float]
    bias: float
    name: str = field(default="")


def features_of(word: str) -> list[int]:
    """Hashes of the features of one token between blanks."""
    out = []
    for run in LETTERS.findall(word.lower()):
        out.append(run)
        out += [f"{n}^{run[:n]}" for n in (4, 5) if len(run) >= n]
    return [xxhash.xxh64_intdigest(f.encode()) - (1 << 63) for f in out]


def _swaps(text: str, families=IDENTITY_TERMS, neutral: str = NEUTRAL) -> list[str]:
    """Counterfactual texts: identity terms of its sentences swapped, and made neutral."""
    following = {t: family[(k + 1) % len(family)] for family in families for k, t in enumerate(family)}
    other, plain, found = [], [], False
    for sentence in SENTENCE.findall(text):
        words = LETTERS.findall(sentence)
        if any(w.lower() in following for w in words):
            found = True
            other.append(LETTERS.sub(lambda m: following.get(m[0].lower(), m[0]), sentence))
            plain.append(LETTERS.sub(lambda m: neutral if m[0].lower() in following else m[0], sentence))
        else:
            other.append(sentence)
            plain.append(sentence)
    return ["".join(other), "".join(plain)] if found else []


# ---- sample -------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out third."""
    known = columns_of(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxicity-chosen")
    texts = columns_of(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    # at most ``rows`` pairs of numbers
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return materialise(joined.select("text", "label"), "toxicity-sample")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, toxic = Counter(), Counter()

    def drain() -> pa.RecordBatch:
        keys = list(docs)
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())],
            ["feature", "docs", "toxic"],
        )
        docs.clear()
        toxic.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            found = {f for w in set(text.split()) for f in features_of(w)}
            docs.update(found)
            if label:
                toxic.update(found)
            if len(docs) > CACHE:
                yield drain()
    yield drain()


def select_features(counts: DataFrame, n: int, n_toxic: int, most: int) -> dict[int, int]:
    """The features whose log-odds lie furthest from zero, in standard errors."""
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    c, d = F.lit(n_toxic + 0.5) - F.col("toxic"), F.lit(n - n_toxic + 0.5) - (F.col("docs") - F.col("toxic"))
    z = F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    total = counts.groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    best = total.where((F.col("docs") >= LEAST_DOCS) & (z >= LEAST_ERRORS)).orderBy(z.desc(), "feature").limit(most)
    return {r["feature"]: k for k, r in enumerate(best.select("feature").collect())}


def _numbers(features: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(text: str) -> list[int]:
            return sorted({features[f] for w in set(text.split()) for f in features_of(w) if f in features})

        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = pa.array([of(t) for t in texts], pa.list_(pa.int32()))
            swapped = pa.array([[of(s) for s in _swaps(t)] for t in texts], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("label"), own, swapped], ["label", "own", "swapped"])

    return run


# ---- fit ------------------------------------------------------------------------


class Sparse:
    """Rows of feature numbers with products by bincount."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], self.width)


def fit(
    own: list[list[int]], labels: list[int], pairs: list[tuple[int, list[int]]], width: int,
    penalty: float = 1.0, ridge: float = 5e-5, rounds: int = 300, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weights and bias; ``pairs`` are (row, feature numbers of a counterfactual of it)."""
    x, y = Sparse(own, width), np.array(labels, float)
    at, other = np.array([k for k, _ in pairs], np.int64), Sparse([f for _, f in pairs], width)
    w, bias = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        logit = x.dot(w)
        slope = (1 / (1 + np.exp(-np.clip(logit + bias, -50, 50))) - y) / len(y)
        down, down_bias = slope.copy(), slope.sum()
        change_back = np.zeros(width)
        if len(at):
            change = 2 * penalty * (logit[at] - other.dot(w)) / len(at)
            down += np.bincount(at, change, len(y))
            change_back = other.back(change)
        gradient = np.append(x.back(down) - change_back + 2 * ridge * w, down_bias)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate / (1 + step / 100) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = FEATURES, penalty: float = 1.0) -> Model:
    chosen = sample(docs, labels, rows)
    n, n_toxic = chosen.agg(F.count(F.lit(1)), F.sum((F.col("label") > 0).cast("int"))).first()
    n_toxic = n_toxic or 0
    if not n_toxic or n_toxic == n:
        return Model({}, [], float("-inf"), "none")
    counts = chosen.mapInArrow(_count, "feature long, docs long, toxic long")
    features = select_features(counts, n, n_toxic, most)
    found = chosen.mapInArrow(_numbers(features), "label int, own array<int>, swapped array<array<int>>").toPandas()
    found["order"] = [(int(t), tuple(o)) for t, o in zip(found.label, found.own)]
    found = found.sort_values("order", kind="stable")  # the fit does not depend on the order of tasks
    own = [list(r) for r in found.own]
    pairs = [(k, list(s)) for k, swapped in enumerate(found.swapped) for s in swapped]
    w, bias = fit(own, [int(t > 0) for t in found.label], pairs, len(features), penalty)
    return Model(features, [float(x) for x in w], bias, f"{xxhash.xxh64_hexdigest(w.tobytes())}")


# ---- score ----------------------------------------------------------------------


class Scorer(dict):
    """word -> numbers of the model's features in it (most words: none)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[int, ...]:
        known = self.model.features
        found = tuple(known[f] for f in features_of(word) if f in known)
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found

    def score(self, text: str) -> float:
        if not self.model.features:
            return 0.0
        present = {k for found in map(self.__getitem__, set(text.split())) if found for k in found}
        weights = self.model.weights
        logit = self.model.bias + sum(weights[k] for k in sorted(present))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


_SCORERS: dict[str, Scorer] = {}


def score(text: Column, model: Model) -> Column:
    """Toxicity between 0 and 1 of a text column."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model.name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model.name] = Scorer(model)
        scorer = _SCORERS[model.name]
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = train(docs, labels)
    scored = columns_of(docs, "doc_id", "text").select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, in their own columns."""
    model = train(docs, labels)
    scored = boxed(docs).withColumn("score", score(F.col("doc")["text"], model))
    return unboxed(scored.where(F.col("score") < threshold), docs)
