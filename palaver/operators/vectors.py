"""Vector operators: normalisation, cosine, coherence, k-means, cluster labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import tokens as tok
from palaver.functions.numeric import half_up
from palaver.operators.keywords import STOP_TERMS
from palaver.operators.topk import top_k
from palaver.session import materialise


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """Vector of length one (a zero vector stays zero)."""
    norm = F.sqrt(dot(v, v))
    safe = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(v, lambda x: x.cast("double") / safe)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group; sums merge map-side, no row per dimension."""
    d = vectors.select(group, array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    return d.groupBy(group).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


def similarity_to_centroid(vectors: DataFrame, group: str, key: str) -> DataFrame:
    d = vectors.join(centroids(vectors, group), group)
    return d.select(key, group, half_up(cosine(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))


def coherence(vectors: DataFrame, group: str) -> DataFrame:
    """Mean cosine over all pairs of a group without forming pairs:

    for unit vectors it is (|sum v|^2 - sum |v|^2) / (m (m - 1)).
    """
    d = vectors.select(group, unit(F.col("embedding")).alias("_u"))
    d = d.select(group, array_to_vector("_u").alias("_v"), dot(F.col("_u"), F.col("_u")).alias("_s"))
    g = d.groupBy(group).agg(
        F.count("*").alias("size"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("_sum"), F.sum("_s").alias("_own")
    )
    m = F.col("size")
    pairs = (dot(F.col("_sum"), F.col("_sum")) - F.col("_own")) / (m * (m - 1))
    return g.select(group, "size", half_up(F.when(m < 2, 1.0).otherwise(pairs), 5).alias("coherence"))


def cluster_count(n: int) -> int:
    return max(4, min(14, math.isqrt(n // 18)))


def kmeans(vectors: DataFrame, key: str, seed: int = 42, max_iter: int = 24) -> DataFrame:
    """Distributed k-means with cosine distance over one corpus."""
    d = vectors.select(key, "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads it again
    try:
        model = KMeans(
            k=cluster_count(d.count()), distanceMeasure="cosine", maxIter=max_iter, seed=seed, initMode="k-means||"
        ).fit(d)
    finally:
        d.unpersist()
    return model.transform(d).select(key, "embedding", F.col("prediction").alias("cluster"))


def _nearest(v: Column, centres: Column) -> Column:
    """Number of the centre with the largest dot product (the first of equal ones)."""
    near = F.transform(centres, lambda c: dot(v, c))
    return (F.array_position(near, F.array_max(near)) - 1).cast("int")


def _listed(rows: DataFrame, order: str) -> DataFrame:
    """(room_id, centres): few vectors of each room as one array."""
    both = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "u")))
    return rows.groupBy("room_id").agg(F.transform(both, lambda s: s["u"]).alias("centres"))


def assign(units: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(room_id, <key>, cluster) of unit vectors u, for given centres(room_id, centres)."""
    return units.join(centres, "room_id").select("room_id", key, _nearest(F.col("u"), F.col("centres")).alias("cluster"))


SEED_ROUNDS = 4


def seed_centres(units: DataFrame, key: str, seed: int = 42, rounds: int = SEED_ROUNDS) -> DataFrame:
    """(room_id, centres) for k-means in every room: oversampled in rounds, then reduced to k.

    A round knows each vector's distance to the centres so far and takes it with a chance in
    proportion, about 2 k of a room at a time; the chance is a hash of the key, so runs agree.
    Candidates (about 2 k a round, however large the room) weigh as many vectors as are nearest to
    them; a weighted k-means over them, one small group per room, gives the first centres.
    """
    hash_ = lambda r: F.pmod(F.xxhash64(F.lit(seed + r), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    count = F.greatest(F.lit(4), F.least(F.lit(14), F.floor(F.sqrt(F.floor(F.count("*") / 18)))))
    sizes = materialise(units.groupBy("room_id").agg(F.least(count, F.count("*")).cast("int").alias("k"), F.min(F.struct(hash_(0).alias("h"), key)).alias("first")), "room-sizes")
    first = units.join(sizes.select("room_id", F.col(f"first.{key}").alias(key)), ["room_id", key])
    chosen = materialise(first.select("room_id", key, "u"), "candidates")
    for r in range(1, rounds + 1):
        centres = _listed(chosen, key)
        far = F.greatest(F.lit(0.0), F.lit(1.0) - F.array_max(F.transform("centres", lambda c: dot(F.col("u"), c))))
        placed = units.join(centres, "room_id").select("room_id", key, "u", far.alias("far"))
        total = materialise(placed.groupBy("room_id").agg(F.sum("far").alias("total")), "room-distance")
        room = sizes.join(total, "room_id").where("total > 0")
        more = placed.join(room, "room_id").where(hash_(r) * F.col("total") < 2 * F.col("k") * F.col("far")).select("room_id", key, "u")
        chosen = materialise(chosen.unionByName(more).dropDuplicates(["room_id", key]), "candidates")
    centres = _listed(chosen, key)
    votes = assign(units, centres, key).groupBy("room_id", "cluster").agg(F.count("*").alias("n"))
    weights = votes.groupBy("room_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("w"))
    weighed = centres.join(weights, "room_id").join(sizes.select("room_id", "k"), "room_id").select(
        "room_id", "k", "centres", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("w", i), F.lit(0))).alias("n")
    )

    @F.udf("array<array<double>>")
    def reduced(vectors, counts, k):
        return reduce_candidates(np.array(vectors, float), np.array(counts, float), k).tolist()

    return materialise(weighed.select("room_id", reduced("centres", "n", "k").alias("centres")), "centres")


def reduce_candidates(units: np.ndarray, weights: np.ndarray, k: int, rounds: int = 24) -> np.ndarray:
    """k centres of a few weighted unit vectors: the heaviest, then the heaviest far from those before; then k-means."""
    picked = [int(np.argmax(weights))]
    while len(picked) < min(k, len(units)):
        gain = np.maximum(0, 1 - (units @ units[picked].T).max(1)) * (weights + 1e-9)
        gain[picked] = -1
        picked.append(int(np.argmax(gain)))
    centres = units[picked]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(1)
        sums = np.stack([(units * weights[:, None])[own == c].sum(0) for c in range(len(centres))])
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        moved = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def kmeans_per_room(vectors: DataFrame, key: str, seed: int = 42, max_iter: int = 24) -> DataFrame:
    """(room_id, <key>, cluster): cosine k-means inside every room, over all of its vectors.

    A round joins every vector with its room's few centres and takes means per (room, cluster),
    which add up before they are shuffled; rooms of any size are spread over all tasks. A centre
    that loses all its vectors stays where it was.
    """
    d = materialise(vectors.select("room_id", key, unit(F.col("embedding")).alias("u")), "room-vectors")
    centres = seed_centres(d, key, seed)
    for _ in range(max_iter):
        placed = d.join(centres, "room_id").select("room_id", _nearest(F.col("u"), F.col("centres")).alias("cluster"), "u")
        means = placed.groupBy("room_id", "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("m"))
        means = means.select("room_id", "cluster", unit(F.col("m")).alias("u"))
        old = centres.select("room_id", F.posexplode("centres").alias("cluster", "before"))
        both = old.join(means, ["room_id", "cluster"], "left").select("room_id", "cluster", "before", F.coalesce("u", "before").alias("u"))
        moved = materialise(both, "centres")
        centres = _listed(moved, "cluster")
        if moved.filter(F.col("u") != F.col("before")).isEmpty():
            break
    return assign(d, centres, key)


def cluster_labels(clusters: DataFrame, tokens: DataFrame, key: str, k: int = 4, least: float = 0.32, stop_terms=()) -> DataFrame:
    """Top terms of every coherent cluster; clusters(key, embedding, cluster), tokens(key, tokens)."""
    stop = tuple(dict.fromkeys([*STOP_TERMS, *stop_terms]))
    good = coherence(clusters, "cluster").filter((F.col("size") >= 2) & (F.col("coherence") >= least))
    words = clusters.select(key, "cluster").join(tokens, key).select("cluster", F.explode("tokens").alias("term"))
    counts = words.groupBy("cluster", "term").agg(F.count("*").alias("df"))
    counts = counts.filter(~F.col("term").isin(*stop) & ~tok.is_noise(F.col("term"), stop_terms))
    top = top_k(counts, ["cluster"], [F.desc("df"), F.desc(F.length("term")), F.asc("term")], k)
    terms = top.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms")
    )
    return good.join(terms, "cluster")


def semantic_keywords(labels: DataFrame, total: int) -> DataFrame:
    """One item per cluster: its two first terms, de-duplicated, with the cluster's share."""
    d = labels.select(
        F.array_join(F.slice("terms", 1, 2), " ").alias("label"), F.col("size").alias("hits"), "terms",
        half_up(F.col("size") / F.lit(float(max(total, 1))) * 100.0, 1).alias("percent"),
    )
    return d.groupBy("label").agg(
        F.max("hits").alias("hits"), F.max("percent").alias("percent"), F.max_by("terms", "hits").alias("terms")
    )


def semantic_topics(items: DataFrame, least: float = 0.5) -> DataFrame:
    return items.filter(F.col("percent") >= least).select("label", "terms", "percent")


def embed(texts: DataFrame, model, column: str = "text", batch_size: int = 256) -> DataFrame:
    """Hook for a vector model: ``model()`` returns a function from a list of texts to a

    2-d array; it is loaded once per Python worker and fed Arrow batches.
    """
    from pyspark.ml.functions import predict_batch_udf

    run = predict_batch_udf(lambda: _text_batches(model()), return_type="array<float>", batch_size=batch_size)
    return texts.withColumn("embedding", run(F.col(column)))


def _text_batches(fn):
    return lambda inputs: np.asarray(fn([str(t) for t in inputs]), dtype="float32")
