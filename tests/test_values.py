"""Values that decide results, stated as literals."""

import unicodedata

from chat import chat
from pyspark.sql import functions as F

from palaver.functions import tone
from palaver.functions.text import emoji_category
from palaver.operators import activity as act
from palaver.operators import insights as ins
from palaver.operators import keywords as kw
from palaver.operators import vectors as vec
from palaver.plans.report import Report


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*[c(F.col("t")) for c in columns]).first()


def test_lexicon_words(spark):
    for word, hits in (("신난다", (1, 0, 0)), ("잘한다", (1, 0, 0)), ("예쁘다", (1, 0, 0)), ("짜증", (0, 1, 0)), ("의자", (0, 0, 1))):
        d = spark.createDataFrame([(word,)], "t string").select(*tone.sentiment_hits(F.col("t")))
        assert tuple(d.first()) == hits, word


def test_emoji_categories(spark):
    for emoji, category in (("😂", "positive"), ("☺️", "positive"), ("😢", "sadness"), ("💢", "anger"), ("🤯", "surprise"), ("🤗", "love"), ("🙄", "negative"), ("🚗", "neutral")):
        assert one(spark, emoji, emoji_category)[0] == category


def test_failed_answers(spark):
    for text, bad in (("roomArchetype", True), ("No Focus here", True), ("PLEASE WAIT", True), ("12, 30%", True), ("서버 배포 이야기", False), ("momentsome", False)):
        assert one(spark, text, ins.is_garbage)[0] is bad, text


def test_phrases_are_measured_in_utf16_units(spark):
    phrase = "축하합니다 오늘 🎉🎉"  # 11 code points, 13 units
    m = chat(spark, [(i * 60, "a", phrase) for i in range(3)], "r").withColumn("keyword_text", F.col("message"))
    assert kw.repeated_phrases(kw.phrases(m)).first()["count"] == 3


def test_decomposed_hangul_is_composed_before_tokens(spark):
    text = unicodedata.normalize("NFD", "서버 배포")
    m = chat(spark, [(i * 60, "a", f"project {text}") for i in range(3)], "r")
    tokens = {t for r in Report(m).docs.collect() for t in r["tokens"]}
    assert {"project", "서버", "배포"} <= tokens


def test_small_korean_rooms_have_a_lower_floor(spark):
    n = spark.createDataFrame([("k", 3000, True), ("e", 3000, False)], "room_id string, n long, korean boolean")
    got = {r["room_id"]: r["m"] for r in n.select("room_id", kw.min_count(F.col("n"), F.col("korean")).alias("m")).collect()}
    assert got == {"k": 3, "e": 4}


def test_time_profile_keeps_grains_apart_without_a_time(spark):
    cells = spark.createDataFrame([("r", None, None, 2), ("r", "2026-01-05", 9, 3)], "room_id string, day string, hour int, messages long")
    cells = cells.withColumn("day", F.to_date("day"))
    got = {(r["grain"], r["bucket"]): r["messages"] for r in act.time_profile(cells).collect()}
    assert got == {
        ("day", None): 2, ("month", None): 2, ("hour", None): 2, ("weekday", None): 2,
        ("day", "2026-01-05"): 3, ("month", "2026-01"): 3, ("hour", "9"): 3, ("weekday", "1"): 3,
    }


def test_kmeans_in_rooms_ends_at_nearest_means(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    base = np.eye(4)
    rows = [(room, i, [float(x) for x in base[i % 4] * 3 + rng.normal(0, 0.2, 4)]) for room in "ab" for i in range(80)]
    d = spark.createDataFrame(rows, "room_id string, line long, embedding array<double>")
    got = {(r["room_id"], r["line"]): r["cluster"] for r in vec.kmeans_per_room(d, "line", max_iter=30).collect()}
    assert len(got) == len(rows)
    for room in "ab":
        x = np.array([v for r, _, v in rows if r == room])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([got[room, i] for i in range(80)])
        names = sorted(set(label))
        means = np.array([x[label == c].mean(0) for c in names])
        means /= np.linalg.norm(means, axis=1, keepdims=True)
        assert [names[k] for k in (x @ means.T).argmax(1)] == list(label)


def test_kmeans_in_rooms_is_as_good_as_one_model_per_room(spark):
    """Inertia (1 - cosine) of well separated and of smeared groups against Spark's own k-means."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(6)
    rows = []
    for room, spread in (("near", 0.05), ("far", 0.6)):
        heads = rng.normal(size=(6, 8))
        rows += [(room, k, [float(x) for x in heads[k % 6] + spread * rng.normal(size=8)]) for k in range(700)]
    d = spark.createDataFrame(rows, "room_id string, line bigint, embedding array<double>")
    got = {(r.room_id, r.line): r.cluster for r in vec.kmeans_per_room(d, "line").collect()}
    for room in ("near", "far"):
        mine = [(k, np.array(v)) for r, k, v in rows if r == room]
        units = np.stack([v / np.linalg.norm(v) for _, v in mine])

        def inertia(labels):
            total = 0.0
            for c in set(labels):
                part = units[[x == c for x in labels]]
                total += len(part) - np.linalg.norm(part.sum(0))
            return total

        ours = inertia([got[room, k] for k, _ in mine])
        k = len({got[room, k] for k, _ in mine})
        frame = spark.createDataFrame([(Vectors.dense(v),) for v in units], ["features"])
        model = KMeans(k=k, distanceMeasure="cosine", maxIter=24, seed=42).fit(frame)
        theirs = inertia([r.prediction for r in model.transform(frame).collect()])
        assert ours <= 1.02 * theirs, (room, k, ours, theirs)


def test_candidates_are_reduced_to_centres():
    import numpy as np

    units = np.eye(3)[[0, 0, 1, 1, 2]]
    got = vec.reduce_candidates(units, np.array([5.0, 1, 3, 3, 1]), 3)
    assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, np.eye(3).tolist()))
    assert len(vec.reduce_candidates(units[:2], np.array([1.0, 1]), 4)) == 2
