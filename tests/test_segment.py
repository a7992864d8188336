"""Dictionary cuts against a plain search over all cuts, and their way into the report."""

import random

from chat import chat
from pyspark.sql import functions as F

from palaver import AnalysisOptions
from palaver.functions.segment import best_cut
from palaver.functions.tokens import tokens
from palaver.operators import keywords as kw
from palaver.plans.report import Report


def every_cut(run, words):
    """All paths through the run: (sum, -number of words, words)."""
    if not run:
        return [(0.0, 0, ())]
    out = every_cut(run[1:], words)
    for size in range(1, len(run) + 1):
        if run[:size] in words:
            out += [(s + words[run[:size]] * size, few - 1, (run[:size], *rest)) for s, few, rest in every_cut(run[size:], words)]
    return out


def test_best_cut_equals_all_cuts(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("가나다") for _ in range(rng.randint(1, 4))): float(rng.randint(1, 5)) for _ in range(14)}
    runs = ["".join(rng.choice("가나다라") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    d = spark.createDataFrame([(r, words) for r in runs], "run string, words map<string, double>")
    for r in d.select("run", best_cut(F.col("run"), F.col("words"), 4).alias("cut")).collect():
        assert tuple(r.cut) == max(every_cut(r.run, words))[2], r.run


def test_report_takes_dictionary_glossary_and_tokenizer(spark):
    lines = ["데이터 파이프라인 확인", "데이터 좋아요", "파이프라인 점검", "데이터파이프라인배포 시작", "배포"] * 4
    m = chat(spark, [(i * 60, "a", t) for i, t in enumerate(lines)], "one")
    found = lambda **o: {t for r in Report(m, AnalysisOptions(**o)).docs.collect() for t in r.tokens}
    plain = found()
    assert "데이터파이프라인배포" in plain
    cut = [r.tokens for r in Report(m, AnalysisOptions(dictionary=True)).docs.collect() if "데이터파이프라인배포" in r.tokens]
    assert cut and all(x[:3] == ["데이터", "파이프라인", "배포"] for x in cut)
    assert found(glossary=(("데이터파이프", "NNP", 50.0),)) - plain == {"데이터파이프"}
    hook = lambda c: F.array(F.lit("zzz"))
    assert found(tokenizer=hook) - plain == {"zzz"}
    assert found(tokenizer=hook, dictionary=True) >= {"zzz", "데이터", "배포"}


def test_glossary_wins_and_rooms_without_words_stay(spark):
    words = spark.createDataFrame([("r", "배포", "NNP", 1.0), ("r", "서버", "NNP", 2.0)], "room_id string, word string, tag string, score double")
    own = spark.createDataFrame([("r", "배포", "NNG", 7.0), ("q", "SL", "SL", 1.0)], "room_id string, word string, tag string, score double")
    assert {r.room_id: r.dictionary for r in kw.dictionaries(own, words).collect()} == {"r": {"배포": 7.0, "서버": 2.0}}
    docs = chat(spark, [(0, "a", "배포서버 배포서버확인")], "other").withColumn("keyword_text", F.col("message"))
    got = kw.dictionary_docs(docs, kw.dictionaries(own, words)).first().tokens
    assert got == docs.select(tokens(F.col("message")).alias("t")).first().t
