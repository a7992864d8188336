"""Topic cards as sets: seeds, repeats, fusion, communities."""

from pyspark.sql import functions as F

from palaver.operators import topic_cards as tc
from palaver.operators import topics as tp
from palaver.operators.components import components

CARD = "room_id string, place int, id string, kind string, title string, terms array<string>, percent double"


def cards(spark, *rows):
    return spark.createDataFrame([("r", i + 1, id_, kind, title, terms, float(p)) for i, (id_, kind, title, terms, p) in enumerate(rows)], CARD)


def test_title_order_does_not_matter(spark):
    d = spark.createDataFrame([("배포 · 서버", "서버 · 배포")], "a string, b string").select(tc.title_words(F.col("a")), tc.title_words(F.col("b"))).first()
    assert d[0] == d[1]


def test_same_pair_over_three_lanes_is_one_theme(spark):
    graph = cards(spark, ("a", "theme", "배포 · 서버", ["배포", "서버", "설정"], 5), ("b", "theme", "점심 · 메뉴", ["점심", "메뉴"], 4))
    seeds = cards(spark, ("c", "theme", "서버 · 배포", ["서버", "배포", "설정"], 6), ("d", "theme", "여행 · 제주", ["여행", "제주"], 3))
    semantic = cards(spark, ("e", "theme", "배포 · 서버", ["배포", "서버"], 2), ("f", "theme", "운동 · 헬스", ["운동", "헬스"], 2))
    merged = tc.merged_topics(graph, seeds, semantic).orderBy("place").collect()
    assert [set(c["terms"]) >= {"배포", "서버"} for c in merged].count(True) == 1
    assert len(merged) == 4 and merged[0]["percent"] == 6 and set(merged[0]["terms"]) == {"배포", "서버", "설정"}


def test_periods_follow_the_themes_and_can_be_limited(spark):
    graph = cards(spark, *[(f"m{i}", "period", f"2026-0{i}", [f"말{i}", f"글{i}"], i) for i in range(1, 7)])
    none = graph.filter("false")
    assert [r["percent"] for r in tc.merged_topics(graph, none, none, 12, 4).orderBy("place").collect()] == [6, 5, 4, 3]
    assert tc.merged_topics(graph, none, none).count() == 6


def test_refined_drops_repeats_of_larger_themes(spark):
    graph = cards(
        spark, ("x", "theme", "t", ["가나", "다라", "마바"], 3), ("y", "theme", "t", ["가나", "다라", "마바", "사아"], 5),
        ("z", "theme", "t", ["가나", "자차"], 1), ("p", "period", "2026-01", ["가나", "다라", "마바"], 1),
    )
    assert {r["id"] for r in tc.refined_topics(graph).collect()} == {"y", "z", "p"}


def test_terms_are_normalised(spark):
    d = spark.createDataFrame([(["Claude", "클코", "클로드는", "회의는"],)], "t array<string>")
    assert d.select(tc.normal_terms(F.col("t"))).first()[0] == ["클로드", "회의"]


def test_communities_follow_strongest_links(spark):
    edges = spark.createDataFrame(
        [("r", "a", "b", 9, 1.0), ("r", "b", "c", 5, 1.0), ("r", "c", "d", 4, 1.0), ("r", "e", "f", 2, 1.0), ("r", "d", "e", 1, 1.0)],
        "room_id string, a string, b string, weight long, pmi double",
    )
    nodes = spark.createDataFrame([("r", t, i + 1) for i, t in enumerate("abcdef")], "room_id string, term string, rank int")
    got = tp.communities(nodes, edges).orderBy("community", "place").collect()
    assert ["".join(r["term"] for r in got if r["community"] == k) for k in (0, 1)] == ["abcd", "ef"]


def test_components_of_a_path_and_a_hub(spark):
    rows = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("hub", f"spoke{i}") for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert all(got[f"{i + 1:03}"] == "000" for i in range(40)) and all(got[f"spoke{i}"] == "hub" for i in range(50))


def test_class_terms_are_counted_once(spark):
    """Sizes, means and spreads read the same counts; the texts behind them were tokenised for each."""
    seen = spark.sparkContext.accumulator(0)

    def told(n):
        seen.add(1)
        return n

    rows = [("r", c, f"{c}{k}", 9 - k) for c in "ab" for k in range(5)]
    classes = spark.createDataFrame(rows, "room_id string, class string, term string, n long")
    classes = classes.withColumn("tf", F.udf(told, "long")("n")).drop("n")
    got = tp.class_tfidf(classes, 2).collect()
    assert seen.value == len(rows)
    assert [(r["class"], r.term, r["rank"]) for r in sorted(got, key=lambda r: (r["class"], r["rank"]))] == [("a", "a0", 1), ("a", "a1", 2), ("b", "b0", 1), ("b", "b1", 2)]
