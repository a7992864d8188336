"""The whole analysis on a small two-room chat: totals, privacy, independence of rooms."""

from chat import chat
from pyspark.sql import functions as F

from palaver import AnalysisOptions, analyze
from palaver.plans.report import Report

LINES = ["배포 자동화 서버 설정 완료했습니다", "좋아요 👍", "사진", "user1님이 들어왔습니다.", "내일 오전 회의 어때요?", "ㅋㅋㅋ", "https://a.example.com/x 확인"]


def rooms(spark):
    rows = [(i * 400, f"member{i % 5}-secret", LINES[(i * 3) % len(LINES)]) for i in range(60)]
    one = chat(spark, rows, "one")
    return one, one.unionByName(chat(spark, rows[:35], "two"))


def test_tables_are_complete_and_private(spark):
    _, both = rooms(spark)
    tables = analyze(both, AnalysisOptions(privacy="anonymous", chunk_rows=11))
    assert len(tables) > 40
    total = {r.room_id: r.total_messages for r in tables["rooms"].collect()}
    assert total == {"one": 60, "two": 35}
    daily = {r.room_id: r.n for r in tables["daily"].groupBy("room_id").agg(F.sum("messages").alias("n")).collect()}
    assert daily == total
    for name, table in tables.items():
        for row in table.collect():
            assert "-secret" not in str(row), name
            # only the repeated-phrase list (and its day in the timeline) may show a text
            assert LINES[0] not in str(row) or name == "repeated_phrases", name


def test_a_room_is_independent_of_its_neighbours(spark):
    one, both = rooms(spark)
    alone = Report(one).room_row.collect()
    among = Report(both).room_row.filter("room_id = 'one'").collect()
    assert alone == among


def test_since_is_inclusive(spark):
    one, _ = rooms(spark)
    r = Report(one, AnalysisOptions(since="2026-03-01"))
    assert r.summary.first().total_messages == 60
    assert Report(one, AnalysisOptions(since="2026-03-02")).messages.count() == 0


def test_model_hooks(spark):
    one, _ = rooms(spark)
    r = Report(one)
    good = lambda c: F.struct(F.when(c.contains("좋"), "positive").otherwise("negative").alias("label"), F.lit(0.9).alias("score"))
    per_room, per_sender = r.model_sentiment(good, force=True)
    sample = r.model_texts(force=True).count()
    assert per_room.first().sample == sample > 0
    assert per_sender.count() > 0
    assert r.model_toxicity(good, force=True).first().sample == sample
    vector = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    assert r.model_clusters(vector, force=True).count() == sample
