"""Greedy insight steps against a plain implementation; evidence checks."""

import random

from pyspark.sql import functions as F

from palaver.operators import insights as ins
from palaver.operators import topic_cards as tc


def plain_roles(rows, limit=6):
    taken = {}
    for _, sender, roles in sorted(rows):
        role = next((r for r in roles if r not in taken), None)
        if role and len(taken) < limit:
            taken[role] = sender
    return taken


def test_roles_survive_the_cut(spark):
    """Many participants share a role list; the cut to eight per list changes nothing."""
    rng = random.Random(3)
    lists = [rng.sample(ins.ROLES, rng.randint(1, 5)) for _ in range(6)]
    rooms = {room: [(i, f"{room}{i}", rng.choice(lists)) for i in range(200)] for room in "ab"}
    rows = [(room, s, i, roles) for room, people in rooms.items() for i, s, roles in people]
    df = spark.createDataFrame(rows, "room_id string, sender string, first_line bigint, roles array<string>")
    got = {}
    for r in ins.participant_roles(df).collect():
        got.setdefault(r.room_id, {})[r.role] = r.sender
    assert got == {room: plain_roles(people) for room, people in rooms.items()}


def test_persona_titles_at_most_twice_while_there_is_a_choice(spark):
    rows = [("r", f"s{i}", i, ["centre", "long_writer"] if i < 5 else []) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "room_id string, sender string, rank int, titles array<string>")
    got = [r.persona for r in ins.personas(df).orderBy("rank").collect()]
    assert got == ["centre", "centre", "long_writer", "long_writer", "all_rounder", "all_rounder"]


def test_evidence_gate(spark):
    texts = spark.createDataFrame(
        [(1, "배포 자동화 이야기가 많다"), (2, "모두가 120건을 남겼다"), (3, "아무 근거 없는 말"), (4, "{json}"), (5, "12, 13%")],
        "item int, text string",
    ).select(F.lit("r").alias("room_id"), "item", "text")
    pool = spark.createDataFrame([("r", ["배포"])], "room_id string, pool array<string>")
    stats = spark.createDataFrame([("r", 120, ["120"])], "room_id string, total_messages bigint, stats array<string>")
    got = {r.item: r.accepted for r in ins.evidence_gate(texts, pool, stats).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_proposals_need_evidence(spark):
    schema = "room_id string, place int, id string, kind string, title string, terms array<string>, percent double"
    topics = spark.createDataFrame([("r", 1, "t", "theme", "점심 · 메뉴", ["점심", "메뉴"], 3.0)], schema)
    proposals = spark.createDataFrame(
        [("r", 1, "배포 흐름", ["배포", "서버"], ["배포"]), ("r", 2, "없는 말", ["없음", "전혀"], ["없음"])],
        "room_id string, proposal int, title string, terms array<string>, evidence array<string>",
    )
    keywords = spark.createDataFrame([("r", "배포", 30)], "room_id string, label string, count bigint")
    totals = spark.createDataFrame([("r", 1000)], "room_id string, total_messages bigint")
    got = tc.accepted_proposals(topics, proposals, keywords, totals).orderBy("place").collect()
    assert [r.title for r in got] == ["배포 흐름", "점심 · 메뉴"]
    assert got[0].percent == 3.0


def test_accepted_texts_replace_the_rules(spark):
    base = spark.createDataFrame([("r", "a", "old"), ("r", "b", "kept")], "room_id string, id string, title string")
    new = spark.createDataFrame([("r", "a", "new")], "room_id string, id string, title string")
    got = {r.id: r.title for r in ins.merge_texts(base, new, ["room_id", "id"], "title").collect()}
    assert got == {"a": "new", "b": "kept"}


def test_mood_turns(spark):
    import datetime as dt

    values = [(0.0, 60.0, -60.0), (50.0, 10.0, 40.0), (50.0, 10.0, 40.0), (0.0, 80.0, -80.0)]
    rows = [("r", dt.date(2026, 1, 1 + i), p, n, e) for i, (p, n, e) in enumerate(values)]
    d = spark.createDataFrame(rows, "room_id string, day date, positive double, negative double, energy double")
    got = sorted((r.day.day, r.type, r.title) for r in ins.mood_turns(d).collect())
    assert got == [(2, "conflict_resolution", "settled"), (2, "emotional_spike", "high")]  # the last day is no inner day


def test_evidence_is_found_in_whole_texts(spark):
    late = "점심 메뉴와 저녁 약속 이야기가 길게 이어졌다. " * 12 + "배포 이야기"
    texts = spark.createDataFrame([("r", 1, late)], "room_id string, item int, text string")
    pool = spark.createDataFrame([("r", ["배포"])], "room_id string, pool array<string>")
    stats = spark.createDataFrame([("r", 1000, ["1000"])], "room_id string, total_messages bigint, stats array<string>")
    row = ins.evidence_gate(texts, pool, stats).first()
    assert row.accepted and 170 < len(row.text) <= 180
    assert not ins.evidence_gate(texts, pool, stats, matched=180).first().accepted


def test_signals_count_all_messages_of_a_day(spark):
    from chat import chat

    from palaver import AnalysisOptions
    from palaver.plans.report import Report

    rows = [(i, "a", f"내일 오전 회의 어때요 {i}번 안건?") for i in range(60)]
    every = Report(chat(spark, rows, "r")).hot_topics.first()
    some = Report(chat(spark, rows, "r"), AnalysisOptions(signals_from_samples=True)).hot_topics.first()
    assert (every.questions, some.questions) == (60, 18)
    assert every.plans == 60 and every.keywords == some.keywords
