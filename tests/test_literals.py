"""Literal expectations of single operators."""

import math

import pytest
from chat import chat, day_counts
from pyspark.sql import functions as F

from palaver.functions import notices, numeric, text, tokens, tone
from palaver.operators import activity, features, flow, inequality, insights, keywords, room_events, series, tone as tone_ops, topics


def value(spark, column, data):
    return [r.v for r in spark.createDataFrame([(d,) for d in data], "x string").select(column(F.col("x")).alias("v")).collect()]


NOTICES = [
    ("메시지가 삭제되었습니다.", "deleted"), ("관리자가 메시지를 가렸습니다.", "hidden"),
    ("관리자만 말하기 기능이 활성화되었습니다", "slowModeOn"), ("관리자만 말하기 기능이 해제되었습니다", "slowModeOff"),
    ("가나님이 부방장이 되었습니다.", "subManager"), ("가나님이 방장이 되었습니다.", "manager"), ("샵검색: 맛집", "shopSearch"),
    ("샵검색 맛집", "shopSearch"), ("사진 3장", "photoBundle"), ("가나님을 내보냈습니다.", "kick"), ("가나님이 나갔습니다.", "leave"),
    ("들어왔습니다", "join"), ("가나님이 선물과 메시지를 보냈습니다.", None), ("샵검색", None), ("안녕", None),
]


def test_notice_kinds(spark):
    got = value(spark, lambda c: notices.notice_kind(notices.normalise_line(c)), [n for n, _ in NOTICES])
    assert got == [k for _, k in NOTICES]


def test_search_tags(spark):
    got = value(spark, notices.search_tag, ["샵검색: 맛집", "샵검색 #카페", "#태그", "샵검색"])
    assert got == ["#맛집", "#카페", "#태그", None]


def test_split_collapses_moderation_tails(spark):
    data = ["본문\n관리자가 메시지를 가렸습니다.\n메시지가 삭제되었습니다.", "메시지가 삭제되었습니다.", "한 줄", '글,"","관리자가 메시지를 가렸습니다."']
    got = notices.with_split(spark.createDataFrame([(d,) for d in data], "message string")).collect()
    assert (got[0].user_text, got[0].notices) == ("본문", ["hidden"])
    assert (got[1].user_text, got[1].notices) == ("", ["deleted"])
    assert (got[2].user_text, got[2].notices) == ("한 줄", [])
    assert got[3].notices == []  # the tail sits on the same line, so the line is user text


def test_boilerplate(spark):
    rules = "강퇴 기준 안내입니다 욕설과 도배는 금지이며 반복되면 바로 내보냅니다 모두 함께 즐거운 방을 만들어 가요"
    assert value(spark, notices.is_boilerplate, ["반가워! 닉 옆에 정치성향 적어 주시면 감사하겠습니다", rules, "오늘 점심 뭐 먹지"]) == [True, True, False]


def test_masks_rooms_and_scrub(spark):
    assert value(spark, text.mask_name, ["Alice", "Bob", "ab", "x", " ", "abcdefghijkl"]) == ["A***e", "B*b", "a*", "x*", "?", "a******l"]
    names = ["/x/AbcTalk_Chat_우리방_2026-05-16-15-03-41.csv", "AbcTalk_모임.csv", "방.txt"]
    assert value(spark, text.room_name_from_file, names) == ["우리방", "모임", "방"]
    dirty = "가 https://a.b/c?d 나 me@x.co 123456  끝 "
    assert value(spark, text.scrub, [dirty]) == ["가 링크 나 이메일 숫자 끝"]
    assert len(value(spark, text.evidence, ["가" * 80])[0]) == 56


def test_lengths_blanks_and_rounding(spark):
    assert value(spark, text.utf16_length, ["ab😀", "가"]) == [4, 1]
    assert value(spark, text.trim_all, ["　  a b\n"]) == ["a b"]
    assert value(spark, text.squeeze, ["a　　b  c\nd e"]) == ["a b c d e"]
    assert value(spark, lambda c: numeric.half_up(c.cast("double")), ["-2.5", "2.5"]) == [-2.0, 3.0]


def test_display(spark):
    n = value(spark, lambda c: numeric.compact_number(c.cast("double")), ["999", "12345", "3000000", "123456789", "29650000000"])
    assert n == ["999", "1.2만", "300만", "1.2억", "297억"]
    g = value(spark, lambda c: numeric.gap_text(c.cast("double")), ["0.001", "0.5", "2.04", "12.6"])
    assert g == ["1초 미만", "30초", "2분", "13분"]


def test_domains_and_emojis(spark):
    got = value(spark, text.domains, ["보라 www.Sample.org/a 와 http://news.x.net:80/b", "없음"])
    assert got == [["sample.org", "news.x.net"], []]
    assert value(spark, text.emojis, ["굿 👍❤️ 1\ufe0f ok ©"]) == [["👍", "❤️", "1\ufe0f"]]
    assert value(spark, text.emoji_category, ["👍", "😡", "🚀"]) == ["positive", "anger", "neutral"]


def test_tone(spark):
    assert value(spark, tone.speech_level, ["좋아요", "그건 아니지", "확인했습니다", ""]) == ["honorific", "neutral", "honorific", "neutral"]
    hits = value(spark, lambda c: tone.squeezed_profanity_hits(tone.profanity_text(c)), ["시 발 SHIT", "좋은 날"])
    assert hits == [2, 0]
    labels = value(spark, lambda c: tone.sentiment_label(c, F.lit(0.9)), ["POSITIVE", "LABEL_0", "3 stars", "5 stars", "x"])
    assert labels == ["positive", "negative", "neutral", "positive", "neutral"]


def test_hashtags_and_tokens(spark):
    assert value(spark, text.hashtags, ["#배포 #배포 #a1 #1x 끝"]) == [["배포", "a1"]]
    got = value(spark, tokens.tokens, ["Claude 그리고 GPT4 ㅋㅋㅋㅋㅋ 12 배포자동화해서 좋다고"])
    assert got == [["클로드", "그리고", "gpt4", "배포자동화해서", "배포자동화", "좋다고"]]
    assert value(spark, tokens.normalise_term, ["클코", "코덱스가", "회의는", "일정"]) == ["클로드", "코덱스", "회의", "일정"]
    assert value(spark, tokens.is_noise, ["진짜", "api", "ab", "1234", "배포", "그래요는요", "하나둘셋넷다섯여"]) == [True, True, True, True, False, False, True]


def test_gap_statistics(spark):
    seconds = [0, 1, 3, 6, 10, 15]
    f = flow.conversation_flow(chat(spark, [(s, "a", "m") for s in seconds]))
    assert flow.gap_profile(flow.gaps(f)).first().gap_cv == pytest.approx(math.sqrt(2.5e6) / 3000, abs=0.01)
    shares = flow.conversation_flow(chat(spark, [(s, "a", "m") for s in (0, 5, 35, 155, 755, 4355)]))
    assert flow.gap_profile(flow.gaps(shares)).first().under_1m_percent == 40.0
    same = flow.conversation_flow(chat(spark, [(s, "a", "m") for s in (0, 5, 10)]))
    assert flow.gap_profile(flow.gaps(same)).first().gap_cv is None


def test_sessions_split_after_thirty_minutes(spark):
    f = flow.conversation_flow(chat(spark, [(0, "a", "m"), (60, "a", "m"), (60 + 1801, "a", "m"), (60 + 1920, "a", "m")]))
    r = flow.session_stats(flow.sessions(f)).first()
    assert (r.sessions, r.avg_messages) == (2, 2.0)
    exact = flow.conversation_flow(chat(spark, [(0, "a", "m"), (1800, "a", "m")]))
    assert flow.sessions(exact).count() == 1


def test_replies_runs_and_participants(spark):
    who = "aababbbb"
    messages = chat(spark, [(i * 9, w, "hello") for i, w in enumerate(who)])
    f = flow.conversation_flow(messages, 2)
    edges = {(r.source, r.target): r.replies for r in flow.reply_edges(f).collect()}
    assert edges == {("a", "b"): 2, ("b", "a"): 1}
    assert {r.sender: r.max_consecutive for r in flow.longest_runs(f).collect()} == {"a": 2, "b": 4}
    assert flow.monologue(f).first().monologue_messages == 2
    people = activity.participants(activity.plain_sender_day(messages), flags=False)
    matrix = {(r.source, r.target): r.replies for r in flow.reply_matrix(flow.reply_edges(f), flow.matrix_members(people)).collect()}
    assert matrix == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 1, ("b", "b"): 0}


def test_system_rows_count_for_totals_only(spark):
    messages = chat(spark, [(0, "a", "안녕하세요"), (5, "a", "b님이 들어왔습니다."), (9, "b", "c님이 나갔습니다."), (12, "c", "메시지가 삭제되었습니다."), (20, "d", "들어왔습니다")])
    f = features.message_features(messages)
    cells = activity.sender_day(f)
    summary = activity.room_summary(cells).first()
    assert (summary.total_messages, summary.participants) == (5, 4)
    events = room_events.room_events(room_events.notice_days(f), activity.room_summary(cells)).first()
    assert (events["join"], events["leave"], events["deleted"], events["all_notices"]) == (2, 1, 1, 4)
    assert {r.sender: r.messages for r in activity.participants(cells).collect()} == {"a": 1, "b": 0, "c": 0, "d": 0}


def test_bursts_arc_silence_chapters(spark):
    days = day_counts(spark, [100, 120, 110, 400, 380, 105])
    got = series.bursts(days).orderBy("rank").collect()
    assert len(got) >= 2 and got[0].messages == 400
    mad = series.bursts(day_counts(spark, [10, 12, 11, 9, 200, 10]), "mad").collect()
    assert [r.messages for r in mad] == [200]
    arc = {r.segment: r.messages for r in series.activity_arc(day_counts(spark, [10] * 13 + [30] * 7)).collect()}
    assert arc["tail"] > arc["head"] and arc["whole"] == 340
    gap = day_counts(spark, [1, 1, 1, 1], gaps={2: 20})
    assert series.silence(gap).first().max_silence == 19
    assert series.streaks(gap).first().longest_streak == 2


def test_calendar_is_dense(spark):
    days = day_counts(spark, [3, 8], gaps={1: 19})
    grid = series.calendar_grid(days).collect()
    assert len(grid) % 7 == 0 and {r.weekday for r in grid} == set(range(7))
    assert sum(r.messages for r in grid) == 11 and len({r.day for r in grid}) == len(grid)


def test_inequality_and_profile(spark):
    people = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 10)], "room_id string, sender string, messages bigint")
    assert inequality.gini(people).first().gini == 0.5
    zero = spark.createDataFrame([("r", "a", 0)], "room_id string, sender string, messages bigint")
    assert inequality.gini(zero).first().gini is None
    counts = spark.createDataFrame([("r", "x", 2), ("r", "y", 2)], "room_id string, domain string, count bigint")
    assert inequality.entropy_bits(counts).first().entropy_bits == 1.0
    row = {k: 0 for k in ("shopSearch",)} | {"room_id": "r", "total_messages": 1000, "join": 90, "leave": 60, "all_notices": 150}
    open_room = room_events.open_room_profile(spark.createDataFrame([row])).first()
    assert open_room.likely_open and open_room.join_leave_percent >= 14


def test_keyword_floors_and_scores(spark):
    got = [r.v for r in spark.createDataFrame([(9_000,), (55_000,), (120_000,)], "n int").select(keywords.min_count(F.col("n"), F.lit(True)).alias("v")).collect()]
    assert got == [4, 12, 20]
    score = lambda df: keywords.bm25(F.lit(df), F.lit(df), F.lit(1000), F.lit(8.0))
    r = spark.range(1).select(score(40).alias("mid"), score(900).alias("common")).first()
    assert r.mid > r.common


def test_class_terms(spark):
    rows = [("r", "a", "apple", 10), ("r", "a", "banana", 2), ("r", "b", "banana", 8), ("r", "b", "cherry", 5)]
    classes = spark.createDataFrame(rows, "room_id string, class string, term string, tf bigint")
    top = {(r["class"], r["rank"]): r.term for r in topics.class_tfidf(classes, 3).collect()}
    assert top[("a", 1)] == "apple" and "cherry" in top.values()
    assert {r.term for r in topics.class_tfidf(classes, 3, 2).collect()} == {"banana"}


def test_phrase_peak(spark):
    day = 86_400
    rows = [(0, "a", "반복해서 쓰는 긴 환영 문구입니다"), (day, "a", "반복해서 쓰는 긴 환영 문구입니다"), (day + 5, "b", "반복해서  쓰는 긴 환영 문구입니다")]
    r = keywords.repeated_phrases(keywords.phrases(chat(spark, rows), "message")).first()
    assert r["count"] == 3 and str(r.peak_day) == "2026-03-02"


def test_sentiment_sample(spark):
    scored = spark.createDataFrame([("r", "a", "positive"), ("r", "a", "negative"), ("r", "b", "neutral")], "room_id string, sender string, label string")
    assert tone_ops.sentiment_stats(scored).first().sample == 3
    assert tone_ops.sentiment_by_sender(scored).count() == 2


def test_pace_takes_first_rule(spark):
    label = insights.pace_label(F.lit(90.0), F.lit(78.0), F.lit(0.9), F.lit(0.0), F.lit(70.0))
    assert spark.range(1).select(label.alias("v")).first().v == "live_debate"
