"""Heavy steps are done once: texts are made, composed, scrubbed and cleaned in one pass each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as text_fn
from palaver.operators import features as feat
from palaver.operators import insights as ins
from palaver.operators import text_nfc
from palaver.plans import text_queries as tq
from palaver.plans import topic_queries as topics
from palaver.plans.report import Report
from palaver.sources import tables as src


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with a small events table."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=37 * i), i % 7, "ab"[i % 2], 1.0, "{}") for i in range(600)]
    folder = str(tmp_path_factory.mktemp("events"))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture
def calls(monkeypatch):
    """How often features are made and contexts are scrubbed."""
    found = {"message_features": 0, "scored_context": 0}

    def counted(name):
        real = getattr(feat, name)

        def run(*args):
            found[name] += 1
            return real(*args)

        monkeypatch.setattr(feat, name, run)

    for name in found:
        counted(name)
    return found


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_composing_deals_the_rows_once(spark, events):
    composed = text_nfc.compose(src.chat_messages(spark, events))
    assert plan(composed).count("RepartitionByExpression") == 1
    assert "Filter" not in plan(composed)


def test_composed_texts(spark):
    texts = [None, "", "plain ㅋㅋ 한글", "cafe\u0301", "\u1112\u1161\u11ab", "\u2764\ufe0f \u212b", "e\u0301 \u00e0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line bigint, message string")
    got = [r.message for r in text_nfc.compose(df).orderBy("line").collect()]
    assert got == [None, "", "plain ㅋㅋ 한글", "caf\u00e9", "\ud55c", "\u2764\ufe0f \u00c5", "\u00e9 \u00e0"]


def test_contexts_are_scrubbed_once(spark, events, calls):
    Report(src.chat_messages(spark, events)).hot_topics
    assert calls == {"message_features": 1, "scored_context": 1}


def test_lanes_and_topics_share_features(spark, events, calls):
    topics._seeds(spark, events, *topics._chat_frames(spark, events))
    assert calls["message_features"] == 1


def test_a_text_is_cleaned_once_for_all_terms(spark):
    texts = spark.createDataFrame([("r", 1, "Server  setup")], "room_id string, item bigint, text string")
    pool = spark.createDataFrame([("r", ["none", "server setup"])], "room_id string, pool array<string>")
    stats = spark.createDataFrame([("r", 500, ["7"])], "room_id string, total_messages bigint, stats array<string>")
    gate = ins.evidence_gate(texts, pool, stats)
    tested = plan(gate).split("exists(pool")[1].split("lambda")[1]
    assert "regexp_replace" not in tested
    assert [r.accepted for r in gate.collect()] == [True]


def test_scrubbed_texts(spark):
    texts = {
        "see https://a.b/c now": "see 링크 now", "HTTP://X.Y z": "링크 z", "www.a.b c": "링크 c", "me@a.org!": "이메일!",
        "call 123456 or 1234": "call 숫자 or 1234", "a@b  c": "a@b c", "https://x/y@z.org ok": "링크 ok", "": "",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.s for r in df.select("text", text_fn.scrub(F.col("text")).alias("s")).collect()} == texts


def test_odd_only_messages_have_no_user_text(spark):
    texts = ['""', ' ," ', "　", '"a"', "a", None]
    rows = [("r", i, dt.datetime(2024, 1, 1), "s", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "room_id string, line bigint, ts timestamp_ntz, sender string, message string")
    from palaver.functions.notices import with_split

    got = [r.user_text for r in with_split(df).orderBy("line").collect()]
    assert got[0] == "" and got[2] == "" and got[3:5] == ['"a"', "a"]
