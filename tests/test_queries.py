"""Registered queries against their SQL (a fast choice; PALAVER_ALL=1 runs every one)."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from palaver.plans.catalogue import ORACLES, QUERIES

FAST = [
    "participants", "daily", "hourly", "time_profile", "dayparts", "room_summary", "chapters", "bursts_heuristic",
    "calendar_grid", "gini", "gap_quantiles", "gap_profile", "session_stats", "reply_matrix", "runs", "notice_split",
    "msg_flags", "room_events", "domains", "emoji_counts", "lexicon_sentiment", "profanity", "toxicity_stats", "scrub",
    "tokens_korean", "bigram_stats", "repeated_phrases", "cosine", "cluster_coherence", "stream_switches", "stream_sessions",
]
NAMES = list(ORACLES) if os.environ.get("PALAVER_ALL") else FAST


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
