"""Chunked windows, exact ranks and samples against plain Python, also under skew."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from palaver.operators import flow, sampling
from palaver.operators.ordered import link_rows, ordered_rank
from palaver.operators.quantile import floor_rank, medians, values_at_ranks
from palaver.operators.activity import aliases


def skewed(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for room, share in (("hot", 0.6), ("warm", 0.3), ("cold", 0.1)):
        line = 0
        for _ in range(int(n * share)):
            line += rng.choice([1, 1, 1, 7, 40])
            rows.append((room, line, rng.choice("abc"), rng.choice([1, 5, 40, 4000])))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 25, 10_000])
def test_link_rows_equals_plain_fold(spark, chunk):
    rows = skewed()
    df = spark.createDataFrame(rows, "room_id string, line bigint, sender string, v bigint").repartition(5)
    got = link_rows(df, ["sender", "v"], {"run": lambda c, p: c["sender"] != p["sender"]}, chunk_rows=chunk)
    got = {(r.room_id, r.line): (r.prev.sender if r.prev else None, r.run_id) for r in got.collect()}
    want, last, run = {}, {}, {}
    for room, line, sender, _ in rows:
        prev = last.get(room)
        run[room] = run.get(room, 0) + (prev is None or prev != sender)
        want[(room, line)] = (prev, run[room])
        last[room] = sender
    assert got == want


@pytest.mark.parametrize("chunk", [2, 50])
def test_ordered_rank(spark, chunk):
    df = spark.createDataFrame(skewed(), "room_id string, line bigint, sender string, v bigint")
    got = ordered_rank(df, ["room_id"], "line", "n", chunk).collect()
    for room in ("hot", "warm", "cold"):
        mine = sorted((r.line, r.n) for r in got if r.room_id == room)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("width", [1, 64, 65_536])
def test_exact_ranks(spark, width):
    rows = skewed()
    df = spark.createDataFrame(rows, "room_id string, line bigint, sender string, v bigint")
    got = values_at_ranks(df, ["room_id"], "v", {"p50": floor_rank(0.5), "p90": floor_rank(0.9)}, width).collect()
    for r in got:
        v = sorted(x[3] for x in rows if x[0] == r.room_id)
        assert (r.n, r.p50, r.p90) == (len(v), v[int(len(v) * 0.5)], v[min(len(v) - 1, int(len(v) * 0.9))])
    for r in medians(df, ["room_id"], "v").collect():
        assert r["median"] == statistics.median(x[3] for x in rows if x[0] == r.room_id)


def test_sample_is_exact_repeatable_and_order_free(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("room_id"), F.col("id").alias("line"))
    caps = spark.createDataFrame([("hot", 300), ("cold", 5000)], "room_id string, cap int")
    pick = lambda d: sorted((r.room_id, r.line) for r in sampling.hash_sample(d, caps).collect())
    first = pick(df)
    assert first == pick(df.repartition(7).orderBy(F.desc("line")))
    assert sum(r == "hot" for r, _ in first) == 300
    assert sum(r == "cold" for r, _ in first) == 1667  # fewer rows than the cap: all kept
    digest = lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest()
    want = sorted((x for x in range(5000) if x % 3), key=digest)[:300]
    assert sorted(want) == [x for r, x in first if r == "hot"]


def test_grown_sample_equals_sample_of_all(spark):
    rows = spark.range(3000).select(F.lit("r").alias("room_id"), F.col("id").alias("line"))
    caps = spark.createDataFrame([("r", 100)], "room_id string, cap int")
    old = sampling.hash_sample(rows.filter("line < 1700"), caps)
    grown = sampling.grow_sample(old, rows.filter("line >= 1700").withColumn("sample_rank", F.lit(0)), caps)
    want = sampling.hash_sample(rows, caps)
    assert sorted(r.line for r in grown.collect()) == sorted(r.line for r in want.collect())


def test_alias_collisions_follow_first_appearance(spark):
    people = spark.createDataFrame(
        [("r", "kim1", 5), ("r", "kam1", 900), ("r", "kom1", 7), ("r", "bo", 1), ("r", "", 2)],
        "room_id string, sender string, first_line bigint",
    )
    got = {r.sender: r.alias for r in aliases(people, chunk_rows=3).collect()}
    assert got == {"kim1": "k**1", "kom1": "k**1·2", "kam1": "k**1·3", "bo": "b*", "": "?"}
    anon = {r.sender: r.alias for r in aliases(people, "anonymous", 3).collect()}
    assert anon["bo"] == "User 001" and anon["kam1"] == "User 005"


def test_conservation_laws(spark):
    from palaver.sources.tables import event_messages

    messages = event_messages(spark, "/root/testdata/sf0.001")
    f = flow.conversation_flow(messages, 17)
    n = messages.count()
    switches = flow.switches(f).agg(F.sum("switches")).first()[0]
    assert flow.sessions(f).agg(F.sum("messages")).first()[0] == n
    assert flow.runs(f).agg(F.sum("length")).first()[0] == n
    assert flow.reply_edges(f).agg(F.sum("replies")).first()[0] == switches
