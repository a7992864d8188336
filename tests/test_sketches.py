"""Sketches: error bounds, bounded size, merging, and the stream's state."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import flow as fl
from palaver.operators import sketches as sk
from palaver.sources.tables import event_messages
from palaver.streaming import rooms as st


def terms(spark, seed, rare, room="r"):
    """A few frequent terms among ``rare`` that occur once."""
    rng = random.Random(seed)
    rows = [(room, f"top{k}") for k in range(5) for _ in range(400 - 60 * k)] + [(room, f"{room}{seed}-{k}") for k in range(rare)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "room_id string, term string")


@pytest.mark.parametrize("parts", [1, 6])
def test_heavy_hitters_stay_within_their_error(spark, parts):
    rows = terms(spark, 1, 6000).unionByName(terms(spark, 2, 40, "q")).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    exact = {(r.room_id, r.term): r["count"] for r in rows.groupBy("room_id", "term").count().collect()}
    held = sk.merge_items(sk.count_items(rows, ["room_id", "part"], "term", 128), ["room_id"], 128)
    found = {(r.room_id, r.term): r for r in sk.item_estimates(held, ["room_id"], "term", 128).collect()}
    for key, r in found.items():
        assert exact[key] <= r.estimate <= exact[key] + r.over
    totals = {"r": 6000 + 1400, "q": 40 + 1400}
    for (room, term), n in exact.items():
        if n > 2 * 3.5 / sk.map_size(128) * totals[room]:
            assert (room, term) in found
    assert {t for room, t in found if room == "q"} >= {f"top{k}" for k in range(5)}
    top = sk.top_items(held, ["room_id"], 2, "term", 128).where("room_id = 'r'").orderBy("rank").collect()
    assert [r.term for r in top] == ["top0", "top1"]
    assert all(r.at_least <= exact["r", r.term] <= r.at_most for r in top)


def test_size_does_not_follow_the_vocabulary(spark):
    size = lambda d: sk.count_items(d, ["room_id"], "term", 64).select(F.length("items.sketch")).first()[0]
    assert size(terms(spark, 3, 50_000)) <= 1.5 * size(terms(spark, 4, 2_000))


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("r", None), ("r", "a"), (None, "b")], "room_id string, term string")
    held = sk.count_items(rows, ["room_id"], "term")
    assert {(r.room_id, r.rows) for r in held.collect()} == {("r", 1), (None, 1)}
    assert sk.item_estimates(sk.count_items(rows.limit(0), ["room_id"], "term"), ["room_id"]).count() == 0


def test_any_range_of_days(spark, folder):
    flow = fl.conversation_flow(event_messages(spark, folder)).cache()
    days = sk.day_sketches(flow).cache()
    every = sorted({r.day for r in days.collect()})
    rng = random.Random(5)
    for _ in range(4):
        first, last = rng.choice(every), rng.choice(every)
        got = {r.room_id: r for r in sk.day_estimates(sk.merge_days(sk.between(days, str(first), str(last)), ["room_id"]), ["room_id"]).collect()}
        low, high = sorted((first, last))
        rows = flow.withColumn("day", F.to_date(F.timestamp_micros("us"))).where(F.col("day").between(low, high)).collect()
        for room in {r.room_id for r in rows}:
            mine = [r for r in rows if r.room_id == room]
            senders = len({r.sender for r in mine})
            assert got[room].messages == len(mine)
            assert abs(got[room].senders - senders) <= max(1, sk.SENDER_ERROR * senders)
            gaps = sorted(r.gap_ms for r in mine if r.gap_ms is not None and 0 < r.gap_ms <= fl.MAX_GAP_MS)
            assert got[room].gap_rows == len(gaps)
            for p, q in ((0.5, got[room].p50), (0.9, got[room].p90)):
                if not gaps:
                    assert q is None
                    continue
                below, upto = sum(g < q for g in gaps), sum(g <= q for g in gaps)
                assert below <= len(gaps) * (p + sk.RANK_ERROR) and upto >= len(gaps) * (p - sk.RANK_ERROR)


def test_stream_state_is_merged_and_goes_on(spark, tmp_path):
    schema = "room_id string, line bigint, ts timestamp, sender string, message string"
    t, texts = dt.datetime(2026, 1, 1), []
    name = f"top-{tmp_path.name}-{os.getpid()}"
    for batch in range(4):
        rows = [("r", 1000 * batch + k, t, "a", f"common word{batch}x{k} other{k % 3}") for k in range(200)]
        texts += [r[4] for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{batch}"))
        if batch % 2:  # two files are there when the stream starts again
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
            state = st.top_terms(stream, tracked=64, resume=name)
    assert state.count() == 1 and state.first().rows == 4 * 200 * 3
    found = {r.term: r for r in sk.item_estimates(state, ["room_id"], "term", 64).collect()}
    for word, n in (("common", 800), ("other0", 268), ("other1", 268), ("other2", 264)):
        assert n <= found[word].estimate <= n + found[word].over
