"""Several micro-batches give what one batch job gives; late rows are set aside."""

import os
import time

from pyspark.sql import functions as F

from palaver.operators import flow as fl
from palaver.plans.catalogue import QUERIES
from palaver.sources.tables import event_messages, table
from palaver.streaming import rooms as st


def split_events(spark, folder, target, parts):
    """Files of consecutive events, with rising modification times."""
    os.makedirs(target, exist_ok=True)
    d = table(spark, folder, "events").toPandas().sort_values("event_id")
    step = -(-len(d) // parts)
    for i in range(parts):
        path = os.path.join(target, f"events-{i}.parquet")
        spark.createDataFrame(d.iloc[i * step : (i + 1) * step], st.EVENT_SCHEMA).coalesce(1).write.parquet(path + ".d")
        name = next(n for n in os.listdir(path + ".d") if n.endswith(".parquet"))
        os.link(os.path.join(path + ".d", name), path)
        os.utime(path, (time.time() - 1000 + i * 10,) * 2)


def test_flow_over_batches_equals_one_job(spark, folder, tmp_path):
    split_events(spark, folder, tmp_path, 4)
    stream = st.event_stream(spark, str(tmp_path), files_per_trigger=1)
    rows, late = st.flow(stream, 50)
    want = fl.conversation_flow(event_messages(spark, folder))
    cols = ["room_id", "line", "sender", "prev_sender", "gap_ms", "run_id", "session_id"]
    as_set = lambda d: {tuple(r) for r in d.select(*cols).collect()}
    assert as_set(rows) == as_set(want)
    assert late.count() == 0


def test_late_rows_are_counted_and_left_out(spark):
    new = lambda rows: spark.createDataFrame(rows, "room_id string, line bigint, ts timestamp, sender string")
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    _, _, carry = st.flow_step(new([("r", 5, t, "a")]), None)
    rows, late, carry = st.flow_step(new([("r", 4, t, "b"), ("r", 6, t + dt.timedelta(hours=1), "a"), ("q", 1, t, "z")]), carry)
    assert [(r.line, r.sender) for r in late.collect()] == [(4, "b")]
    got = {(r.room_id, r.line): (r.prev_sender, r.run_id, r.session_id) for r in rows.collect()}
    assert got == {("r", 6): ("a", 1, 2), ("q", 1): (None, 1, 1)}
    assert {(r.room_id, r.line) for r in carry.collect()} == {("r", 6), ("q", 1)}


def test_sample_and_first_seen_over_batches(spark, folder, tmp_path):
    split_events(spark, folder, tmp_path, 3)
    stream = lambda: st.event_stream(spark, str(tmp_path), files_per_trigger=1)
    from palaver.operators.sampling import hash_sample

    messages = event_messages(spark, folder)
    caps = messages.select("room_id").distinct().withColumn("cap", F.lit(20))
    want = {(r.room_id, r.line) for r in hash_sample(messages, caps).collect()}
    assert {(r.room_id, r.line) for r in st.sample(stream(), 20).collect()} == want
    per_day = st.first_seen(stream()).agg(F.sum("new_senders")).first()[0]
    assert per_day == messages.select("room_id", "sender").distinct().count()


def test_a_stopped_stream_goes_on(spark, folder, tmp_path):
    split_events(spark, folder, tmp_path / "all", 4)
    live = tmp_path / "live"
    live.mkdir()
    stream = lambda: st.event_stream(spark, str(live), files_per_trigger=1)
    for part in ((0, 1), (2, 3)):
        for i in part:
            os.link(tmp_path / "all" / f"events-{i}.parquet", live / f"events-{i}.parquet")
        name = f"again-{tmp_path.name}-{os.getpid()}"
        rows, late = st.flow(stream(), 50, resume=name)
        seen = st.first_seen(stream(), resume=name)
        held = st.sample(stream(), 20, resume=name)
    want = fl.conversation_flow(event_messages(spark, folder))
    cols = ["room_id", "line", "sender", "prev_sender", "gap_ms", "run_id", "session_id"]
    assert {tuple(r) for r in rows.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}
    assert late.count() == 0 and held.count() == 20 * want.select("room_id").distinct().count()
    assert seen.agg(F.sum("new_senders")).first()[0] == want.select("room_id", "sender").distinct().count()


# ---- keyed state, bounded state, export folders --------------------------------------

from palaver.streaming import exports, slots  # noqa: E402

CHAT = "room_id string, line bigint, ts timestamp, sender string, message string"


def hours(rows, upto):
    """Rows of the closed hours: those that end at or before ``upto`` (seconds)."""
    return [r for r in rows if (r[2] // 3600 + 1) * 3600 <= upto]


def plain_sessions(rows):
    out = []
    for room in sorted({r[0] for r in rows}):
        last = None
        for _, line, at, _ in sorted((r for r in rows if r[0] == room), key=lambda r: (r[2], r[1])):
            if last is None or at - last > 1800:
                out.append([room, at, at, 0])
            out[-1][2], out[-1][3], last = at, out[-1][3] + 1, at
    return sorted(map(tuple, out))


def plain_switches(rows):
    out = {}
    for room in {r[0] for r in rows}:
        mine = [r[3] for r in sorted((r for r in rows if r[0] == room), key=lambda r: (r[2], r[1]))]
        out[room] = (len(mine), sum(a != b for a, b in zip(mine, mine[1:])))
    return out


def test_slots_close_go_on_and_count_late_rows(spark, tmp_path):
    import datetime as dt
    import random

    rng = random.Random(3)
    rows = [(f"r{k % 2}", k, 400 * k + rng.randrange(300) + (7200 if k > 60 else 0), rng.choice("abc")) for k in range(120)]
    name, seen, late = f"slots-{tmp_path.name}-{os.getpid()}", [], 0
    for batch in range(4):
        mine = rows[30 * batch: 30 * batch + 30]
        if batch == 3:
            mine = [*mine, ("r0", 999, 10, "z")]  # its hour is closed
        start = dt.datetime(1970, 1, 1)
        d = spark.createDataFrame([(r, n, start + dt.timedelta(seconds=s), who, "x") for r, n, s, who in mine], CHAT)
        d.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{batch}"))
        seen += mine[:30]
        if batch % 2:
            stream = spark.readStream.schema(CHAT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            found, dropped = slots.run(stream, "30 minutes", resume=name)
            late += dropped
            closed = hours(seen, max(r[2] for r in seen) - 1800)
            got = {(r.room_id, r.slot_ms): r.messages for r in found.collect()}
            want = {}
            for r in closed:
                want[r[0], r[2] // 3600 * 3_600_000] = want.get((r[0], r[2] // 3600 * 3_600_000), 0) + 1
            assert got == want
            assert {r.room_id: (r.messages, r.switches) for r in slots.switches(found).collect()} == plain_switches(closed)
            us = 1_000_000
            assert sorted((r.room_id, r.start_us // us, r.end_us // us, r.messages) for r in slots.sessions(found).collect()) == plain_sessions(closed)
    assert late == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != next(iter(st.ON_DISK.values()))


def test_senders_are_sealed_once(spark, folder, tmp_path):
    split_events(spark, folder, tmp_path, 4)
    name = f"sealed-{tmp_path.name}-{os.getpid()}"
    days = st.first_seen(st.event_stream(spark, str(tmp_path), files_per_trigger=1), resume=name)
    messages = event_messages(spark, folder)
    first = messages.groupBy("room_id", "sender").agg(F.min_by(F.to_date("ts"), "line").alias("day"))
    want = {(r.room_id, r.day): r["count"] for r in first.groupBy("room_id", "day").count().collect()}
    assert {(r.room_id, r.day): r.new_senders for r in days.collect()} == want
    from palaver.session import work_dir

    sealed = spark.read.parquet(f"{work_dir(spark)}/first-seen-{name}/sealed")
    assert sealed.count() == first.count() and sealed.select("batch").distinct().count() > 1


def test_export_folder_as_a_stream(spark, tmp_path):
    """Snapshots that grow, repeat and cut a second in two; files arrive between triggers."""
    head = "Date,User,Message\n"
    line = lambda s, who, text: f'2026-05-01 09:00:{s:02d},"{who}",{text}\n'
    one = [line(1, "a", "hi"), line(1, "a", "hi"), line(2, "b", "two\nlines"), line(5, "a", "x")]
    two = [*one, line(5, "b", "same second"), line(5, "a", "x"), line(9, "c", "later")]
    other = [line(3, "z", "alone")]
    put = lambda n, rows: (tmp_path / n).write_text(head + "".join(rows), encoding="utf-8")
    run = lambda: exports.new_messages(exports.export_lines_stream(spark, str(tmp_path)), resume=f"ex-{tmp_path.name}-{os.getpid()}")
    put("QTalk_Chat_r1_2026-05-16-15-03-41.csv", one)
    assert [r.message for r in run().orderBy("line").collect()] == ["hi", "hi", "two\nlines", "x"]
    put("QTalk_Chat_r1_2026-05-17-15-03-41.csv", two)
    put("QTalk_Chat_r2_2026-05-17-15-03-41.csv", other)
    put("QTalk_Chat_r1_2026-05-18-15-03-41.csv", two)
    got = run().orderBy("room_id", "line").collect()
    assert [(r.room_id, r.sender, r.message) for r in got] == [
        ("r1", "a", "hi"), ("r1", "a", "hi"), ("r1", "b", "two\nlines"), ("r1", "a", "x"), ("r1", "b", "same second"), ("r1", "a", "x"),
        ("r1", "c", "later"), ("r2", "z", "alone"),
    ]
    assert len({(r.room_id, r.line) for r in got}) == 8
    assert run().count() == 8


def test_tables_of_part_files_stream_like_one_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha word{i % 3} beta{i}", "en", "s") for i in range(12)], "doc_id bigint, text string, lang string, source string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.room_id, r.term): r.df for r in QUERIES["stream_terms"](spark, str(tmp_path)).collect()}
    assert got == {("en", "alpha"): 12} | {("en", f"word{k}"): 4 for k in range(3)} | {("en", f"beta{i}"): 1 for i in range(12)}
    held = {r.term: (r.df, r.held, r.within) for r in QUERIES["stream_top_terms"](spark, str(tmp_path)).collect()}
    assert held["alpha"] == (12, True, True)
    events = spark.range(6).selectExpr(
        "id as event_id", "timestamp_ntz'2026-01-01 00:00:00' as ts", "id as user_id", "'view' as event_type", "0.0d as value", "'' as props")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert [r.messages for r in st.latest_counts(st.daily_counts(st.event_stream(spark, str(tmp_path))), "day", ["room_id"]).collect()] == [6]


def test_files_of_a_batch_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """A trigger names its files one by one; listing them took a task per file."""
    setting, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    whole = exports.run_batches
    monkeypatch.setattr(exports, "run_batches", lambda *a, **k: (seen.append(int(spark.conf.get(setting))), whole(*a, **k))[1])
    before = spark.conf.get(setting)
    (tmp_path / "QTalk_Chat_r1_2026-05-16-15-03-41.csv").write_text('Date,User,Message\n2026-05-01 09:00:01,"a",hi\n', encoding="utf-8")
    assert [r.message for r in exports.new_messages(exports.export_lines_stream(spark, str(tmp_path))).collect()] == ["hi"]
    assert seen[0] <= 8 * spark.sparkContext.defaultParallelism and spark.conf.get(setting) == before
