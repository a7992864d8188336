"""Export reader, discovery, word lists, sinks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from palaver.sources import chat_export as ce
from palaver.sources import discovery, lexicons, sinks
from palaver.streaming.rooms import settings as st_settings

TEXT = (
    "Date,User,Message\n"
    '2026-05-01 09:00:00,"Alice","안녕하세요, ""모두"" 반가워요"\n'
    "두번째 줄\n"
    "2026-05-01 09:01:00,Bob,사진\n"
    '2026-05-01 09:02:00,"Kim, Jr",끝\n'
    "2026-13-01 09:03:00,Bob,잘못된 달\n"
)
WANT = [
    ("Alice", '"안녕하세요, ""모두"" 반가워요"\n두번째 줄'.replace('"안녕하세요, ""모두"" 반가워요"', '안녕하세요, "모두" 반가워요')),
    ("Bob", "사진"), ("Kim, Jr", "끝"), ("Bob", "잘못된 달"),
]


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


@pytest.mark.parametrize("encoding,seen", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8-bom"), ("cp949", "cp949")])
def test_reader_finds_the_encoding(spark, tmp_path, encoding, seen):
    put(tmp_path, "AbcTalk_Chat_방_2026-05-16-15-03-41.csv", TEXT, encoding)
    exports = ce.load_exports(spark, str(tmp_path))
    rows = exports.orderBy("line").collect()
    assert [(r.sender, r.message) for r in rows] == WANT
    assert {r.encoding for r in rows} == {seen}
    assert rows[3].ts == dt.datetime(1970, 1, 1)
    assert {r.room_id for r in ce.messages_of(exports).collect()} == {"방"}
    assert [r.code for r in ce.warnings_of(exports).collect()] == ["invalid_date"]


@pytest.mark.parametrize("split", [1, 7, 40, 64, 10_000])
def test_any_split_gives_the_same_records(spark, tmp_path, split):
    put(tmp_path, "a.csv", TEXT)
    put(tmp_path, "b.csv", TEXT.replace("\n", "\r\n"))
    rows = ce.load_exports(spark, str(tmp_path), split).orderBy("path", "line").collect()
    assert [(r.sender, r.message) for r in rows] == WANT * 2


def test_warnings_and_bad_headers(spark, tmp_path):
    put(tmp_path, "x.csv", 'When,Who,What\nlost line\n2026-05-01 09:00:00,"open quote,hello\n')
    exports = ce.load_exports(spark, str(tmp_path))
    codes = [r.code for r in ce.warnings_of(exports).collect()]
    assert codes == ["unexpected_header", "continuation_without_record", "sender_parse_error"]
    row = exports.first()
    assert (row.sender, row.message) == ('"open quote', "hello")


def test_plain_text_form_matches_the_reader(spark, tmp_path):
    path = put(tmp_path, "a.csv", TEXT)
    lines = [("a", i, v) for i, v in enumerate(open(path, encoding="utf-8").read().splitlines())]
    d = ce.messages_from_lines(spark.createDataFrame(lines, "room_id string, line bigint, value string"))
    assert [(r.sender, r.message) for r in d.orderBy("line").collect()] == WANT
    assert d.filter(F.year("ts") == 1970).count() == 1


def test_profile_and_estimate(spark, tmp_path):
    put(tmp_path, "a.csv", TEXT)
    p = ce.export_profile(ce.messages_of(ce.load_exports(spark, str(tmp_path)))).first()
    assert (p.messages, p.participants, p.multiline) == (4, 3, 1)
    files = spark.createDataFrame([("a", 1_000_000)], "path string, length bigint")
    assert ce.estimate_messages(files).first().estimate == 5500


def test_latest_export_per_room(spark, tmp_path):
    for i, name in enumerate(["QTalk_Chat_r1_2026-05-16-15-03-41.csv", "QTalk_Chat_r1_2026-06-16-15-03-41.csv", "QTalk_Chat_r2_2026-05-16-15-03-41.csv"]):
        os.utime(put(tmp_path, name, TEXT), (1_700_000_000 + i * 100,) * 2)
    put(tmp_path, "notes.txt", "x")
    files = discovery.list_exports(spark, str(tmp_path))
    newest = {r.room_id: r.file_name for r in discovery.latest_exports(files).collect()}
    assert set(newest) == {"r1", "r2"} and "2026-06" in newest["r1"]
    assert [r.room_id for r in discovery.latest_exports(files, 1).collect()] == ["r1"]
    assert discovery.latest_exports(files, 0, 10**9).count() == 0


def test_word_lists_and_sinks(spark, tmp_path):
    put(tmp_path, "w.txt", "# comment\n나쁜말\n\n bad \n")
    assert lexicons.words(spark, str(tmp_path / "w.txt")) == ("나쁜말", "bad")
    with pytest.raises(ValueError):
        lexicons.words(spark, str(tmp_path / "w.txt"), limit=1)
    put(tmp_path, "ref.json", '{"reference": {"gini": [0.1, 0.2]}}')
    assert lexicons.reference_bands(spark, str(tmp_path / "ref.json")) == {"gini": [0.1, 0.2]}
    sinks.write_tables({"t": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 3


# the file layer takes a byte-order mark away before lines are seen
@pytest.mark.parametrize("encoding,seen", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp949", "cp949")])
def test_lines_through_the_file_layer(spark, tmp_path, encoding, seen):
    from palaver.sources import export_lines as ex

    put(tmp_path, "AbcTalk_Chat_방_2026-05-16-15-03-41.csv", TEXT, encoding)
    put(tmp_path, "AbcTalk_Chat_b_2026-05-16-15-03-41.csv", "Datum,User,Message\r\nstray\r\n2026-05-01 09:00:00,Bob,hi\r\n")
    lines = ex.text_lines(ex.raw_lines(spark, str(tmp_path)))
    rows = ex.records(lines).orderBy("room_id", "line").collect()
    assert [(r.sender, r.message) for r in rows if r.room_id == "b"] == [("Bob", "hi")]
    mine = [r for r in rows if r.room_id == "방"]
    assert [(r.sender, r.message) for r in mine] == WANT and mine[3].ts == dt.datetime(1970, 1, 1)
    assert {r.encoding for r in lines.filter(~F.col("path").contains("_b_")).collect()} == {seen}
    assert {(r.room_id, r.code) for r in ex.warnings(lines).collect()} == {
        ("방", "invalid_date"), ("b", "unexpected_header"), ("b", "continuation_without_record"),
    }


def test_encoding_of_a_file_with_a_long_ascii_start(spark, tmp_path):
    from palaver.sources import export_lines as ex

    start = "Date,User,Message\n" + "".join(f"2026-05-01 09:00:{i % 60:02},u,hello {i}\n" for i in range(2500))
    korean = "2026-05-02 09:00:00,u,안녕하세요 반갑습니다\n2026-05-02 09:01:00,u,두번째 줄\n"
    put(tmp_path, "a.csv", start + korean, "cp949")
    put(tmp_path, "b.csv", start + korean)
    with open(os.path.join(tmp_path, "c.csv"), "wb") as f:  # UTF-8 with one damaged line
        f.write((start + korean).encode() + b"2026-05-02 09:02:00,u,cut \xec\n")
    put(tmp_path, "d.csv", start)
    lines = ex.text_lines(ex.raw_lines(spark, str(tmp_path)))
    seen = {r["path"][-5]: r["encoding"] for r in lines.select("path", "encoding").distinct().collect()}
    assert seen == {"a": "cp949", "b": "utf-8", "c": "utf-8", "d": "utf-8"}
    last = lines.filter(F.col("value").startswith("2026-05-02 09:00")).collect()
    assert [r["value"].split(",")[2] for r in last] == ["안녕하세요 반갑습니다"] * 3


def test_lines_of_a_file_read_in_many_splits(spark, tmp_path):
    from palaver.sources import export_lines as ex

    text = "Date,User,Message\n" + "".join(f"2026-05-01 09:00:{i % 60:02},u{i},m{i}\nmore {i}\n" for i in range(4000))
    put(tmp_path, "a.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ex.records(ex.text_lines(ex.raw_lines(spark, str(tmp_path)))).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.sender, r.message) for r in rows] == [(f"u{i}", f"m{i}\nmore {i}") for i in range(4000)]


@pytest.mark.parametrize("split", [40, 10_000])
def test_reader_takes_a_date_bound_over(spark, tmp_path, split, monkeypatch):
    """``ts >=`` is pushed into the reader: it decodes no older record, and gives what a filter gives."""
    text = "Date,User,Message\nstray\n" + "".join(f"2026-05-{d:02d} 09:00:00,Bob,day {d}\nmore {d}\n" for d in range(1, 29)) + "2026-13-01 09:00:00,Bob,no date\n"
    put(tmp_path, "a.csv", text)
    bound = F.lit("2026-05-20").cast("timestamp_ntz")
    pushed = "spark.sql.python.filterPushdown.enabled"
    plain = [(r.line, r.message, r.ts) for r in ce.load_exports(spark, str(tmp_path), split).collect() if r.ts >= dt.datetime(2026, 5, 20)]
    with st_settings(spark, **{pushed: "true"}):
        d = ce.load_exports(spark, str(tmp_path), split).filter(F.col("ts") >= bound)
        assert sorted((r.line, r.message, r.ts) for r in d.collect()) == sorted(plain) and len(plain) == 9
        assert ">=" not in d._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # Spark filters for nulls only
    decoded = []
    real = ce.parse_start
    monkeypatch.setattr(ce, "parse_start", lambda line, n: decoded.append(line) or real(line, n))
    parts = ce.plan_ranges([str(tmp_path / "a.csv")], split)
    rows = [r for p in parts for r in ce.read_range(p, "2026-05-20 00:00:00")]
    assert len(rows) == 9 and len(decoded) == 10  # the record whose date cannot be read is looked at


def test_records_since_a_day(spark, tmp_path):
    from palaver.sources import export_lines as ex

    put(tmp_path, "a.csv", TEXT + "2026-05-03 10:00:00,Bob,later\nwith more\n")
    lines = ex.text_lines(ex.raw_lines(spark, str(tmp_path)))
    assert [r.message for r in ex.records(lines, since="2026-05-02").collect()] == ["later\nwith more"]
    assert ex.records(lines, since="1970-01-01").count() == 5


def test_rows_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    from palaver.sources.tables import chat_messages

    rows = spark.range(4000).selectExpr("id as event_id", "timestamp_ntz'2026-01-01 00:00:00' as ts", "id as user_id", "'r' as event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        held = [len(p) for p in chat_messages(spark, str(tmp_path)).rdd.map(lambda r: r["line"]).glom().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(held) == 4000 and max(held) < 1000


ROOMS = "room_id string, line bigint, ts timestamp_ntz, sender string, message string"


def test_many_rooms_are_files_of_few_folders(spark, tmp_path):
    """A folder per room made readers list each; files must stay one per room, with the same records."""
    from palaver.sources import export_lines as ex

    names = [*(f"{k}" for k in range(60)), "a/b", "방 1.txt", None]
    at = dt.datetime(2026, 5, 1, 9)
    rows = [(n, k, at + dt.timedelta(seconds=k), 'x"y', f"{n}\nmore" if k else "one") for n in names for k in range(2)]
    base = f"file://{tmp_path}/out"
    sinks.write_exports(spark.createDataFrame(rows, ROOMS).repartition(5), base)
    found = [(folder, f) for folder, _, files in os.walk(tmp_path / "out") for f in files if f.endswith(".txt")]
    assert len(found) == len(names) and len({folder for folder, _ in found}) <= 16
    room = F.regexp_extract("path", sinks.ROOM_IN_PATH, 1)
    got = ex.records(ex.text_lines(ex.raw_lines(spark, base)), room).collect()
    assert len(got) == len(rows)
    assert {(r.room_id, r.ts, r.sender, r.message) for r in got if r.room_id.isdigit()} == {(n, t, s, m) for n, _, t, s, m in rows if n and n.isdigit()}
    assert sum("a%2Fb" in f for _, f in found) == 1 and len({r.room_id for r in got}) == len(names)


def test_spoilt_rooms_are_files_of_few_folders(spark, tmp_path):
    """The exports behind the warnings: one file per room, not one folder per room."""
    from palaver.plans import text_queries as tq

    spark.sql("select id as conv_id, 0L as turn, 'user' as role, 'two\nlines' as text from range(40)").write.parquet(f"{tmp_path}/conversations.parquet")
    paths = [r.path for r in tq._export_files(spark, str(tmp_path), True).select("path").distinct().collect()]
    assert len(paths) == 40 and len({p.rsplit("/", 1)[0] for p in paths}) <= 16
    got = {(r.room_id, r.code): r["count"] for r in tq.export_warnings(spark, str(tmp_path)).collect()}
    codes = {3: "unexpected_header", 4: "continuation_without_record", 5: "invalid_date", 6: "sender_parse_error"}
    assert got == {(f"{k}", codes[k % 10]): 1 for k in range(40) if k % 10 in codes}
