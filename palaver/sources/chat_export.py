"""Chat export files as a Spark data source.

``spark.read.format("chat_export").load(path)`` plans byte ranges of all matching
files; a file larger than the split size is read by several tasks. Every range starts
at the first record that begins inside it and ends with the last such record, so
records with continuation lines are neither cut nor read twice. The line number of a
record is its byte offset in the file: it orders records, is unique, and needs no
counting of the lines before.

A filter ``ts >= ...`` is taken over by the reader (``spark.sql.python.filterPushdown.enabled``):
records before it are told by the bytes of their date and skipped with their continuation lines,
undecoded. Rows leave the reader as Arrow batches.
"""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

from palaver.functions.text import room_name_from_file

SCHEMA = (
    "path string, line bigint, raw_date string, ts timestamp_ntz, sender string, message string, "
    "encoding string, warnings array<struct<line: bigint, code: string, message: string>>"
)
SAMPLE = 512 * 1024
SPLIT = 64 * 1024 * 1024
START = re.compile(rb"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},", re.M)
HEADER = ["Date", "User", "Message"]


def encoding_score(text: str) -> int:
    """Plausibility of a decoding: header, dated lines, Hangul; minus broken characters."""
    sample = text[: 128 * 1024]
    score = 1000 if re.search(r"^Date,User,Message\b", sample, re.M) else 0
    score += 500 if sample.startswith("날짜,") else 0
    score += 10 * len(re.findall(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},", sample, re.M))
    score -= 50 * sample.count("�")
    return score + min(500, len(re.findall("[가-힣]", sample)))


def detect_encoding(head: bytes) -> str:
    """utf-8-bom, utf-8, cp949 or euc-kr from the first bytes of a file."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-bom"
    try:
        head[: _whole_utf8(head)].decode("utf-8")  # a sample may end inside a character
        return "utf-8"  # texts in Korean code pages are no valid UTF-8
    except UnicodeDecodeError:
        found = []
    for name in ("cp949", "euc-kr"):
        found.append((name, encoding_score(head.decode(name, errors="replace"))))
    return max(found, key=lambda f: f[1])[0]


def _whole_utf8(data: bytes) -> int:
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte < 0x80:
            return len(data)
        if byte >= 0xC0:
            need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return len(data) if need <= back else len(data) - back
    return len(data)


def read_field(text: str) -> tuple[str, int] | None:
    """One CSV field and the position after it; None if its quote is never closed."""
    if not text.startswith('"'):
        end = text.find(",")
        end = len(text) if end < 0 else end
        return text[:end], end
    closed = re.match(r'"((?:[^"]|"")*)"', text, re.S)
    return (closed.group(1).replace('""', '"'), closed.end()) if closed else None


def parse_start(line: str, number: int) -> tuple[str, str, str, list[tuple]]:
    """(raw date, sender, first message line, warnings) of a record's first line."""
    raw_date, _, rest = line.partition(",")
    field = read_field(rest)
    if field is None:
        sender, _, message = rest.partition(",")
        return raw_date, sender, message, [
            (number, "sender_parse_error", "Could not parse sender field from dated record line.")
        ]
    sender, end = field
    body = rest[end + 1 :] if rest[end : end + 1] == "," else rest[end:]
    whole = read_field(body)
    message = whole[0] if whole and whole[1] == len(body) else body
    return raw_date, sender, message, []


def header_fields(line: str) -> list[str]:
    out, rest = [], line.lstrip("﻿")
    while True:
        field = read_field(rest) or (rest, len(rest))
        out.append(field[0].strip())
        if field[1] >= len(rest):
            return out
        rest = rest[field[1] + 1 :]


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    size: int


def plan_ranges(paths: list[str], split: int) -> list[FileRange]:
    out = []
    for path in paths:
        size = os.path.getsize(path)
        out += [FileRange(path, a, min(a + split, size), size) for a in range(0, max(size, 1), split)]
    return out


def _lines(path: str, start: int):
    """(offset, line) from the first line start at or after ``start`` (the owner of a line

    is the range that holds its first byte), to the end of the file."""
    with open(path, "rb") as f:
        f.seek(max(start - 1, 0))
        if start > 0:
            f.readline()  # the rest of a line that began before the range
        while True:
            offset = f.tell()
            line = f.readline()
            if not line:
                return
            yield offset, line.rstrip(b"\r\n")


def read_range(part: FileRange, since: str | None = None):
    """Rows of the records whose first byte lies in the range, from the second ``since`` on."""
    first_second = since.encode() if since else b""
    skipping = False
    with open(part.path, "rb") as f:
        encoding = detect_encoding(f.read(SAMPLE))
    codec = "utf-8" if encoding.startswith("utf-8") else encoding
    current, early = None, []
    first = part.start == 0

    def row(c):
        return (part.path, c[0], c[1], _timestamp(c[1]), c[2], "\n".join(c[3]), encoding, c[4])

    for offset, data in _lines(part.path, part.start):
        if offset == 0:
            names = header_fields(data.decode(codec, errors="replace"))
            if names[:3] != HEADER:
                found = ",".join(names) or "(empty)"
                early.append((0, "unexpected_header", f"Expected Date,User,Message header but found {found}."))
        elif START.match(data):
            if current:
                yield row(current)
                current = None
            if offset >= part.end:
                break
            skipping = data[:19] < first_second
            if skipping:
                continue
            raw, sender, message, problems = parse_start(data.decode(codec, errors="replace"), offset)
            if _timestamp(raw).year == 1970 and not raw.startswith("1970-01-01 00:00:00"):
                problems.append((offset, "invalid_date", "Could not parse message date."))
            if since and f"{_timestamp(raw)}" < since:  # a date that cannot be read counts as 1970
                skipping = True
                continue
            current = (offset, raw, sender, [message], early + problems)
            early = []
        elif skipping:
            if offset >= part.end:  # the rest of a skipped record
                break
        elif current:
            current[3].append(data.decode(codec, errors="replace"))
        elif offset >= part.end:
            break
        elif first:
            if data.strip():
                early.append((offset, "continuation_without_record", "Found a continuation line before the first dated message."))
    if current:
        yield row(current)
    elif early and not since:  # a file without any record still reports its warnings
        yield (part.path, None, None, None, None, None, encoding, early)


def _timestamp(raw: str):
    import datetime as dt

    try:
        return dt.datetime.strptime(raw, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return dt.datetime(1970, 1, 1)


class ChatExportSource(DataSource):
    """Options: ``path`` (file, folder or glob), ``splitBytes``, ``takesDates`` (with filter push-down)."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        dated = self.options.get("takesDates", "false") == "true"
        return (DatedReader if dated else ChatExportReader)(self.options)


class ChatExportReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT))
        self.since: str | None = None

    def partitions(self):
        path = self.path
        paths = glob.glob(os.path.join(path, "*.csv")) if os.path.isdir(path) else glob.glob(path)
        return plan_ranges(sorted(paths), self.split)

    def read(self, partition):
        rows = []
        for row in read_range(partition, self.since):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class DatedReader(ChatExportReader):
    """The reader for sessions that let Python sources take filters (Spark allows the method only there)."""

    def pushFilters(self, filters):
        """Takes ``ts >= ...`` over; Spark applies all others."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("ts",) and not f.value.microsecond:
                second = f.value.strftime("%Y-%m-%d %H:%M:%S")
                self.since = max(self.since or second, second)
            else:
                yield f


BATCH = 4096
WARNING = pa.struct([("line", pa.int64()), ("code", pa.string()), ("message", pa.string())])
COLUMNS = pa.schema([
    ("path", pa.string()), ("line", pa.int64()), ("raw_date", pa.string()), ("ts", pa.timestamp("us")), ("sender", pa.string()),
    ("message", pa.string()), ("encoding", pa.string()), ("warnings", pa.list_(WARNING)),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = WARNING.names
    columns = [*zip(*rows)]
    columns[-1] = [[dict(zip(names, w)) for w in found] for found in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COLUMNS)], schema=COLUMNS)


def load_exports(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    spark.dataSource.register(ChatExportSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("chat_export").option("splitBytes", split_bytes).option("takesDates", pushed).load(path)


def messages_of(exports: DataFrame) -> DataFrame:
    """Export rows as messages; the room is taken from the file name."""
    return exports.filter(F.col("line").isNotNull()).select(
        room_name_from_file(F.col("path")).alias("room_id"), "line", "ts", "raw_date", "sender", "message"
    )


def warnings_of(exports: DataFrame) -> DataFrame:
    return exports.select(room_name_from_file(F.col("path")).alias("room_id"), F.explode("warnings").alias("w")).select(
        "room_id", "w.*"
    )


def messages_from_lines(lines: DataFrame, since: str | None = None) -> DataFrame:
    """The same records from plain text rows(room_id, line, value), in SQL only.

    With ``since`` (YYYY-MM-DD) older records are dropped by the date of their first line, before
    the lines of any record are gathered.

    A record is the dated line and the lines up to the next dated line; the number of
    the record is a running count over chunks of lines, so one long file does not end
    up in one task.
    """
    from palaver.functions import lexicon as lex
    from palaver.operators.ordered import link_rows

    d = lines.select("room_id", "line", "value", F.col("value").rlike(lex.RECORD_START).alias("starts"))
    d = link_rows(d, ["starts"], {"record": lambda cur, prev: cur["starts"]})
    # lines before the first record belong to none: they are left out before lines are gathered
    heads = d.filter("starts")
    if since:
        second = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
        heads = heads.filter(F.coalesce(second, F.lit("1970-01-01").cast("timestamp_ntz")) >= F.lit(since).cast("timestamp_ntz"))
    d = d.join(heads.select("room_id", "record_id").distinct(), ["room_id", "record_id"], "left_semi")
    body = F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda s: s["value"])
    r = d.groupBy("room_id", "record_id").agg(body.alias("v"), F.min("line").alias("line"))
    head = F.col("v")[0]
    quoted = '^[^,]*,"((?:[^"]|"")*)",?(.*)$'
    plain = "^[^,]*,([^,]*),?(.*)$"
    is_q = head.rlike('^[^,]*,"')
    pick = lambda i: F.when(is_q, F.regexp_extract(head, quoted, i)).otherwise(F.regexp_extract(head, plain, i))
    unquote = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    text = pick(2)
    whole = F.regexp_extract(text, '^"((?:[^"]|"")*)"$', 1)
    text = F.when(text.rlike('^"((?:[^"]|"")*)"$'), unquote(whole)).otherwise(text)
    rest = F.slice("v", 2, F.size("v"))
    ts = F.try_to_timestamp(F.substring(head, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return r.select(
        "room_id", "line", F.coalesce(ts, F.timestamp_seconds(F.lit(0))).cast("timestamp_ntz").alias("ts"),
        unquote(pick(1)).alias("sender"), F.concat_ws("\n", text, F.array_join(rest, "\n")).alias("message"),
        F.size("v").alias("lines"),
    ).withColumn("message", F.when(F.col("lines") == 1, F.regexp_replace("message", "\n$", "")).otherwise(F.col("message"))).drop("lines")


def estimate_messages(exports_files: DataFrame) -> DataFrame:
    """Row estimate from file sizes: files(path, length), 200 bytes per message plus 10 %."""
    return exports_files.select("path", F.ceil(F.ceil(F.col("length") / 200) * 1.1).alias("estimate"))


def export_profile(messages: DataFrame) -> DataFrame:
    """Messages, participants, range and multi-line messages per room."""
    per = messages.groupBy("room_id", "sender").agg(
        F.count("*").alias("n"), F.count_if(F.col("message").contains("\n")).alias("m"),
        F.min("line").alias("a"), F.max("line").alias("b"), F.min_by("ts", "line").alias("ta"), F.max_by("ts", "line").alias("tb"),
    )
    return per.groupBy("room_id").agg(
        F.sum("n").alias("messages"), F.count("*").alias("participants"), F.min_by("ta", "a").alias("first_ts"),
        F.max_by("tb", "b").alias("last_ts"), F.sum("m").alias("multiline"),
    )
