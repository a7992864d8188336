"""Secret scan with corpus-wide ownership of the values found.

Three fixed kinds of spans come from each text (``assign``, ``access``, ``hex``). Further
candidates are bare values: runs of letters and digits that mix both, look random and lie
outside those spans. Every value is hashed; the corpus then tells, for each hash, how many
documents, repositories and owners hold it. A value that few repositories and owners hold is
``live``; one that many hold is a copied ``example``. Bare candidates become spans of kind
``bare`` only if they are live. Fixed spans always stay, and carry their class.

The counts go through two aggregates (per hash and owner first), so a value copied into a
large part of all documents is summed where it is found. Documents without candidates skip
all shuffles.

Cases: null text is empty; a null owner counts as one owner; repeated rows are scanned like
any others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, materialise, text_of

# fixed values: patterns of the base kinds, and the least lengths
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "bare")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
BARE_BITS = 3.2  # entropy a character that a bare value has at least
MAX_OWNERS = 2  # owners of a live value, at most
MAX_REPOSITORIES = 2

SPAN = "struct<kind:int,start:long,end:long,hash:string>"
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    f"spans array<{SPAN}>"
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the fixed kinds."""
    found = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= LEAST_ASSIGN:
                found.append((0, m.start(), m.end(), m[1]))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    found = []
    for m in BARE.finditer(text):
        value = m[0]
        letters = sum(c.isalpha() for c in value)
        if not 4 <= letters <= len(value) - 4 or entropy(value) < BARE_BITS:
            continue
        if all(m.end() <= start or m.start() >= end for _, start, end, _ in taken):
            found.append((3, m.start(), m.end(), value))
    return found


def named(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))
    for batch in batches:
        counts, digests, all_spans = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            counts.append(Counter(s[0] for s in base))
            digests.append(hashlib.sha256(named(base).encode()).hexdigest())
            every = sorted(base + bare_spans(text, base), key=lambda s: (s[1], s[0]))
            all_spans.append([
                {"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, a, b, v in every
            ])
        columns = [batch.column("doc_id"), batch.column("owner"), batch.column("repository")]
        columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        columns += [pa.array(digests, pa.string()), pa.array(all_spans, span)]
        yield pa.RecordBatch.from_arrays(
            columns, ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        )


def ownership(candidates: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """hash, owners, repositories, documents, live from (hash, owner, repository) rows."""
    per_place = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("documents"))
    per_owner = per_place.groupBy("hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("documents").alias("documents")
    )
    return per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("documents").alias("documents")
    ).withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def scan_secrets(
    docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: counts of the fixed kinds, all spans with class and spread of their values."""
    source = columns_of(docs, *dict.fromkeys(["doc_id", "text", owner, *repository])).select(
        "doc_id", text_of().alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"),
    )
    # one pass over the texts; the row number is fixed once the table is written
    scanned = source.mapInArrow(_scan, "doc_id long, owner string, repository string, " + SCHEMA.split(", ", 1)[1])
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")

    some = scanned.where(F.size("spans") > 0)
    spans = some.select("row", "owner", "repository", F.explode("spans").alias("s")).select(
        "row", "owner", "repository", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"),
        F.col("s.end").alias("end"), F.col("s.hash").alias("hash"),
    )
    spread = ownership(spans.select("hash", "owner", "repository", "row").distinct().drop("row"), max_owners, max_repositories)
    classed = spans.join(spread, "hash").where((F.col("kind") < 3) | F.col("live"))
    listed = classed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", "live", "owners", "repositories", "documents", "hash"
    ))).alias("found"))
    kept = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    nothing = scanned.where(F.size("spans") == 0).select(*kept, F.array().cast(listed.schema["found"].dataType).alias("found"))
    return some.join(listed, "row", "left").select(
        *kept, F.coalesce("found", F.array().cast(listed.schema["found"].dataType)).alias("found")
    ).unionByName(nothing)


def span_text(found: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")
