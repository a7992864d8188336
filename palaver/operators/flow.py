"""Conversation flow: gaps, switches, replies, runs and sessions.

All of it comes from one chunked pass (``conversation_flow``) over the user rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.numeric import half_up, percent, percent_or_null
from palaver.operators.ordered import CHUNK_ROWS, link_rows
from palaver.operators.quantile import floor_rank, medians, values_at_ranks
from palaver.operators.topk import top_k

ROOM = ["room_id"]
MAX_GAP_MS = 7 * 24 * 3600 * 1000
IDLE_MS = 30 * 60 * 1000
HIST_BINS = 64
LOG_LOW = 6.907755278982137     # ln(1 s in ms)
LOG_HIGH = 20.220408382829596   # ln(7 d in ms)


def conversation_flow(user_rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """user rows(room_id, line, ts, sender) with previous row, run and session ids."""
    d = user_rows.select(
        "room_id", "line", "sender", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    linked = link_rows(
        d, ["us", "sender"],
        {
            "run": lambda cur, prev: cur["sender"] != prev["sender"],
            "session": lambda cur, prev: (cur["us"] - prev["us"]) > IDLE_MS * 1000,
        },
        chunk_rows=chunk_rows,
    )
    return linked.select(
        "room_id", "line", "sender", "us", "run_id", "session_id",
        F.col("prev.sender").alias("prev_sender"),
        F.floor((F.col("us") - F.col("prev.us")) / F.lit(1000)).alias("gap_ms"),
    )


def gaps(flow: DataFrame) -> DataFrame:
    """Valid reply gaps: positive and at most seven days."""
    return flow.filter((F.col("gap_ms") > 0) & (F.col("gap_ms") <= MAX_GAP_MS)).select("room_id", "line", "gap_ms")


def gap_quantiles(gap_rows: DataFrame) -> DataFrame:
    """Exact median and 90th percentile in minutes."""
    q = values_at_ranks(gap_rows, ROOM, "gap_ms", {"_p50": floor_rank(0.5), "_p90": floor_rank(0.9)})
    return q.select(
        "room_id", F.col("n").alias("gaps"),
        half_up(F.col("_p50") / F.lit(60000.0), 1).alias("median_minutes"),
        half_up(F.col("_p90") / F.lit(60000.0), 1).alias("p90_minutes"),
    )


def gap_histogram(gap_rows: DataFrame) -> DataFrame:
    """64 log-spaced bins between one second and seven days (mergeable counts)."""
    log = F.ln(F.greatest(F.lit(1000), F.col("gap_ms")).cast("double"))
    bin_ = F.least(F.lit(HIST_BINS - 1), F.floor((log - LOG_LOW) / (LOG_HIGH - LOG_LOW) * HIST_BINS))
    return gap_rows.groupBy("room_id", bin_.cast("int").alias("bin")).agg(F.count("*").alias("gaps"))


def histogram_quantiles(hist: DataFrame) -> DataFrame:
    """Bin-centre quantiles of the log histogram, in minutes."""
    room = Window.partitionBy("room_id")
    d = hist.withColumn("_n", F.sum("gaps").over(room)).withColumn(
        "_acc", F.sum("gaps").over(room.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    )
    centre = F.exp(F.lit(LOG_LOW) + (F.col("bin") + 0.5) / HIST_BINS * (LOG_HIGH - LOG_LOW))
    pick = lambda p: half_up(F.min(F.when(F.col("_acc") >= F.col("_n") * p, centre)) / F.lit(60000.0), 1)
    return d.groupBy("room_id").agg(pick(0.5).alias("median_minutes"), pick(0.9).alias("p90_minutes"))


def gap_profile(gap_rows: DataFrame) -> DataFrame:
    """Coefficient of variation and the shares of short and long gaps."""
    g = F.col("gap_ms")
    return gap_rows.groupBy("room_id").agg(
        F.count("*").alias("_n"), F.stddev_samp(g).alias("_sd"), F.avg(g).alias("_mean"),
        F.count_if(g < 60_000).alias("_short"), F.count_if(g > 3_600_000).alias("_long"),
    ).select(
        "room_id", F.col("_n").alias("gaps"),
        F.when((F.col("_n") >= 2) & (F.col("_sd") > 0), half_up(F.col("_sd") / F.col("_mean"), 2)).alias("gap_cv"),
        percent_or_null(F.col("_short"), F.col("_n")).alias("under_1m_percent"),
        percent_or_null(F.col("_long"), F.col("_n")).alias("over_60m_percent"),
    )


def switches(flow: DataFrame) -> DataFrame:
    return flow.groupBy("room_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("prev_sender") != F.col("sender")).alias("switches")
    )


def reply_edges(flow: DataFrame) -> DataFrame:
    """Directed edges previous speaker -> current speaker."""
    return (
        flow.filter(F.col("prev_sender") != F.col("sender"))
        .groupBy("room_id", F.col("prev_sender").alias("source"), F.col("sender").alias("target"))
        .agg(F.count("*").alias("replies"))
    )


def matrix_members(people: DataFrame, k: int = 12) -> DataFrame:
    return top_k(people, ROOM, [F.desc("messages"), F.asc("sender")], k).select("room_id", "sender", "rank", "messages")


def visible_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (two semi joins)."""
    ends = members.select("room_id", "sender")
    out = edges.join(ends.withColumnRenamed("sender", "source"), ["room_id", "source"], "left_semi")
    return out.join(ends.withColumnRenamed("sender", "target"), ["room_id", "target"], "left_semi")


def reply_matrix(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Dense member x member cells; at most twelve members per room by construction."""
    rooms = members.groupBy("room_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sender"))).alias("_m"))
    cells = rooms.select("room_id", "_m", F.explode("_m").alias("_s")).select(
        "room_id", "_s", F.explode("_m").alias("_t")
    ).select(
        "room_id", F.col("_s.rank").alias("source_rank"), F.col("_s.sender").alias("source"),
        F.col("_t.rank").alias("target_rank"), F.col("_t.sender").alias("target"),
    )
    return cells.join(edges, ["room_id", "source", "target"], "left").withColumn(
        "replies", F.coalesce("replies", F.lit(0))
    )


def top_pairs(edges: DataFrame, members: DataFrame, k: int = 8) -> DataFrame:
    order = [F.desc("replies"), F.asc("source"), F.asc("target")]
    return top_k(visible_edges(edges, members), ROOM, order, k)


def interaction_view(edges: DataFrame, members: DataFrame, max_links: int = 60) -> DataFrame:
    """Links worth drawing: above a data-driven threshold, strongest first."""
    seen = visible_edges(edges, members).filter(F.col("source") != F.col("target"))
    floor = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.max("replies") * F.lit(0.02))))
    limits = seen.groupBy("room_id").agg(floor.alias("threshold"))
    kept = seen.join(limits, ROOM).filter(F.col("replies") >= F.col("threshold"))
    return top_k(kept, ROOM, [F.desc("replies"), F.asc("source"), F.asc("target")], max_links)


def interaction_nodes(edges: DataFrame, members: DataFrame, k: int = 15) -> DataFrame:
    seen = visible_edges(edges, members)
    ends = seen.select("room_id", F.explode(F.array("source", "target")).alias("sender"), "replies")
    totals = ends.groupBy("room_id", "sender").agg(F.sum("replies").alias("replies"))
    return top_k(totals, ROOM, [F.desc("replies"), F.asc("sender")], k)


def runs(flow: DataFrame) -> DataFrame:
    return flow.groupBy("room_id", "run_id", "sender").agg(F.count("*").alias("length"))


def longest_runs(flow: DataFrame) -> DataFrame:
    return runs(flow).groupBy("room_id", "sender").agg(F.max("length").alias("max_consecutive"))


def monologue(flow: DataFrame) -> DataFrame:
    """Messages at the third or a later place of a run (length - 2 of each run)."""
    return runs(flow).groupBy("room_id").agg(
        F.sum("length").alias("messages"), F.sum(F.greatest(F.col("length") - 2, F.lit(0))).alias("monologue_messages")
    )


def sessions(flow: DataFrame) -> DataFrame:
    return flow.groupBy("room_id", "session_id").agg(
        F.count("*").alias("messages"), F.min_by("us", "line").alias("start_us"), F.max_by("us", "line").alias("end_us")
    )


def session_stats(session_rows: DataFrame) -> DataFrame:
    """Number, mean size and true median length of the sessions."""
    ms = F.floor((F.col("end_us") - F.col("start_us")) / F.lit(1000))
    sizes = session_rows.groupBy("room_id").agg(
        F.count("*").alias("sessions"), half_up(F.avg("messages"), 1).alias("avg_messages")
    )
    lengths = session_rows.select("room_id", ms.alias("ms")).filter(F.col("ms") >= 0)
    med = medians(lengths, ROOM, "ms").select(
        "room_id", half_up(F.col("median") / F.lit(60000.0), 1).alias("median_minutes")
    )
    return sizes.join(med, ROOM, "left")


def flow_summary(flow: DataFrame, totals: DataFrame) -> DataFrame:
    """Rates per 100 messages over all rows: totals(room_id, total_messages)."""
    s = switches(flow).select("room_id", "switches")
    m = monologue(flow).select("room_id", "monologue_messages")
    return totals.join(s, ROOM, "left").join(m, ROOM, "left").select(
        "room_id",
        percent(F.coalesce("switches", F.lit(0)), F.col("total_messages"), 2).alias("switches_per_100"),
        percent(F.coalesce("monologue_messages", F.lit(0)), F.col("total_messages")).alias("monologue_percent"),
    )
