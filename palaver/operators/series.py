"""Day-level series: islands, bursts, chapters, calendar.

Inputs are daily counts (at most one row per room and calendar day), so a window
per room is bounded by the length of the calendar, not by the traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.numeric import half_up, percent
from palaver.operators.topk import top_k

ROOM = ["room_id"]


def _by_day():
    return Window.partitionBy("room_id").orderBy("day")


def streaks(days: DataFrame) -> DataFrame:
    """Longest run of consecutive active days."""
    d = days.withColumn("_i", F.date_sub("day", F.row_number().over(_by_day())))
    return d.groupBy("room_id", "_i").agg(F.count("*").alias("_n")).groupBy("room_id").agg(
        F.max("_n").alias("longest_streak")
    )


def silence(days: DataFrame) -> DataFrame:
    """Longest silence between active days, and the day on which talk resumed."""
    d = days.withColumn("_gap", F.date_diff("day", F.lag("day").over(_by_day())) - 1)
    agg = d.groupBy("room_id").agg(
        F.count("*").alias("_n"), F.max("_gap").alias("max_silence"),
        F.max_by("day", F.struct(F.col("_gap"), -F.unix_date("day"))).alias("_day"),
    )
    resumed = (F.col("_n") >= 3) & (F.col("max_silence") >= 5)
    return agg.select("room_id", "max_silence", F.when(resumed, F.col("_day")).alias("resume_day"))


def chapters(days: DataFrame, sender_days: DataFrame, gap_days: int = 7) -> DataFrame:
    """Stretches split at gaps of more than ``gap_days``, with their main speaker."""
    d = days.withColumn("_new", (F.date_diff("day", F.lag("day").over(_by_day())) > gap_days).cast("int"))
    d = d.withColumn(
        "chapter", 1 + F.sum(F.coalesce("_new", F.lit(0))).over(_by_day().rowsBetween(Window.unboundedPreceding, 0))
    )
    spans = d.groupBy("room_id", "chapter").agg(
        F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count("*").alias("active_days"),
        F.sum("messages").alias("messages"),
    )
    per_sender = sender_days.join(d.select("room_id", "day", "chapter"), ["room_id", "day"]).groupBy(
        "room_id", "chapter", "sender"
    ).agg(F.sum("messages").alias("_m"))
    top = top_k(per_sender, ["room_id", "chapter"], [F.desc("_m"), F.asc("sender")], 1).select(
        "room_id", "chapter", F.col("sender").alias("top_sender"), "_m"
    )
    total = F.sum("messages").over(Window.partitionBy("room_id"))
    return spans.withColumn("_t", total).join(top, ["room_id", "chapter"], "left").select(
        "room_id", "chapter", "from_day", "to_day", "active_days", "messages",
        percent(F.col("messages"), F.col("_t")).alias("share_percent"), "top_sender",
        percent(F.col("_m"), F.col("messages")).alias("top_share_percent"),
    )


def activity_arc(days: DataFrame) -> DataFrame:
    """Whole period, and the first / last seven active days from ten days on."""
    r = Window.partitionBy("room_id")
    d = (
        days.withColumn("_a", F.row_number().over(_by_day()))
        .withColumn("_n", F.count("*").over(r))
    )
    long = F.col("_n") >= 10
    tags = F.array_compact(F.array(
        F.lit("whole"), F.when(long & (F.col("_a") <= 7), F.lit("head")),
        F.when(long & (F.col("_a") > F.col("_n") - 7), F.lit("tail")),
    ))
    return d.select("room_id", F.explode(tags).alias("segment"), "messages").groupBy("room_id", "segment").agg(
        F.sum("messages").alias("messages"), F.count("*").alias("active_days")
    ).withColumn("messages_per_active_day", half_up(F.col("messages") / F.col("active_days"), 1))


MILESTONES = (1000, 5000, 10000, 50000, 100000)


def milestones(days: DataFrame) -> DataFrame:
    """Day on which the n-th message fell, for the reached milestones."""
    cum = F.sum("messages").over(_by_day().rowsBetween(Window.unboundedPreceding, 0))
    d = days.withColumn("_hi", cum).withColumn("_lo", cum - F.col("messages"))
    marks = F.array(*[F.lit(n) for n in MILESTONES])
    hit = F.filter(marks, lambda n: (n > F.col("_lo")) & (n <= F.col("_hi")))
    return d.select("room_id", "day", F.explode(hit).alias("milestone"))


def month_peaks(days: DataFrame) -> DataFrame:
    """First busiest day of every month."""
    d = days.withColumn("month", F.date_format("day", "yyyy-MM"))
    return d.groupBy("room_id", "month").agg(
        F.max_by("day", F.struct(F.col("messages"), -F.unix_date("day"))).alias("day"),
        F.max("messages").alias("messages"),
    )


def _ranked(days: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("room_id").orderBy(value, "day")
    return days.withColumn("_r", F.row_number().over(w)).withColumn(
        "_n", F.count("*").over(Window.partitionBy("room_id"))
    )


def _pick(value: str, rank):
    return F.max(F.when(F.col("_r") == rank + 1, F.col(value)))


def day_quantiles(days: DataFrame) -> DataFrame:
    """Median, p90 and number of active days of the daily counts."""
    d = _ranked(days, "messages")
    n = F.col("_n")
    return d.groupBy("room_id").agg(
        F.max("_n").alias("days"),
        ((_pick("messages", F.floor((n - 1) / 2)) + _pick("messages", F.floor(n / 2))) / 2.0).alias("median"),
        _pick("messages", F.least(n - 1, F.floor(n * F.lit(0.9)))).alias("p90"),
    )


def burst_threshold(days: DataFrame) -> DataFrame:
    """Threshold from median, p90 and the length of the activity span."""
    q = day_quantiles(days)
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.35), F.col("days") / 120.0))
    median, p90 = F.col("median"), F.col("p90")
    bump = F.greatest(F.lit(2.0), F.floor(median * (0.1 + 0.08 * scale)).cast("double"))
    limit = F.greatest(
        F.ceil(median * (1.12 + 0.28 * scale)).cast("double"), F.ceil(p90 * (0.86 + 0.1 * scale)).cast("double"), median + bump
    )
    return q.filter(F.col("days") >= 4).select("room_id", limit.alias("threshold"))


def mad_threshold(days: DataFrame) -> DataFrame:
    """Median plus three scaled median absolute deviations."""
    q = day_quantiles(days).filter(F.col("days") >= 4).select("room_id", "median")
    dev = days.join(q, ROOM).withColumn("_dev", F.abs(F.col("messages") - F.col("median")))
    n = F.col("_n")
    mad = _ranked(dev, "_dev").groupBy("room_id").agg(
        ((_pick("_dev", F.floor((n - 1) / 2)) + _pick("_dev", F.floor(n / 2))) / 2.0).alias("_mad"),
        F.max("median").alias("median"),
    )
    spread = F.when(F.col("_mad") == 0, 1.0).otherwise(F.col("_mad"))
    limit = F.greatest(F.col("median") + 3 * 1.4826 * spread, F.col("median") + 2)
    return mad.select("room_id", F.ceil(limit).cast("double").alias("threshold"))


def bursts(days: DataFrame, method: str = "heuristic", k: int = 8) -> DataFrame:
    limits = mad_threshold(days) if method == "mad" else burst_threshold(days)
    hot = days.join(limits, ROOM).filter(F.col("messages") >= F.col("threshold"))
    return top_k(hot, ROOM, [F.desc("messages"), F.asc("day")], k)


def contribution_levels(days: DataFrame) -> DataFrame:
    """Quartile level 1-4 of every active day."""
    n = F.col("_n")
    at = lambda p: _pick("messages", F.greatest(F.lit(0), F.least(n - 1, F.ceil(F.lit(p) * n) - 1)))
    t = _ranked(days, "messages").groupBy("room_id").agg(
        F.sort_array(F.array_distinct(F.array(at(0.25), at(0.5), at(0.75), F.max("messages")))).alias("_t")
    )
    level = F.greatest(F.lit(1), F.least(F.lit(4), F.size(F.filter("_t", lambda x: F.col("messages") >= x))))
    return days.join(t, ROOM).select("room_id", "day", "messages", level.alias("level"))


def calendar_grid(days: DataFrame, max_weeks: int = 53) -> DataFrame:
    """Dense day cells in weeks that start on Sunday; the last ``max_weeks`` weeks."""
    sunday = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    span = days.groupBy("room_id").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    end = F.date_add(sunday(F.col("_b")), 6)
    start = F.greatest(sunday(F.col("_a")), F.date_sub(end, 7 * max_weeks - 1))
    spine = span.select("room_id", start.alias("_s"), F.explode(F.sequence(start, end)).alias("day"))
    levels = contribution_levels(days)
    return spine.join(levels, ["room_id", "day"], "left").select(
        "room_id", "day", F.floor(F.date_diff("day", "_s") / 7).cast("int").alias("week"),
        (F.dayofweek("day") - 1).alias("weekday"),
        F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("level", F.lit(0)).alias("level"),
    )


def month_labels(grid: DataFrame) -> DataFrame:
    """Weeks in which the month of the first cell changes."""
    weeks = grid.groupBy("room_id", "week").agg(F.month(F.min("day")).alias("month"))
    w = Window.partitionBy("room_id").orderBy("week")
    prev = F.lag("month").over(w)
    return weeks.withColumn("_p", prev).filter(F.col("_p").isNull() | (F.col("_p") != F.col("month"))).drop("_p")


def heat_levels(days: DataFrame) -> DataFrame:
    """Level 0-4 by the ratio to the busiest day."""
    ratio = F.col("messages") / F.max("messages").over(Window.partitionBy("room_id"))
    level = F.when(ratio <= 0.15, 0).when(ratio <= 0.35, 1).when(ratio <= 0.55, 2).when(ratio <= 0.75, 3).otherwise(4)
    return days.select("room_id", "day", "messages", level.alias("heat"))


def short_span(days: DataFrame) -> DataFrame:
    """Rooms with fewer than 90 active days in at most two months hide period cards."""
    months = days.groupBy("room_id", F.date_format("day", "yyyy-MM").alias("m")).agg(F.count("*").alias("d"))
    s = months.groupBy("room_id").agg(F.sum("d").alias("active_days"), F.count("*").alias("months"))
    return s.withColumn("short_span", (F.col("active_days") < 90) & (F.col("months") <= 2))


def period_cut(days: DataFrame) -> DataFrame:
    """Middle active day, from 14 active days on."""
    d = _ranked(days.withColumn("_d", F.unix_date("day")), "_d")
    return d.groupBy("room_id").agg(
        F.max("_n").alias("_days"), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("day"))).alias("cut_day")
    ).filter(F.col("_days") >= 14).select("room_id", "cut_day")
