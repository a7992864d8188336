"""System notices, search tags, links and attachments per room and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions.numeric import half_up, percent, percent_or_null
from palaver.functions.text import squeeze, trim_all
from palaver.operators.topk import count_top, top_k

ROOM = ["room_id"]


def notice_days(features: DataFrame) -> DataFrame:
    """Notices per room, day and kind: the base of all notice tables."""
    return features.filter(F.size("notices") > 0).select("room_id", "day", F.explode("notices").alias("kind")).groupBy(
        "room_id", "day", "kind"
    ).agg(F.count("*").alias("notices"))


def room_events(notices: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per room: count of every kind, their sum and the shares in percent."""
    per_kind = notices.groupBy("room_id").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("notices")).otherwise(0)).alias(k) for k in lex.NOTICE_KINDS],
        F.sum("notices").alias("all_notices"),
    )
    names = [*lex.NOTICE_KINDS, "all_notices"]
    d = totals.select("room_id", "total_messages").join(per_kind, ROOM, "left").na.fill(0, names)
    return d.select(
        "room_id", "total_messages", *names,
        *[
            percent(F.col(k), F.col("total_messages"), 2).alias(f"{k}_percent")
            for k in ("join", "leave", "deleted", "hidden", "kick")
        ],
    )


def room_pulse(days: DataFrame, notices: DataFrame, new_senders: DataFrame) -> DataFrame:
    """Every active day with its joins, leaves, hides, kicks and new senders."""
    kinds = ("join", "leave", "hidden", "kick")
    moves = notices.groupBy("room_id", "day").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("notices")).otherwise(0)).alias(k) for k in kinds]
    )
    keys = ["room_id", "day"]
    return (
        days.select(*keys).join(moves, keys, "left").join(new_senders, keys, "left")
        .na.fill(0, [*kinds, "new_senders"])
    )


def pulse_sums(pulse: DataFrame) -> DataFrame:
    total = F.col("join") + F.col("leave") + F.col("hidden") + F.col("kick")
    return pulse.select("room_id", "day", total.alias("pulse")).filter("pulse > 0")


def open_room_profile(events: DataFrame) -> DataFrame:
    """Does the traffic of joins and notices look like an open room?"""
    total = F.col("total_messages")
    moves = (F.col("join") + F.col("leave")) / total * 100.0
    system = F.col("all_notices") / total * 100.0
    search = F.when(F.col("shopSearch") > 0, 0.15).otherwise(0.0)
    score = F.least(F.lit(1.0), moves / 12.0 + system / 40.0 + search)
    enough = total >= 30
    return events.select(
        "room_id",
        F.when(enough, (score >= 0.45) | (moves >= 8)).otherwise(F.lit(False)).alias("likely_open"),
        F.when(enough, half_up(score, 2)).otherwise(F.lit(0.0)).alias("score"),
        F.when(enough, half_up(moves, 1)).otherwise(F.lit(0.0)).alias("join_leave_percent"),
    )


def search_tags(features: DataFrame, k: int = 30) -> DataFrame:
    tags = features.filter(F.size("tags") > 0).select("room_id", F.explode("tags").alias("tag"))
    return count_top(tags, ROOM, "tag", k)


def search_audit(features: DataFrame) -> DataFrame:
    """Search notices with and without a usable tag; distinct tags via a pre-aggregate."""
    search = features.filter(F.array_contains("notices", "shopSearch"))
    per_room = search.groupBy("room_id").agg(
        F.sum(F.size(F.filter("notices", lambda k: k == "shopSearch"))).alias("search_notices"),
        F.sum(F.size("tags")).alias("tag_extractions"),
        F.count_if(F.size("tags") == 0).alias("untagged_notices"),
    )
    tags = search.select("room_id", F.explode("tags").alias("tag")).groupBy("room_id", "tag").agg(F.count("*").alias("c"))
    unique = tags.groupBy("room_id").agg(F.count("*").alias("unique_tags"))
    return per_room.join(unique, ROOM, "left").na.fill(0, ["unique_tags"])


def search_misses(features: DataFrame, k: int = 8) -> DataFrame:
    """The first untagged search notices of a room, for inspection."""
    miss = features.filter(F.array_contains("notices", "shopSearch") & (F.size("tags") == 0))
    first = top_k(miss.select("room_id", "line", "message"), ROOM, [F.asc("line")], k)
    return first.select("room_id", "rank", "line", squeeze(F.substring(trim_all(F.col("message")), 1, 120)).alias("sample"))


def attachment_counts(features: DataFrame, k: int = 30) -> DataFrame:
    marks = features.filter(~F.col("is_system") & F.col("has_attachment")).select("room_id", F.explode("markers").alias("marker"))
    return count_top(marks, ROOM, "marker", k)


def photo_share(features: DataFrame) -> DataFrame:
    d = features.filter(~F.col("is_system") & F.col("has_attachment")).groupBy("room_id").agg(
        F.sum(F.size("markers")).alias("_all"), F.count_if(F.array_contains("markers", "사진")).alias("_photo")
    )
    return d.select("room_id", percent_or_null(F.col("_photo"), F.col("_all")).alias("photo_percent"))


def domain_counts(features: DataFrame) -> DataFrame:
    hosts = features.filter(~F.col("is_system") & F.col("has_link")).select("room_id", F.explode("domains").alias("domain"))
    return hosts.groupBy("room_id", "domain").agg(F.count("*").alias("count"))


def top_domains(counts: DataFrame, k: int = 30) -> DataFrame:
    return top_k(counts, ROOM, [F.desc("count"), F.asc("domain")], k)


def link_spikes(cells: DataFrame, k: int = 6) -> DataFrame:
    """Days with at least three link messages."""
    d = cells.groupBy("room_id", "day").agg(F.sum("link_messages").alias("links")).filter("links >= 3")
    return top_k(d, ROOM, [F.desc("links"), F.asc("day")], k)


def plan_days(cells: DataFrame) -> DataFrame:
    return cells.groupBy("room_id", "day").agg(F.sum("plan_messages").alias("hits")).filter("hits > 0")
