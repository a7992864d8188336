"""Gold insight tables: rule-based facts over the small aggregated tables.

Inputs have one row per room, per room and day, or short top lists, so these joins
and windows are bounded by the calendar or by the list sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions import text as text_fn
from palaver.functions import tokens as tok
from palaver.functions.frames import once
from palaver.functions.numeric import half_up
from palaver.operators.topk import top_k
from palaver.session import materialise

ROOM = ["room_id"]
DAY = ["room_id", "day"]


# ---- labels of a room ---------------------------------------------------------------

def pace_label(burst: Column, switch: Column, gini: Column, slow: Column, rhythm: Column) -> Column:
    """First matching rule of six."""
    b, s = F.coalesce(burst, F.lit(0.0)), F.coalesce(slow, F.lit(0.0))
    return (
        F.when((b >= 65) & (switch >= 55), "live_debate")
        .when((b >= 45) & (switch >= 40), "fast_exchange")
        .when((s >= 25) & (b < 35), "asynchronous")
        .when(F.coalesce(gini, F.lit(0.4)) >= 0.75, "few_voices")
        .when(rhythm >= 62, "steady")
        .otherwise("mixed")
    )


# ---- roles and personas -----------------------------------------------------------------

ROLES = (
    "leader", "long_writer", "mood_maker", "reactor", "link_sharer", "attachment_sharer", "night_owl", "chain_talker",
)


def role_candidates(people: DataFrame, runs: DataFrame) -> DataFrame:
    """Per participant the roles they qualify for, best score first."""
    lead = people.groupBy("room_id").agg(
        F.max_by("sender", F.struct(F.col("messages"), -F.col("first_line"))).alias("_lead"),
        F.avg("average_length").alias("_mean_length"),
    )
    d = people.join(lead, ROOM).join(runs, ["room_id", "sender"], "left").na.fill(0, ["max_consecutive"])
    msg = F.greatest(F.col("messages"), F.lit(1))
    rate = lambda c: F.col(c) / msg
    rules = (
        ("leader", (F.col("sender") == F.col("_lead")) & (F.col("share_percent") >= 18), F.col("share_percent") + 30),
        ("long_writer", F.col("average_length") >= F.greatest(F.lit(28.0), F.col("_mean_length") * 1.45), F.col("average_length")),
        ("mood_maker", (rate("laugh_messages") >= 0.12) & (F.col("laugh_messages") >= 8), rate("laugh_messages") * 100),
        ("reactor", (rate("short_messages") >= 0.22) & (F.col("short_messages") >= 12), rate("short_messages") * 100),
        ("link_sharer", (rate("link_messages") >= 0.08) & (F.col("link_messages") >= 8), rate("link_messages") * 100),
        ("attachment_sharer", (rate("attachment_messages") >= 0.1) & (F.col("attachment_messages") >= 8), rate("attachment_messages") * 100),
        ("night_owl", (rate("night_messages") >= 0.25) & (F.col("night_messages") >= 10), rate("night_messages") * 100),
        ("chain_talker", F.col("max_consecutive") >= 10, F.col("max_consecutive") * 3),
    )
    found = F.array_compact(F.array(*[
        F.when(ok, F.struct((-score.cast("double")).alias("order"), F.lit(i).alias("place"), F.lit(name).alias("name")))
        for i, (name, ok, score) in enumerate(rules)
    ]))
    return d.select(
        "room_id", "sender", "first_line", F.transform(F.sort_array(found), lambda s: s["name"]).alias("roles")
    ).filter(F.size("roles") > 0)


def participant_roles(candidates: DataFrame, limit: int = 6) -> DataFrame:
    """Each role once per room, given in order of first appearance.

    A round gives one role in every room: the earliest participant behind the last one served who
    still finds a free role. That is a minimum per room, so no room is gathered anywhere.
    """
    d = materialise(candidates.select("room_id", "sender", "first_line", "roles"), "role-candidates")
    none = F.array().cast("array<string>")
    given = d.select("room_id").distinct().select(
        "room_id", none.alias("taken"), none.alias("senders"), F.lit(None).cast("bigint").alias("last")
    )
    for _ in range(limit):
        free = F.filter("roles", lambda r: ~F.array_contains("taken", r))
        behind = F.col("last").isNull() | (F.col("first_line") > F.col("last"))
        open_ = d.join(given, ROOM).where(behind).select("room_id", "first_line", "sender", free.alias("free")).where(F.size("free") > 0)
        next_ = open_.groupBy("room_id").agg(F.min(F.struct("first_line", "sender", F.col("free")[0].alias("role"))).alias("n"))
        more = lambda c, v: F.when(F.col("n").isNull(), F.col(c)).otherwise(F.array_append(c, v)).alias(c)
        given = materialise(given.join(next_, ROOM, "left").select(
            "room_id", more("taken", F.col("n.role")), more("senders", F.col("n.sender")), F.coalesce("n.first_line", "last").alias("last")
        ), "roles-given")
    pairs = F.posexplode(F.arrays_zip(F.col("taken").alias("role"), F.col("senders").alias("sender"))).alias("at", "p")
    return given.select("room_id", pairs).select("room_id", (F.col("at") + 1).alias("place"), "p.sender", "p.role")


def persona_candidates(top: DataFrame, runs: DataFrame) -> DataFrame:
    """Ranked persona titles of the eight most active participants."""
    d = top.filter(F.col("rank") <= 8).join(runs, ["room_id", "sender"], "left").na.fill(0, ["max_consecutive"])
    msg = F.greatest(F.col("messages"), F.lit(1))
    share = lambda c: half_up(F.col(c) / msg * 100.0, 1)
    night = share("night_messages")
    daytime = half_up(F.lit(100.0) - night, 1)
    attach, link, laugh, short = (share(f"{c}_messages") for c in ("attachment", "link", "laugh", "short"))
    length, run, total = F.col("average_length"), F.col("max_consecutive"), F.col("share_percent")
    rules = (
        ("centre", total >= 22, total),
        ("night_owl", night >= 18, night),
        ("day_person", (daytime >= 88) & (night <= 8), daytime),
        ("attachment_master", attach >= 12, attach),
        ("link_curator", link >= 8, link),
        ("chain_talker", run >= 8, run * 3),
        ("long_writer", length >= 36, length),
        ("one_liner", (length <= 12) & (msg >= 30), 100 - length),
        ("mood_maker", laugh >= 8, laugh),
        ("short_answers", short >= 18, short),
        ("quiet_observer", (F.col("messages") >= 40) & (total < 12) & (run <= 4), F.col("messages") * 0.4),
    )
    found = F.array_compact(F.array(*[
        F.when(ok, F.struct((-score.cast("double")).alias("order"), F.lit(i).alias("place"), F.lit(name).alias("name")))
        for i, (name, ok, score) in enumerate(rules)
    ]))
    return d.select("room_id", "sender", "rank", F.transform(F.sort_array(found), lambda s: s["name"]).alias("titles"))


def personas(candidates: DataFrame) -> DataFrame:
    """One title per participant, every title at most twice while there is a choice.

    The at most eight participants of a room are one array, which is folded from the first rank on.
    """
    eight = candidates.groupBy("room_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sender", "titles"))).alias("people"))
    start = F.array().cast("array<struct<rank:int,sender:string,persona:string>>")

    def step(done, p):
        often = lambda t: F.size(F.filter(done, lambda x: x["persona"] == t))
        free = F.filter(p["titles"], lambda t: often(t) < 2)
        pick = F.coalesce(F.try_element_at(free, F.lit(1)), F.try_element_at(p["titles"], F.lit(1)), F.lit("all_rounder"))
        return F.array_append(done, F.struct(p["rank"].cast("int").alias("rank"), p["sender"].alias("sender"), pick.alias("persona")))

    folded = eight.select("room_id", F.inline(F.aggregate("people", start, step)))
    return folded.select("room_id", "rank", "sender", "persona")


# ---- timeline ---------------------------------------------------------------------------

KIND_ORDER = {"milestone": -1, "burst": 0, "meme": 1, "peak": 2, "silence": 3, "room": 3, "newcomer": 4, "links": 5, "plan": 6}


def timeline(
    days: DataFrame, bursts: DataFrame, silence: DataFrame, pulse: DataFrame, links: DataFrame, phrases: DataFrame,
    plans: DataFrame, month_peaks: DataFrame,
) -> DataFrame:
    """Dated events of a room: best per (day, kind), two per day, 24 in all."""
    event = lambda d, kind, metric: d.select(
        "room_id", "day", F.lit(kind).alias("kind"), metric.cast("bigint").alias("metric")
    )
    churn = pulse.withColumn("_churn", F.col("join") + F.col("leave") + F.col("kick")).filter("_churn >= 5")
    newcomers = pulse.filter("new_senders >= 3")
    events = event(bursts.filter("rank <= 8"), "burst", F.col("messages"))
    for d in (
        event(silence.filter("resume_day is not null").withColumnRenamed("resume_day", "day"), "silence", F.col("max_silence")),
        event(top_k(churn, ROOM, [F.desc("_churn"), F.asc("day")], 4), "room", F.col("_churn")),
        event(top_k(newcomers, ROOM, [F.desc("new_senders"), F.asc("day")], 4), "newcomer", F.col("new_senders")),
        event(links.filter("rank <= 4"), "links", F.col("links")),
        event(phrases.filter("rank <= 3").withColumnRenamed("peak_day", "day"), "meme", F.col("count")),
        event(top_k(plans.filter("hits >= 3"), ROOM, [F.asc("day")], 4), "plan", F.col("hits")),
    ):
        events = events.unionByName(d)
    best = events.groupBy("room_id", "day", "kind").agg(F.max("metric").alias("metric"))

    size = best.groupBy("room_id").agg(F.count("*").alias("_n"))
    sparse = days.select("room_id").distinct().join(size, ROOM, "left").filter(F.coalesce("_n", F.lit(0)) < 8).select("room_id")
    ends = days.groupBy("room_id").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    marks = ends.select("room_id", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("day")).join(days, DAY)
    free = month_peaks.join(best.filter("kind = 'burst'").select(*DAY), DAY, "left_anti")
    extra = event(marks, "milestone", F.col("messages")).unionByName(event(free, "peak", F.col("messages")))
    merged = best.unionByName(extra.join(sparse, ROOM, "left_semi"))

    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_ORDER.items()])
    merged = merged.withColumn("_o", order)
    two = top_k(merged, DAY, [F.asc("_o"), F.asc("kind")], 2, "_d")
    return top_k(two, ROOM, [F.asc("day"), F.asc("_o"), F.asc("kind")], 24, "place").drop("_o", "_d")


# ---- hot topics and moments ----------------------------------------------------------------

def hot_topics(
    days: DataFrame, day_terms: DataFrame, samples: DataFrame, sender_days: DataFrame, bursts: DataFrame, k: int = 10,
    scored: DataFrame | None = None,
) -> DataFrame:
    """The busiest days with keywords, signals, main speakers and scrubbed evidence.

    Signals and spare keywords come from all ``scored`` messages of these days (without it: from
    the samples), added up by room and day; the samples give the evidence.
    """
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rank", c))), lambda s: s[c])
    mean = F.avg("messages").over(Window.partitionBy("room_id"))
    busy = top_k(days.withColumn("_mean", mean), ROOM, [F.desc("messages"), F.asc("day")], k)
    some = samples.join(busy.select(*DAY), DAY, "left_semi")
    every = some if scored is None else scored.join(busy.select(*DAY), DAY, "left_semi")

    terms = day_terms.filter("rank <= 4").groupBy(*DAY).agg(ordered("term").alias("_terms"))
    bare = every.join(terms.select(*DAY), DAY, "left_anti")  # days without keywords of their own
    words = bare.select(*DAY, F.explode(tok.tokens(F.col("text"))).alias("term"))
    words = words.filter(~F.col("term").isin(*lex.CONTEXT_STOP_TERMS) & ~tok.is_noise(F.col("term")))
    counts = words.groupBy(*DAY, "term").agg(F.count("*").alias("c"))
    spare = top_k(counts, DAY, [F.desc("c"), F.desc(F.length("term")), F.asc("term")], 4).groupBy(*DAY).agg(
        ordered("term").alias("_spare")
    )
    signals = every.groupBy(*DAY).agg(
        F.count_if("has_plan").alias("plans"), F.count_if("has_question").alias("questions"),
        F.count_if(F.col("has_attachment") | F.col("has_link")).alias("shares"), F.count_if("is_laugh").alias("laughs"),
    )
    speakers = top_k(sender_days.join(busy.select(*DAY), DAY, "left_semi"), DAY, [F.desc("messages"), F.asc("sender")], 3)
    speakers = speakers.groupBy(*DAY).agg(F.array_join(ordered("sender"), " ").alias("speakers"))

    d = busy.join(terms, DAY, "left").join(spare, DAY, "left").join(signals, DAY, "left").join(speakers, DAY, "left")
    d = d.join(bursts.select(*DAY, F.lit(True).alias("_burst")), DAY, "left")
    d = d.withColumn("_k", F.coalesce("_terms", "_spare", F.array().cast("array<string>")))

    hit = F.exists("_k", lambda t: F.contains(F.lower("text"), F.lower(t)))
    proof = some.join(d.select(*DAY, "_k"), DAY).withColumn("_hit", hit)
    proof = top_k(proof, DAY, [F.desc("_hit"), F.desc("score"), F.desc("length"), F.asc("line")], 2, "_p")
    proof = proof.groupBy(*DAY).agg(
        F.array_join(F.array_distinct(F.transform(
            F.sort_array(F.collect_list(F.struct("_p", text_fn.evidence(F.col("text")).alias("t")))), lambda s: s["t"]
        )), " | ").alias("evidence")
    )
    return d.join(proof, DAY, "left").select(
        "room_id", "day", "messages", half_up(F.col("messages") / F.greatest(F.col("_mean"), F.lit(1.0)), 1).alias("lift"),
        F.array_join("_k", " ").alias("keywords"), "plans", "questions", "shares", "laughs", "speakers",
        F.coalesce("_burst", F.lit(False)).alias("is_burst"), "evidence",
    )


MOMENT_WEIGHT = {"peak_activity": 50, "emotional_spike": 44, "shared_joy": 38, "conflict_resolution": 36, "milestone": 22}


def mood_turns(sentiment: DataFrame) -> DataFrame:
    """Energy jumps of 30 or more on inner days, and turns from negative to positive."""
    w = Window.partitionBy("room_id").orderBy("day")
    d = sentiment.select(
        "*", F.lag("energy").over(w).alias("_e"), F.lag("negative").over(w).alias("_n"), F.lag("positive").over(w).alias("_p"),
        F.lead("day").over(w).alias("_next"), F.count("*").over(Window.partitionBy("room_id")).alias("_days"),
    ).filter((F.col("_days") >= 3) & F.col("_e").isNotNull())
    inner = F.col("_next").isNotNull()
    step = F.col("energy") - F.col("_e")
    turn = (F.col("_n") > 40) & (F.col("negative") < 20) & (F.col("positive") > F.col("_p") + 20)
    kinds = F.array_compact(F.array(
        F.when(inner & (step >= 30), F.struct(F.lit("emotional_spike").alias("type"), F.lit("high").alias("title"))),
        F.when(inner & (step <= -30), F.struct(F.lit("emotional_spike").alias("type"), F.lit("low").alias("title"))),
        F.when(turn, F.struct(F.lit("conflict_resolution").alias("type"), F.lit("settled").alias("title"))),
    ))
    return d.select(*DAY, F.explode(kinds).alias("m")).select(*DAY, "m.type", "m.title", F.lit(0).cast("bigint").alias("messages"))


def moments(days: DataFrame, sentiment: DataFrame, reached: DataFrame, ends: DataFrame, topics: DataFrame) -> DataFrame:
    """Memorable days: two per type, eight in all, by type weight, keywords and volume.

    ``ends``(room_id, first_ts, last_ts) are the first and last row of the room.
    """
    room = Window.partitionBy("room_id")
    d = days.withColumn("_avg", F.avg("messages").over(room)).withColumn("_n", F.count("*").over(room)).withColumn(
        "_r", F.row_number().over(room.orderBy(F.desc("messages"), F.asc("day")))
    )
    make = lambda rows, kind, title, n: rows.select(
        "room_id", "day", F.lit(kind).alias("type"), title.alias("title"), n.cast("bigint").alias("messages")
    )
    all_ = make(d.filter(F.col("messages") >= F.col("_avg") * 2), "peak_activity", F.lit("peak"), F.col("messages"))
    joy = d.filter(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1)))
    first = ends.select("room_id", F.to_date("first_ts").alias("day"))
    last = ends.select("room_id", F.to_date("last_ts").alias("day"))
    for rows in (
        make(joy, "shared_joy", F.lit("busy_day"), F.col("messages")),
        make(first, "milestone", F.lit("first"), F.lit(1)),
        make(last, "milestone", F.lit("last"), F.lit(1)),
        make(reached, "milestone", F.concat(F.lit("message "), F.col("milestone").cast("string")), F.col("milestone")),
        mood_turns(sentiment),
    ):
        all_ = all_.unionByName(rows)
    all_ = all_.dropDuplicates(["room_id", "day", "type", "title"]).join(
        topics.select(*DAY, "keywords"), DAY, "left"
    )
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(float(v))) for k, v in MOMENT_WEIGHT.items()])
    bonus = F.when(F.coalesce("keywords", F.lit("")) != "", 12.0).otherwise(0.0)
    score = half_up(weight + bonus + F.log10(F.greatest(F.col("messages"), F.lit(1))), 6)
    all_ = all_.withColumn("score", score)
    order = [F.desc("score"), F.asc("day"), F.asc("title")]
    two = top_k(all_, ["room_id", "type"], order, 2, "_t")
    return top_k(two, ROOM, [F.desc("score"), F.asc("day"), F.asc("type"), F.asc("title")], 8).drop("_t")


# ---- facts --------------------------------------------------------------------------------

def _facts(d: DataFrame, rules, k: int) -> DataFrame:
    """rules: (fact, gate, value, label); the first k facts whose gate holds."""
    text = lambda c: c.cast("string") if c is not None else F.lit(None).cast("string")
    num = lambda c: c.cast("double") if c is not None else F.lit(None).cast("double")
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(gate, F.lit(False)), F.struct(F.lit(name).alias("fact"), num(value).alias("value"), text(label).alias("label")))
        for name, gate, value, label in rules
    ]))
    return d.select("room_id", F.posexplode(F.slice(found, 1, k)).alias("_i", "_f")).select(
        "room_id", (F.col("_i") + 1).alias("place"), "_f.*"
    )


def highlights(room: DataFrame, k: int = 14) -> DataFrame:
    """First k of about two dozen gated facts; ``room`` is the wide row of report.room_row."""
    c = F.col
    ratio = half_up(c("tail_messages") / c("head_messages"), 2)
    system = c("join") + c("leave") + c("deleted") + c("hidden") + c("kick")
    return _facts(room, (
        ("top_speaker", c("top_sender").isNotNull() & (c("total_messages") > 0), c("top_share"), c("top_sender")),
        ("busiest_weekday", c("busiest_weekday").isNotNull(), c("busiest_weekday"), None),
        ("peak_hour", c("peak_hour").isNotNull(), c("peak_hour"), None),
        ("median_gap_minutes", c("median_minutes").isNotNull(), c("median_minutes"), None),
        ("night_percent", c("night_percent") > 0, c("night_percent"), None),
        ("longest_streak", c("longest_streak") > 1, c("longest_streak"), None),
        ("emoji_messages", c("emoji_messages") > 0, c("emoji_messages"), None),
        ("attachment_messages", c("attachment_messages") > 0, c("attachment_messages"), None),
        ("weekend_percent", c("weekend_percent") > 0, c("weekend_percent"), None),
        ("gini", c("gini") >= 0.35, c("gini"), None),
        ("gap_p90_minutes", c("p90_minutes") >= 30, c("p90_minutes"), None),
        ("max_silence", c("max_silence") >= 7, c("max_silence"), None),
        ("rhythm", c("rhythm") >= 65, c("rhythm"), None),
        ("gaps_under_1m_percent", c("under_1m_percent") >= 40, c("under_1m_percent"), None),
        ("monologue_percent", c("monologue_percent") >= 25, c("monologue_percent"), None),
        ("system_notices", system > 0, system, None),
        ("pure_laugh_messages", c("pure_laugh_messages") > 0, c("pure_laugh_messages"), None),
        ("repeated_phrase", c("phrase_count") >= 10, c("phrase_count"), None),
        ("burst_days", c("burst_days") > 0, c("burst_days"), c("top_burst_day")),
        ("tail_vs_head", (c("head_messages") > 0) & (c("tail_messages") > 0) & ((ratio >= 1.25) | (ratio <= 0.8)), ratio, None),
        ("lexical_richness", c("richness_percent") >= 18, c("richness_percent"), None),
        ("pace", c("pace").isNotNull(), None, c("pace")),
        ("peak_hidden_day", c("peak_hidden") >= 5, c("peak_hidden"), c("peak_hidden_day")),
        ("peak_join_day", c("peak_join") >= 20, c("peak_join"), c("peak_join_day")),
    ), k)


def wrapped_cards(room: DataFrame, k: int = 8) -> DataFrame:
    """Summary cards in fixed order, each with its headline statistic."""
    c = F.col
    ratio = half_up(c("tail_messages") / c("head_messages") * 100.0)
    span = F.date_diff(F.to_date("last_ts"), F.to_date("first_ts")) + 1
    pace = F.when(c("under_1m_percent") >= 35, c("under_1m_percent")).otherwise(c("switches_per_100"))
    yes = F.lit(True)
    return _facts(room, (
        ("intro", yes, c("total_messages"), None),
        ("span_days", c("first_ts").isNotNull(), span, None),
        ("streak", c("longest_streak") >= 2, c("longest_streak"), None),
        ("peak_hour", c("peak_hour").isNotNull(), c("peak_hour"), None),
        ("main_speaker", c("top_sender").isNotNull(), c("top_share"), c("top_sender")),
        ("rhythm", yes, c("rhythm"), None),
        ("weekend", c("weekend_percent") >= 15, c("weekend_percent"), None),
        ("mood", (c("laugh_per_100") >= 5) | (c("emoji_per_100") >= 3), c("laugh_per_100"), None),
        ("pace", yes, pace, c("pace")),
        ("burst", c("burst_days") > 0, c("top_burst"), c("top_burst_day")),
        ("arc", (c("head_messages") > 0) & (c("tail_messages") > 0), ratio, None),
        ("moderation", c("peak_moderation") >= 3, c("peak_moderation"), c("peak_moderation_day")),
    ), k)


def narrative(room: DataFrame, topics: DataFrame, people: DataFrame, events: DataFrame) -> DataFrame:
    """Up to five facts for a room description, with the first topic and persona."""
    first = topics.groupBy("room_id").agg(F.min_by("title", "place").alias("_topic"), F.min_by("percent", "place").alias("_topic_percent"))
    persona = people.groupBy("room_id").agg(F.min_by(F.concat_ws(":", "sender", "persona"), "rank").alias("_persona"))
    bursts = events.filter("kind = 'burst'").groupBy("room_id").agg(F.count("*").alias("_bursts"), F.min("day").alias("_burst_day"))
    d = room.join(first, ROOM, "left").join(persona, ROOM, "left").join(bursts, ROOM, "left")
    c = F.col
    return _facts(d, (
        ("overview", F.lit(True), c("total_messages"), c("pace")),
        ("few_voices", c("gini") >= 0.65, c("top3_percent"), c("top_pair")),
        ("many_voices", c("gini") < 0.45, c("switches_per_100"), None),
        ("topic", c("_topic").isNotNull(), c("_topic_percent"), c("_topic")),
        ("persona", c("_persona").isNotNull(), None, c("_persona")),
        ("bursts", c("_bursts") > 0, c("_bursts"), c("_burst_day")),
    ), 5)


def section_gates(room: DataFrame, events: DataFrame) -> DataFrame:
    """Which report sections have enough data."""
    n = events.groupBy("room_id").agg(F.count("*").alias("_n"))
    return room.join(n, ROOM, "left").select(
        "room_id", (F.coalesce("_n", F.lit(0)) > 0).alias("timeline"),
        (F.coalesce("visible_replies", F.lit(0)) >= 3).alias("replies"), (F.col("active_days") >= 3).alias("explorer"),
        (F.col("active_days") > 0).alias("calendar"), (F.col("months") >= 6).alias("monthly_chart"),
    )


def participant_map(top: DataFrame) -> DataFrame:
    """Plot positions of the twelve most active participants."""
    d = top.filter(F.col("rank") <= 12)
    w = Window.partitionBy("room_id")
    share = F.greatest(F.max("share_percent").over(w), F.lit(0.1))
    longest = F.greatest(F.max("average_length").over(w), F.lit(1.0))
    shortest = F.min("average_length").over(w)
    span = F.greatest(longest - shortest, F.lit(0.1))
    most = F.greatest(F.max("messages").over(w), F.lit(1))
    return d.select(
        "room_id", "sender", "rank",
        half_up(14 + F.col("share_percent") / share * 72, 4).alias("x"),
        half_up(16 + (1 - (F.col("average_length") - shortest) / span) * 68, 4).alias("y"),
        half_up(0.72 + F.col("messages") / most * 0.45, 2).alias("scale"),
    )


# ---- evidence for generated texts ------------------------------------------------------------

def evidence_pool(keywords: DataFrame, topics: DataFrame, hot: DataFrame) -> DataFrame:
    """Terms a generated text may cite: 80 keywords, 12 topics, 10 hot days per room."""
    terms = keywords.filter("rank <= 80").select("room_id", F.col("label").alias("term"))
    cards = topics.filter("place <= 12")
    for d in (
        cards.select("room_id", F.col("title").alias("term")),
        cards.select("room_id", F.explode(F.slice("terms", 1, 8)).alias("term")),
        hot.select("room_id", F.explode(F.split("keywords", " ")).alias("term")),
    ):
        terms = terms.unionByName(d)
    norm = F.lower(text_fn.squeeze(text_fn.trim_all(F.col("term"))))
    terms = terms.select("room_id", norm.alias("term")).filter(F.length("term") >= 2)
    return terms.groupBy("room_id").agg(F.collect_set("term").alias("pool"))


def stat_tokens(room: DataFrame) -> DataFrame:
    """Number words of the room's statistics, as a text may quote them."""
    shown = []
    for name in ("total_messages", "participants", "active_days", "rhythm", "top3_percent", "weekend_percent", "peak_hour"):
        v = F.col(name).cast("double")
        whole = v == F.floor(v)
        shown += [
            F.when(whole, v.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", v)),
            half_up(v).cast("bigint").cast("string"),
        ]
    return room.select("room_id", "total_messages", F.array_distinct(F.array_compact(F.array(*shown))).alias("stats"))


def is_garbage(text: Column) -> Column:
    """Left-overs of templates, error messages, bare numbers."""
    t = text_fn.trim_all(text)
    lowered = F.lower(t)
    return (
        (F.length(t) < 4) | t.rlike(r"[\]}{]") | lowered.rlike("|".join([*lex.FAILED_ANSWER, *lex.TEMPLATE_REST])) | t.rlike(r"^[\d\s,%.]+$") | ~t.rlike(r"\p{L}")
        | t.rlike(r"^```|^\[") | lowered.isin(*[f.lower() for f in lex.ANSWER_FIELDS])
    )


def evidence_gate(texts: DataFrame, pool: DataFrame, stats: DataFrame, shown: int = 180, matched: int | None = None) -> DataFrame:
    """texts(room_id, item, text): keep what names a known term or statistic of its room.

    Whole texts are tested (``matched``: their first characters only); ``shown`` characters are handed on.

    Pool and statistics are short lists, one row per room, so each text is tested in
    place after a join on the room.
    """
    d = texts.join(stats, ROOM, "left").join(pool, ROOM, "left")
    trimmed = text_fn.trim_all(F.col("text"))
    whole = trimmed if matched is None else F.substring(trimmed, 1, matched)
    # a column of its own: inside a lambda it would be made again for every term of the pool
    d = once(d, "_norm", F.lower(text_fn.squeeze(whole)))
    norm = F.col("_norm")
    names = F.exists("pool", lambda t: F.contains(norm, t))
    numbers = F.exists(
        F.regexp_extract_all(norm, F.lit(r"\d+(?:\.\d+)?"), 0),
        lambda n: F.array_contains("stats", n) | F.array_contains("stats", F.element_at(F.split(n, r"\."), 1)),
    )
    tiny = (F.col("total_messages") < 100) & F.col("pool").isNull()
    good = ~is_garbage(whole) & (F.coalesce(names, F.lit(False)) | F.coalesce(numbers, F.lit(False)) | F.coalesce(tiny, F.lit(False)))
    # two steps: inside a lambda, ``text`` would be taken for the shortened column of the same name
    tested = d.withColumn("accepted", good)
    return tested.select("room_id", "item", F.substring(trimmed, 1, shown).alias("text"), "accepted")


def archetype_fallback(topics: DataFrame, keywords: DataFrame, k: int = 4) -> DataFrame:
    """Room name parts when no generated name passed: the first distinct evidence terms."""
    t = topics.filter("place <= 12").select("room_id", (F.col("place") * 10).alias("o"), F.posexplode(F.slice("terms", 1, 3)).alias("i", "term"))
    w = keywords.filter(F.col("rank") <= 2 * k).select("room_id", (F.col("rank") + 1000).alias("o"), F.lit(0).alias("i"), F.col("label").alias("term"))
    d = t.unionByName(w).groupBy("room_id", F.lower("term").alias("term")).agg(F.min(F.col("o") + F.col("i")).alias("o"))
    d = top_k(d, ROOM, [F.asc("o"), F.asc("term")], k).groupBy("room_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms")
    )
    return d.filter(F.size("terms") >= 2).select("room_id", F.concat_ws("·", F.slice("terms", 1, 2)).alias("name"), F.slice("terms", 1, 3).alias("traits"))


def merge_texts(base: DataFrame, accepted: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Accepted texts replace the rule-based ones."""
    new = accepted.select(*keys, F.col(column).alias("_new"))
    return base.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def evidence_payload(room: DataFrame, keywords: DataFrame, topics: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text per room with aggregates only: no message, no real name."""
    listed = lambda d, key, item, k: d.filter(F.col(key) <= k).groupBy("room_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, item.alias("t")))), lambda s: s["t"]), ", ").alias("_t")
    )
    kw = listed(keywords, "rank", F.concat("label", F.lit("("), F.col("count").cast("string"), F.lit(")")), 25).withColumnRenamed("_t", "_kw")
    tp = listed(topics, "place", F.concat("title", F.lit(" ["), F.concat_ws(" ", F.slice("terms", 1, 5)), F.lit("]")), 12).withColumnRenamed("_t", "_tp")
    pr = listed(pairs, "rank", F.concat("source", F.lit("→"), "target", F.lit("("), F.col("replies").cast("string"), F.lit(")")), 6).withColumnRenamed("_t", "_pr")
    d = room.join(kw, ROOM, "left").join(tp, ROOM, "left").join(pr, ROOM, "left")
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string")))
    return d.select("room_id", F.concat_ws(
        "\n", line("messages", F.col("total_messages")), line("participants", F.col("participants")), line("pace", F.col("pace")),
        line("rhythm", F.col("rhythm")), line("gini", F.col("gini")), line("top3_percent", F.col("top3_percent")),
        line("keywords", F.col("_kw")), line("topics", F.col("_tp")), line("pairs", F.col("_pr")), line("bursts", F.col("burst_days")),
    ).alias("payload"))
