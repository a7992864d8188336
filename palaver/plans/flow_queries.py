"""Registered queries: gaps, sessions, runs, replies."""

from __future__ import annotations

from palaver.operators import activity as act
from palaver.operators import flow as fl
from palaver.plans.registry import pct_sql, query, round_sql
from palaver.sources import tables as src

EV = f"with m as ({src.event_messages_sql()})"
EV1 = f"with m as ({src.event_messages_sql(False)})"
CONV = f"with m as ({src.CONVERSATIONS_SQL})"
LINK = """, x as (select *, lag(sender) over w as ps, floor((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000) as gap from m window w as (partition by room_id order by line))"""
GAPS = LINK + ", g as (select room_id, line, cast(gap as bigint) as gap_ms from x where gap > 0 and gap <= 604800000)"
# small chunks in the registered queries, so that the carry between chunks is exercised
CHUNK = 1000


def _flow(spark, folder, by_type=True, chunk=CHUNK):
    return fl.conversation_flow(src.event_messages(spark, folder, by_type), chunk)


def _conv_flow(spark, folder):
    return fl.conversation_flow(src.conversation_messages(spark, folder))


@query("gaps", EV1 + GAPS + " select * from g")
def gaps(spark, folder):
    return fl.gaps(_flow(spark, folder, False))


@query("gap_quantiles", EV + GAPS + f", r as (select *, row_number() over (partition by room_id order by gap_ms) - 1 as i, count(*) over (partition by room_id) as n from g) select room_id, max(n) as gaps, {round_sql('max(gap_ms) filter (where i = least(n - 1, cast(floor(n * 0.5) as bigint))) / 60000.0', 1)} as median_minutes, {round_sql('max(gap_ms) filter (where i = least(n - 1, cast(floor(n * 0.9) as bigint))) / 60000.0', 1)} as p90_minutes from r group by 1")
def gap_quantiles(spark, folder):
    return fl.gap_quantiles(fl.gaps(_flow(spark, folder)))


HIST = GAPS + ", h as (select room_id, cast(least(63, floor((ln(greatest(1000, gap_ms)) - ln(1000)) / (ln(604800000) - ln(1000)) * 64)) as int) as bin, count(*) as gaps from g group by 1, 2)"


@query("gap_hist64", EV + HIST + " select * from h")
def gap_hist64(spark, folder):
    return fl.gap_histogram(fl.gaps(_flow(spark, folder)))


@query("gap_hist_quantiles", EV + HIST + f", a as (select *, sum(gaps) over (partition by room_id order by bin) as acc, sum(gaps) over (partition by room_id) as n, exp(ln(1000) + (bin + 0.5) / 64 * (ln(604800000) - ln(1000))) as c from h) select room_id, {round_sql('min(c) filter (where acc >= n * 0.5) / 60000.0', 1)} as median_minutes, {round_sql('min(c) filter (where acc >= n * 0.9) / 60000.0', 1)} as p90_minutes from a group by 1")
def gap_hist_quantiles(spark, folder):
    return fl.histogram_quantiles(fl.gap_histogram(fl.gaps(_flow(spark, folder))))


@query("gap_profile", EV + GAPS + f" select room_id, count(*) as gaps, {round_sql('stddev_samp(gap_ms) / avg(gap_ms)', 2)} as gap_cv, {pct_sql('count(*) filter (where gap_ms < 60000)', 'count(*)')} as under_1m_percent, {pct_sql('count(*) filter (where gap_ms > 3600000)', 'count(*)')} as over_60m_percent from g group by 1")
def gap_profile(spark, folder):
    return fl.gap_profile(fl.gaps(_flow(spark, folder)))


SESS = LINK + ", y as (select *, sum(case when gap is null or gap > 1800000 then 1 else 0 end) over (partition by room_id order by line rows unbounded preceding) as session_id from x), s as (select room_id, cast(session_id as bigint) as session_id, count(*) as messages, arg_min(epoch_us(ts), line) as start_us, arg_max(epoch_us(ts), line) as end_us from y group by 1, 2)"


@query("sessions", EV + SESS + " select * from s")
def sessions(spark, folder):
    return fl.sessions(_flow(spark, folder))


@query("session_stats", EV + SESS + f" select room_id, count(*) as sessions, {round_sql('avg(messages)', 1)} as avg_messages, {round_sql('median(floor((end_us - start_us) / 1000)) / 60000.0', 1)} as median_minutes from s group by 1")
def session_stats(spark, folder):
    return fl.session_stats(fl.sessions(_flow(spark, folder)))


@query("switches", CONV + LINK + " select room_id, count(*) as messages, count(*) filter (where ps <> sender) as switches from x group by 1")
def switches(spark, folder):
    return fl.switches(_conv_flow(spark, folder))


EDGES = LINK + ", e as (select room_id, ps as source, sender as target, count(*) as replies from x where ps <> sender group by 1, 2, 3)"
MEMBERS = ", p as (select room_id, sender, count(*) as messages from m group by 1, 2), mm as (select *, row_number() over (partition by room_id order by messages desc, sender) as rank from p qualify rank <= 12)"
VIS = ", v as (select e.* from e join mm a on a.room_id = e.room_id and a.sender = source join mm b on b.room_id = e.room_id and b.sender = target)"


@query("reply_edges", EV + EDGES + " select * from e")
def reply_edges(spark, folder):
    return fl.reply_edges(_flow(spark, folder))


def _graph(spark, folder):
    messages = src.event_messages(spark, folder)
    people = act.participants(act.plain_sender_day(messages), flags=False)
    return fl.reply_edges(fl.conversation_flow(messages, CHUNK)), fl.matrix_members(people)


@query("reply_matrix", EV + EDGES + MEMBERS + " select a.room_id, cast(a.rank as int) as source_rank, a.sender as source, cast(b.rank as int) as target_rank, b.sender as target, coalesce(replies, 0) as replies from mm a join mm b on a.room_id = b.room_id left join e on e.room_id = a.room_id and e.source = a.sender and e.target = b.sender")
def reply_matrix(spark, folder):
    return fl.reply_matrix(*_graph(spark, folder))


@query("top_pairs", EV + EDGES + MEMBERS + VIS + " select *, row_number() over (partition by room_id order by replies desc, source, target) as rank from v qualify rank <= 8")
def top_pairs(spark, folder):
    return fl.top_pairs(*_graph(spark, folder))


@query("network_view", EV + EDGES + MEMBERS + VIS + ", th as (select room_id, cast(greatest(2, least(10, floor(max(replies) * 0.02))) as bigint) as threshold from v group by 1) select v.room_id, source, target, replies, threshold, row_number() over (partition by v.room_id order by replies desc, source, target) as rank from v join th using (room_id) where replies >= threshold qualify rank <= 60")
def network_view(spark, folder):
    return fl.interaction_view(*_graph(spark, folder))


@query("network_nodes", EV + EDGES + MEMBERS + VIS + ", n as (select room_id, source as sender, replies from v union all select room_id, target, replies from v), t as (select room_id, sender, cast(sum(replies) as bigint) as replies from n group by 1, 2) select *, row_number() over (partition by room_id order by replies desc, sender) as rank from t qualify rank <= 15")
def network_nodes(spark, folder):
    return fl.interaction_nodes(*_graph(spark, folder))


RUNS = LINK + ", y as (select *, sum(case when ps is null or ps <> sender then 1 else 0 end) over (partition by room_id order by line rows unbounded preceding) as run_id from x), r as (select room_id, cast(run_id as bigint) as run_id, sender, count(*) as length from y group by 1, 2, 3)"


@query("runs", EV + RUNS + " select * from r")
def runs(spark, folder):
    return fl.runs(_flow(spark, folder))


@query("max_consecutive", CONV + RUNS + " select room_id, sender, max(length) as max_consecutive from r group by 1, 2")
def max_consecutive(spark, folder):
    return fl.longest_runs(_conv_flow(spark, folder))


@query("monologue", EV + RUNS + " select room_id, cast(sum(length) as bigint) as messages, cast(sum(greatest(length - 2, 0)) as bigint) as monologue_messages from r group by 1")
def monologue(spark, folder):
    return fl.monologue(_flow(spark, folder))


@query("flow_rates", EV + RUNS + f", a as (select room_id, count(*) as t, count(*) filter (where ps <> sender) as sw from x group by 1), b as (select room_id, sum(greatest(length - 2, 0)) as mo from r group by 1) select room_id, {pct_sql('sw', 't', 2)} as switches_per_100, {pct_sql('mo', 't')} as monologue_percent from a join b using (room_id)")
def flow_rates(spark, folder):
    messages = src.event_messages(spark, folder)
    totals = act.room_summary(act.plain_sender_day(messages)).select("room_id", "total_messages")
    return fl.flow_summary(fl.conversation_flow(messages, CHUNK), totals)


@query("compare_rooms", EV + RUNS + f""", a as (select room_id, count(*) as total_messages, count(distinct sender) as participants, count(distinct cast(ts as date)) as active_days, {pct_sql('count(*) filter (where ps <> sender)', 'count(*)', 2)} as switches_per_100, {pct_sql('count(*) filter (where hour(ts) in (23,0,1,2,3,4,5))', 'count(*)')} as night_percent from x group by 1) select * from a""")
def compare_rooms(spark, folder):
    messages = src.event_messages(spark, folder)
    summary = act.room_summary(act.plain_sender_day(messages))
    rates = fl.flow_summary(fl.conversation_flow(messages), summary.select("room_id", "total_messages"))
    return summary.join(rates, "room_id").select(
        "room_id", "total_messages", "participants", "active_days", "switches_per_100", "night_percent"
    )
