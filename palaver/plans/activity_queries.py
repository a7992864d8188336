"""Registered queries: activity, participants, series, inequality."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import activity as act
from palaver.operators import inequality as ineq
from palaver.operators import series as ser
from palaver.plans.registry import pct_sql, query, round_sql
from palaver.sources import tables as src

EV = f"with m as ({src.event_messages_sql()})"
EV1 = f"with m as ({src.event_messages_sql(False)})"
CONV = f"with m as ({src.CONVERSATIONS_SQL})"
ORD = f"with d as ({src.ORDER_DAYS_SQL})"
EVD = EV + ", d as (select room_id, cast(ts as date) as day, count(*) as messages from m group by 1, 2)"
NIGHT = "hour(ts) in (23, 0, 1, 2, 3, 4, 5)"
PEOPLE = (
    ", t as (select room_id, count(*) as total, sum(length(message)) as chars from m group by 1)"
    ", p as (select room_id, sender, count(*) as messages, cast(sum(length(message)) as bigint) as characters, "
    f"count(*) filter (where {NIGHT}) as night_messages, min(line) as first_line from m group by 1, 2)"
    ", s as (select p.room_id, sender, first_line, messages, characters, night_messages, "
    f"{round_sql('characters / messages', 1)} as average_length, "
    f"{pct_sql('messages', 'total')} as share_percent, {pct_sql('characters', 'chars')} as character_share_percent "
    "from p join t using (room_id))"
)


def _cells(spark, folder, by_type=True):
    return act.plain_sender_day(src.event_messages(spark, folder, by_type))


def _conv_cells(spark, folder):
    return act.plain_sender_day(src.conversation_messages(spark, folder))


@query("participants", EV + PEOPLE + "select *, row_number() over (partition by room_id order by messages desc, first_line) as rank from s qualify rank <= 30")
def participants(spark, folder):
    return act.top_participants(act.participants(_cells(spark, folder), flags=False), 30)


@query("participants_by_chars", CONV + PEOPLE + "select *, row_number() over (partition by room_id order by characters desc, messages desc, first_line) as rank from s qualify rank <= 30")
def participants_by_chars(spark, folder):
    return act.top_participants(act.participants(_conv_cells(spark, folder), flags=False), 30, by="characters")


MASK = (
    "case when length(sender) = 0 then '?' when length(sender) <= 2 then substr(sender, 1, 1) || '*' "
    "else substr(sender, 1, 1) || repeat('*', greatest(1, least(length(sender) - 2, 6))) || right(sender, 1) end"
)
FIRST = ", f as (select room_id, sender, min(line) as first_line from m group by 1, 2)"


@query("aliases_masked", EV + FIRST + f", k as (select *, {MASK} as mask from f), r as (select *, row_number() over (partition by room_id, mask order by first_line) as n from k) select room_id, sender, first_line, case when n = 1 then mask else mask || '·' || n end as alias from r")
def aliases_masked(spark, folder):
    return act.aliases(act.participants(_cells(spark, folder), flags=False))


@query("aliases_anonymous", EV1 + FIRST + ", r as (select *, row_number() over (partition by room_id order by first_line) as n from f) select room_id, sender, first_line, 'User ' || lpad(cast(n as varchar), cast(greatest(3, length(cast(n as varchar))) as int), '0') as alias from r")
def aliases_anonymous(spark, folder):
    return act.aliases(act.participants(_cells(spark, folder, False), flags=False), "anonymous")


@query("daily", EVD + "select * from d")
def daily(spark, folder):
    return act.daily(act.hour_counts(src.event_messages(spark, folder)))


@query("daily_since", EV + "select room_id, cast(ts as date) as day, count(*) as messages from m where ts >= timestamp '2024-01-15' group by 1, 2")
def daily_since(spark, folder):
    from palaver.operators.features import since

    return act.daily(act.hour_counts(since(src.event_messages(spark, folder), "2024-01-15")))


@query("daily_range_totals", EVD + "select room_id, cast(sum(messages) as bigint) as messages, count(*) filter (where messages > 0) as active_days from d where day between date '2024-01-05' and date '2024-01-20' group by 1")
def daily_range_totals(spark, folder):
    return act.range_totals(act.daily(act.hour_counts(src.event_messages(spark, folder))), "2024-01-20", "2024-01-05")


@query("monthly", ORD + "select room_id, strftime(day, '%Y-%m') as month, cast(sum(messages) as bigint) as messages from d group by 1, 2")
def monthly(spark, folder):
    return act.monthly(src.order_days(spark, folder))


@query("hourly", CONV + ", c as (select room_id, hour(ts) as hour, count(*) as messages from m group by 1, 2), r as (select distinct room_id from m) select r.room_id, cast(h.hour as int) as hour, coalesce(c.messages, 0) as messages from r, range(24) h(hour) left join c on c.room_id = r.room_id and c.hour = h.hour")
def hourly(spark, folder):
    return act.hourly(act.hour_counts(src.conversation_messages(spark, folder)))


@query("weekday", EV + ", c as (select room_id, dayofweek(ts) as weekday, count(*) as messages from m group by 1, 2), r as (select distinct room_id from m) select r.room_id, cast(h.w as int) as weekday, coalesce(c.messages, 0) as messages from r, range(7) h(w) left join c on c.room_id = r.room_id and c.weekday = h.w")
def weekday(spark, folder):
    return act.weekdays(act.hour_counts(src.event_messages(spark, folder)))


@query("time_profile", EV + " select room_id, 'day' as grain, cast(cast(ts as date) as varchar) as bucket, count(*) as messages from m group by 1, 3 union all select room_id, 'month', strftime(ts, '%Y-%m'), count(*) from m group by 1, 3 union all select room_id, 'hour', cast(hour(ts) as varchar), count(*) from m group by 1, 3 union all select room_id, 'weekday', cast(dayofweek(ts) as varchar), count(*) from m group by 1, 3")
def time_profile(spark, folder):
    return act.time_profile(act.hour_counts(src.event_messages(spark, folder)))


@query("peaks", EV + ", h as (select room_id, hour(ts) as hour, count(*) as c from m group by 1, 2), w as (select room_id, dayofweek(ts) as weekday, count(*) as c from m group by 1, 2) select a.room_id, cast(a.peak_hour as int) as peak_hour, a.active_hours, cast(b.busiest_weekday as int) as busiest_weekday from (select room_id, arg_max(hour, c * 100 - hour) as peak_hour, count(*) as active_hours from h group by 1) a join (select room_id, arg_max(weekday, c * 100 - weekday) as busiest_weekday from w group by 1) b using (room_id)")
def peaks(spark, folder):
    return act.peaks(act.hour_counts(src.event_messages(spark, folder)))


@query("dayparts", EV + f", b as (select room_id, cast(hour(ts) // 6 as int) as band, count(*) as c from m group by 1, 2), p as (select *, {pct_sql('c', 'sum(c) over (partition by room_id)')} as p from b), q as (select *, 100.0 - sum(p) over (partition by room_id) as drift, row_number() over (partition by room_id order by p desc, band desc) as rn from p) select room_id, band, ['dawn', 'morning', 'afternoon', 'evening'][band + 1] as daypart, case when rn = 1 and abs(drift) >= 0.05 then {round_sql('p + drift', 1)} else p end as percent from q")
def dayparts(spark, folder):
    return act.dayparts(act.hour_counts(src.event_messages(spark, folder)))


@query("room_summary", EV + f"""
, c as (select room_id, count(*) as total, count(distinct sender) as participants, count(distinct cast(ts as date)) as days,
  arg_min(ts, line) as first_ts, arg_max(ts, line) as last_ts, sum(length(message)) as chars,
  count(*) filter (where {NIGHT}) as night, count(*) filter (where dayofweek(ts) in (0, 6)) as weekend,
  min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day from m group by 1)
, pk as (select room_id, max(n) as pk from (select room_id, cast(ts as date) as d, count(*) as n from m group by 1, 2) group by 1)
select room_id, total as total_messages, participants, days as active_days, first_ts, last_ts, first_day, last_day,
 {round_sql('chars / total', 1)} as average_length, {round_sql('total / days', 1)} as messages_per_active_day,
 {pct_sql('night', 'total')} as night_percent, {pct_sql('weekend', 'total')} as weekend_percent,
 {pct_sql('pk', 'total')} as peak_day_percent,
 {round_sql('total / greatest(1, floor((epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000.0) + 1)', 2)} as density_per_day
from c join pk using (room_id)""")
def room_summary(spark, folder):
    return act.room_summary(_cells(spark, folder))


@query("new_senders", EV + ", f as (select room_id, sender, arg_min(cast(ts as date), line) as day from m group by 1, 2) select room_id, day, count(*) as new_senders from f group by 1, 2")
def new_senders(spark, folder):
    return act.first_appearances(_cells(spark, folder))


@query("messages_per_day_sender", CONV + "select room_id, cast(ts as date) as day, sender, count(*) as messages from m group by 1, 2, 3")
def messages_per_day_sender(spark, folder):
    return act.sender_day_counts(_conv_cells(spark, folder))


@query("active_range", EV + "select room_id, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day from m group by 1")
def active_range(spark, folder):
    return act.daily(act.hour_counts(src.event_messages(spark, folder))).groupBy("room_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


# ---- day-level series --------------------------------------------------------------

@query("streak", ORD + ", i as (select room_id, day, day - cast(row_number() over (partition by room_id order by day) as int) as g from d) select room_id, max(n) as longest_streak from (select room_id, g, count(*) as n from i group by 1, 2) group by 1")
def streak(spark, folder):
    return ser.streaks(src.order_days(spark, folder))


SPARSE = "with d as (select cast(o_custkey % 50 as varchar) as room_id, cast(o_orderdate as date) as day, count(*) as messages from orders group by 1, 2)"


def _sparse_days(spark, folder):
    """Orders of 50 customer groups: daily series with gaps."""
    return src.table(spark, folder, "orders").groupBy(
        (F.col("o_custkey") % 50).cast("string").alias("room_id"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count("*").alias("messages"))


@query("silence", SPARSE + ", g as (select room_id, day, date_diff('day', lag(day) over (partition by room_id order by day), day) - 1 as gap from d), b as (select room_id, max(gap) as max_silence, count(*) as n from g group by 1), f as (select room_id, min(day) as day from g join b using (room_id) where gap = max_silence group by 1) select room_id, cast(max_silence as int) as max_silence, case when n >= 3 and max_silence >= 5 then day end as resume_day from b left join f using (room_id)")
def silence(spark, folder):
    return ser.silence(_sparse_days(spark, folder))


CHAPTER_SQL = f"""
, x as (select *, sum(case when gap > 7 then 1 else 0 end) over (partition by room_id order by day) + 1 as chapter
  from (select *, date_diff('day', lag(day) over (partition by room_id order by day), day) as gap from d))
, sp as (select room_id, chapter, min(day) as from_day, max(day) as to_day, count(*) as active_days, sum(messages) as messages from x group by 1, 2)
, sd as (select room_id, chapter, sender, sum(c) as c, row_number() over (partition by room_id, chapter order by sum(c) desc, sender) as rn from ds join x using (room_id, day) group by 1, 2, 3)
select room_id, cast(chapter as bigint) as chapter, from_day, to_day, active_days, cast(messages as bigint) as messages,
 {pct_sql('messages', 'sum(messages) over (partition by room_id)')} as share_percent, sender as top_sender,
 {pct_sql('c', 'messages')} as top_share_percent
from sp left join (select * from sd where rn = 1) using (room_id, chapter)"""


@query("chapters", "with ds as (select cast(o_custkey % 50 as varchar) as room_id, cast(o_orderdate as date) as day, cast(o_custkey as varchar) as sender, count(*) as c from orders group by 1, 2, 3), d as (select room_id, day, cast(sum(c) as bigint) as messages from ds group by 1, 2)" + CHAPTER_SQL)
def chapters(spark, folder):
    cells = src.table(spark, folder, "orders").groupBy(
        (F.col("o_custkey") % 50).cast("string").alias("room_id"), F.to_date("o_orderdate").alias("day"),
        F.col("o_custkey").cast("string").alias("sender"),
    ).agg(F.count("*").alias("messages"))
    return ser.chapters(act.daily(cells), cells)


ARC = f""", x as (select *, row_number() over (partition by room_id order by day) as a, count(*) over (partition by room_id) as n from d)
, u as (select room_id, 'whole' as segment, messages from x union all select room_id, 'head', messages from x where n >= 10 and a <= 7
 union all select room_id, 'tail', messages from x where n >= 10 and a > n - 7)
select room_id, segment, cast(sum(messages) as bigint) as messages, count(*) as active_days, {round_sql('sum(messages) / count(*)', 1)} as messages_per_active_day from u group by 1, 2"""


@query("activity_arc", EVD + ARC)
def activity_arc(spark, folder):
    return ser.activity_arc(act.daily(act.hour_counts(src.event_messages(spark, folder))))


@query("milestones", ORD + ", c as (select *, sum(messages) over (partition by room_id order by day) as hi from d) select room_id, day, cast(n as int) as milestone from c, (values (1000), (5000), (10000), (50000), (100000)) v(n) where n > hi - messages and n <= hi")
def milestones(spark, folder):
    return ser.milestones(src.order_days(spark, folder))


@query("month_peaks", ORD + "select room_id, strftime(day, '%Y-%m') as month, day, messages from d qualify row_number() over (partition by room_id, strftime(day, '%Y-%m') order by messages desc, day) = 1")
def month_peaks(spark, folder):
    return ser.month_peaks(src.order_days(spark, folder))


QUANT = """, k as (select *, row_number() over (partition by room_id order by messages, day) - 1 as i, count(*) over (partition by room_id) as n from d)
, q as (select room_id, max(n) as n, (max(messages) filter (where i = (n - 1) // 2) + max(messages) filter (where i = n // 2)) / 2.0 as med,
  max(messages) filter (where i = least(n - 1, cast(floor(n * 0.9) as bigint))) as p90 from k group by 1)"""
HOT = " select d.room_id, d.day, d.messages, cast(t as double) as threshold, row_number() over (partition by d.room_id order by d.messages desc, d.day) as rank from d join th using (room_id) where d.messages >= t qualify rank <= 8"
BURST = QUANT + """, sc as (select *, least(1.0, greatest(0.35, n / 120.0)) as s from q where n >= 4)
, th as (select room_id, greatest(ceil(cast(med as double) * (1.12 + 0.28 * s)), ceil(cast(p90 as double) * (0.86 + 0.1 * s)), med + greatest(2, floor(cast(med as double) * (0.1 + 0.08 * s)))) as t from sc)""" + HOT


@query("bursts_heuristic", ORD + BURST)
def bursts_heuristic(spark, folder):
    return ser.bursts(src.order_days(spark, folder))


@query("bursts_mad", ORD + QUANT + """, dv as (select room_id, med, abs(messages - med) as dev, row_number() over (partition by room_id order by abs(messages - med), day) - 1 as i, count(*) over (partition by room_id) as n from d join q using (room_id) where q.n >= 4)
, md as (select room_id, max(med) as med, (max(dev) filter (where i = (n - 1) // 2) + max(dev) filter (where i = n // 2)) / 2.0 as mad from dv group by 1)
, th as (select room_id, ceil(greatest(cast(med as double) + 3 * 1.4826 * cast(case when mad = 0 then 1 else mad end as double), med + 2)) as t from md)""" + HOT)
def bursts_mad(spark, folder):
    return ser.bursts(src.order_days(spark, folder), "mad")


LEVELS = """, k as (select *, row_number() over (partition by room_id order by messages, day) - 1 as i, count(*) over (partition by room_id) as n from d)
, th as (select room_id, list_distinct([max(messages) filter (where i = ceil(0.25 * n) - 1), max(messages) filter (where i = ceil(0.5 * n) - 1), max(messages) filter (where i = ceil(0.75 * n) - 1), max(messages)]) as ts from k group by 1)
, lv as (select room_id, day, messages, cast(greatest(1, least(4, len(list_filter(ts, lambda x: messages >= x)))) as int) as level from d join th using (room_id))"""


@query("contribution_levels", ORD + LEVELS + "select * from lv")
def contribution_levels(spark, folder):
    return ser.contribution_levels(src.order_days(spark, folder))


GRID = LEVELS + """, sp as (select room_id, min(day) - cast(dayofweek(min(day)) as int) as s0, max(day) - cast(dayofweek(max(day)) as int) + 6 as e from d group by 1)
, st as (select room_id, greatest(s0, e - 370) as s, e from sp)
, cells as (select room_id, s, s + cast(i as int) as day from st, range(371) r(i) where s + cast(i as int) <= e)
, grid as (select room_id, cast(cells.day as date) as day, cast(date_diff('day', s, cells.day) // 7 as int) as week, cast(dayofweek(cells.day) as int) as weekday, coalesce(messages, 0) as messages, coalesce(level, 0) as level from cells left join lv using (room_id, day))"""


@query("calendar_grid", ORD + GRID + "select * from grid")
def calendar_grid(spark, folder):
    return ser.calendar_grid(src.order_days(spark, folder))


@query("calendar_month_labels", ORD + GRID + ", w as (select room_id, week, cast(month(min(day)) as int) as month from grid group by 1, 2) select room_id, week, month from (select *, lag(month) over (partition by room_id order by week) as p from w) where p is null or p <> month")
def calendar_month_labels(spark, folder):
    return ser.month_labels(ser.calendar_grid(src.order_days(spark, folder)))


@query("heat_levels", EVD + "select room_id, day, messages, cast(case when r <= 0.15 then 0 when r <= 0.35 then 1 when r <= 0.55 then 2 when r <= 0.75 then 3 else 4 end as int) as heat from (select *, cast(messages as double) / max(messages) over (partition by room_id) as r from d)")
def heat_levels(spark, folder):
    return ser.heat_levels(act.daily(act.hour_counts(src.event_messages(spark, folder))))


@query("short_span", EVD + "select room_id, count(*) as active_days, count(distinct strftime(day, '%Y-%m')) as months, count(*) < 90 and count(distinct strftime(day, '%Y-%m')) <= 2 as short_span from d group by 1")
def short_span(spark, folder):
    return ser.short_span(act.daily(act.hour_counts(src.event_messages(spark, folder))))


@query("period_cut", EVD + "select room_id, day as cut_day from d qualify row_number() over (partition by room_id order by day) = count(*) over (partition by room_id) // 2 + 1 and count(*) over (partition by room_id) >= 14")
def period_cut(spark, folder):
    return ser.period_cut(act.daily(act.hour_counts(src.event_messages(spark, folder))))


# ---- inequality -----------------------------------------------------------------------

GINI = ", g as (select room_id, messages, row_number() over (partition by room_id order by messages) - 1 as i, count(*) over (partition by room_id) as n from p)" + f", gi as (select room_id, {round_sql('sum((2 * i - n + 1) * messages) / (max(n) * sum(messages))', 3)} as gini from g group by 1)"
P = ", p as (select room_id, sender, count(*) as messages from m group by 1, 2)"


@query("gini", EV + P + GINI + " select * from gi")
def gini(spark, folder):
    return ineq.gini(act.participants(_cells(spark, folder), flags=False))


def _totals(cells):
    return act.room_summary(cells).select("room_id", "total_messages")


@query("top3_share", EV + P + f", r as (select *, row_number() over (partition by room_id order by messages desc, sender) as rn, sum(messages) over (partition by room_id) as t from p) select room_id, {pct_sql('sum(messages)', 'max(t)')} as top3_percent from r where rn <= 3 group by 1")
def top3_share(spark, folder):
    cells = _cells(spark, folder)
    return ineq.top3_share(act.participants(cells, flags=False), _totals(cells))


@query("median_messages", EV + P + f"select room_id, {round_sql('median(messages)', 2)} as median_messages from p group by 1")
def median_messages(spark, folder):
    return ineq.median_messages(act.participants(_cells(spark, folder), flags=False))


RHYTHM = EVD + P + GINI + """, i as (select room_id, day - cast(row_number() over (partition by room_id order by day) as int) as g from d)
, st as (select room_id, max(n) as streak from (select room_id, g, count(*) as n from i group by 1, 2) group by 1)
, de as (select room_id, """ + round_sql("count(*) / greatest(1, floor((epoch_us(arg_max(ts, line)) - epoch_us(arg_min(ts, line))) / 86400000000.0) + 1)", 2) + """ as density,
 """ + pct_sql("count(*) filter (where " + NIGHT + ")", "count(*)") + """ as night, """ + pct_sql("count(*) filter (where dayofweek(ts) in (0, 6))", "count(*)") + """ as weekend from m group by 1)
, rh as (select room_id, gini, night, weekend, greatest(0.0, least(100.0, floor(48 * (1 - least(0.95, gini)) + 32 * least(1.0, streak / 28.0) + 20 * least(1.0, density / 40.0) + 0.5))) as rhythm from gi join st using (room_id) join de using (room_id))"""


def rhythm_frame(cells):
    summary = act.room_summary(cells).select(
        "room_id", "density_per_day", F.col("night_percent").alias("night"), F.col("weekend_percent").alias("weekend")
    )
    d = summary.join(ineq.gini(act.participants(cells, flags=False)), "room_id").join(
        ser.streaks(act.daily(cells)), "room_id"
    )
    return d.select(
        "room_id", "gini", "night", "weekend",
        ineq.rhythm_score(F.col("gini"), F.col("longest_streak"), F.col("density_per_day")).alias("rhythm"),
    )


@query("rhythm", RHYTHM + " select room_id, gini, night, weekend, cast(rhythm as double) as rhythm from rh")
def rhythm(spark, folder):
    return rhythm_frame(_cells(spark, folder))


@query("reference_bands", RHYTHM + """
, sw as (select room_id, """ + pct_sql("count(*) filter (where sender <> p)", "count(*)", 2) + """ as sw from (select *, lag(sender) over (partition by room_id order by line) as p from m) group by 1)
, v as (select room_id, 'gini' as metric, gini as value, [0.25, 0.38, 0.52, 0.65, 0.78, 0.88] as ref from rh union all select room_id, 'night', night, [8, 15, 22, 32, 42, 55] from rh
 union all select room_id, 'switch', sw, [28, 38, 48, 58, 68, 82] from sw union all select room_id, 'rhythm', rhythm, [32, 42, 52, 62, 72, 85] from rh union all select room_id, 'weekend', weekend, [18, 24, 30, 38, 46, 58] from rh)
, q as (select room_id, metric, cast(value as double) as value, cast(least(99, greatest(1, floor(len(list_filter(ref, lambda x: value >= x)) / 6.0 * 100 + 0.5))) as int) as percentile from v)
select *, case when percentile >= 85 then 'top' when percentile >= 60 then 'above' when percentile >= 40 then 'middle' when percentile >= 20 then 'below' else 'bottom' end as band from q""")
def reference_bands(spark, folder):
    from palaver.operators import flow

    messages = src.event_messages(spark, folder)
    cells = act.plain_sender_day(messages)
    rates = flow.flow_summary(flow.conversation_flow(messages), _totals(cells))
    metrics = rhythm_frame(cells).join(rates, "room_id").withColumnRenamed("switches_per_100", "switch")
    return ineq.reference_bands(metrics)
