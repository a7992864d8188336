"""Registered queries: insights, report documents, generated-text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import activity as act
from palaver.operators import flow as fl
from palaver.operators import insights as ins
from palaver.operators import series as ser
from palaver.plans.activity_queries import ARC, BURST, EV, GINI, HOT, PEOPLE
from palaver.plans.chat_queries import EVENTS, N, PEOPLE as CHAT_PEOPLE, PULSE
from palaver.plans.chat_sql import CHAT_F, TONE, squeeze_sql, trim_sql
from palaver.plans.registry import pct_sql, query, round_sql
from palaver.plans.report import Report
from palaver.plans.text_sql import CHAT_KW, CHAT_TK
from palaver.plans.topic_queries import SCORED
from palaver.sources import tables as src


def _report(spark, folder) -> Report:
    return Report(src.chat_messages(spark, folder))


DAYS = ", d as (select room_id, day, count(*) as messages from f group by 1, 2)"
BURSTS = BURST[: -len(HOT)] + f", bu as ({HOT})"


@query("participant_map", EV + PEOPLE + f""", tp as (select *, row_number() over (partition by room_id order by messages desc, first_line) as rank from s qualify rank <= 12)
, mx as (select room_id, greatest(max(share_percent), 0.1) as ms, greatest(max(average_length), 1) as ml, min(average_length) as nl, greatest(max(messages), 1) as mm from tp group by 1)
select room_id, sender, cast(rank as int) as rank, {round_sql('14 + share_percent / ms * 72', 4)} as x, {round_sql('16 + (1 - (average_length - nl) / greatest(ml - nl, 0.1)) * 68', 4)} as y, {round_sql('0.72 + messages / cast(mm as double) * 0.45', 2)} as scale from tp join mx using (room_id)""")
def participant_map(spark, folder):
    cells = act.plain_sender_day(src.event_messages(spark, folder))
    return ins.participant_map(act.top_participants(act.participants(cells, flags=False), 12))


USER = ", u as (select room_id, line, ts, sender, lag(sender) over w as ps, floor((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000) as gap from f where not is_system window w as (partition by room_id order by line))"
PACE = USER + DAYS + """, p as (select room_id, sender, count(*) filter (where not is_system) as messages from f group by 1, 2)""" + GINI + f"""
, gp as (select room_id, {pct_sql('count(*) filter (where gap < 60000)', 'count(*)')} as b, {pct_sql('count(*) filter (where gap > 3600000)', 'count(*)')} as sl from u where gap > 0 and gap <= 604800000 group by 1)
, sw as (select u.room_id, {pct_sql('count(*) filter (where ps <> sender)', 'max(total_messages)', 2)} as sw from u join tot using (room_id) group by 1)
, st as (select room_id, max(n) as streak from (select room_id, g, count(*) as n from (select room_id, day - cast(row_number() over (partition by room_id order by day) as int) as g from d) group by 1, 2) group by 1)
, de as (select room_id, {round_sql('count(*) / greatest(1, floor((epoch_us(arg_max(ts, line)) - epoch_us(arg_min(ts, line))) / 86400000000.0) + 1)', 2)} as density from f group by 1)
, rh as (select *, greatest(0.0, least(100.0, floor(48 * (1 - least(0.95, gini)) + 32 * least(1.0, streak / 28.0) + 20 * least(1.0, density / 40.0) + 0.5))) as rhythm from gi join gp using (room_id) join sw using (room_id) join st using (room_id) join de using (room_id))
, pc as (select room_id, gini, b as under_1m_percent, sl as over_60m_percent, sw as switches_per_100, cast(rhythm as double) as rhythm, case when b >= 65 and sw >= 55 then 'live_debate' when b >= 45 and sw >= 40 then 'fast_exchange' when sl >= 25 and b < 35 then 'asynchronous' when gini >= 0.75 then 'few_voices' when rhythm >= 62 then 'steady' else 'mixed' end as pace from rh)
"""


@query("pace", CHAT_F + PACE + "select * from pc")
def pace(spark, folder):
    return _report(spark, folder).room_row.select(
        "room_id", "gini", "under_1m_percent", "over_60m_percent", "switches_per_100", "rhythm", "pace"
    )


PHRASES = f", pz as (select room_id, day, {squeeze_sql(trim_sql('msg'))} as phrase from f where not is_system and not is_boilerplate and eligible), pd as (select room_id, phrase, day, count(*) as count from pz where length(phrase) between 12 and 180 group by 1, 2, 3), pa as (select room_id, phrase, sum(count) as count, arg_max(day, count * 100000 - date_diff('day', date '1970-01-01', day)) as day from pd group by 1, 2 having sum(count) >= 3), ph as (select *, row_number() over (partition by room_id order by count desc, phrase) as rank from pa)"

TIMELINE = PULSE + DAYS + BURSTS + PHRASES + """
, sl as (select room_id, day, date_diff('day', lag(day) over (partition by room_id order by day), day) - 1 as gap, count(*) over (partition by room_id) as n from d)
, lk as (select room_id, day, count(*) as v from f where not is_system and has_link group by 1, 2 having count(*) >= 3)
, pl as (select room_id, day, count(*) as v from f where not is_system and has_plan group by 1, 2 having count(*) >= 3)
, ch as (select room_id, day, "join" + leave + kick as v from pu where "join" + leave + kick >= 5)
, ev0 as (select room_id, day, 'burst' as kind, messages as metric from bu
 union all (select room_id, day, 'silence', gap from sl where n >= 3 and gap >= 5 qualify row_number() over (partition by room_id order by gap desc, day) = 1)
 union all (select room_id, day, 'room', v from ch qualify row_number() over (partition by room_id order by v desc, day) <= 4)
 union all (select room_id, day, 'newcomer', new_senders from pu where new_senders >= 3 qualify row_number() over (partition by room_id order by new_senders desc, day) <= 4)
 union all (select room_id, day, 'links', v from lk qualify row_number() over (partition by room_id order by v desc, day) <= 4)
 union all select room_id, day, 'meme', count from ph where rank <= 3
 union all (select room_id, day, 'plan', v from pl qualify row_number() over (partition by room_id order by day) <= 4))
, ev1 as (select room_id, day, kind, max(metric) as metric from ev0 group by 1, 2, 3)
, sp as (select room_id from (select distinct room_id from d) where room_id not in (select room_id from ev1 group by 1 having count(*) >= 8))
, mp as (select room_id, day, messages from d qualify row_number() over (partition by room_id, strftime(day, '%Y-%m') order by messages desc, day) = 1)
, ev2 as (select * from ev1 union all select room_id, day, 'milestone', messages from d where room_id in (select room_id from sp) and (room_id, day) in (select room_id, min(day) from d group by 1 union select room_id, max(day) from d group by 1)
 union all select room_id, day, 'peak', messages from mp where room_id in (select room_id from sp) and (room_id, day) not in (select room_id, day from ev1 where kind = 'burst'))
, ev3 as (select *, case kind when 'milestone' then -1 when 'burst' then 0 when 'meme' then 1 when 'peak' then 2 when 'silence' then 3 when 'room' then 3 when 'newcomer' then 4 when 'links' then 5 else 6 end as o from ev2)
, ev4 as (select * from ev3 qualify row_number() over (partition by room_id, day order by o, kind) <= 2)
, tl as (select room_id, day, kind, cast(metric as bigint) as metric, row_number() over (partition by room_id order by day, o, kind) as place from ev4 qualify place <= 24)
"""


@query("timeline", CHAT_F + TIMELINE + "select * from tl")
def timeline(spark, folder):
    return _report(spark, folder).timeline


SENT = TONE + DAYS + f""", s as (select room_id, day, sum(positive) as p, sum(negative) as n, sum(neutral) as u from w group by 1, 2)
, z as (select d.room_id, d.day, coalesce(p, 0) as p, coalesce(n, 0) as n, coalesce(p + n + u, 0) as t from d left join s using (room_id, day))
, se as (select room_id, day, case when t > 0 then {pct_sql('p', 't')} else 0.0 end as positive, case when t > 0 then {pct_sql('n', 't')} else 0.0 end as negative, case when t > 0 then floor((p - n) / cast(t as double) * 100 + 0.5) else 0 end as energy from z)
, lg as (select *, lag(energy) over x as pe, lag(negative) over x as pn, lag(positive) over x as pp, lead(day) over x as nx, count(*) over (partition by room_id) as c from se window x as (partition by room_id order by day))
, mt as (select room_id, day, 'emotional_spike' as type, 'high' as title from lg where c >= 3 and nx is not null and energy - pe >= 30 union all select room_id, day, 'emotional_spike', 'low' from lg where c >= 3 and nx is not null and pe - energy >= 30
 union all select room_id, day, 'conflict_resolution', 'settled' from lg where c >= 3 and pn > 40 and negative < 20 and positive > pp + 20)
"""


@query("mood_turns", CHAT_F + SENT + "select *, cast(0 as bigint) as messages from mt")
def mood_turns(spark, folder):
    return ins.mood_turns(_report(spark, folder).sentiment)


HOT_TOPICS = DAYS + BURSTS + SCORED + """
, hd as (select *, avg(messages) over (partition by room_id) as av, row_number() over (partition by room_id order by messages desc, day) as rk from d)
, hb as (select * from hd where rk <= 10)
, dt as (select room_id, cast(ts as date) as day, term, count(*) as c from tk group by 1, 2, 3)
, dk as (select room_id, day, string_agg(term, ' ' order by r) as keywords, list(term order by r) as kws from (select *, row_number() over (partition by room_id, day order by c desc, length(term) desc, term) as r from dt) where r <= 4 group by 1, 2)
, sm as (select cx.*, has_plan, has_question, has_attachment or has_link as sh, is_laugh from cx join f using (room_id, line))
, sg as (select ct.room_id, ct.day, count(*) filter (where has_plan) as plans, count(*) filter (where has_question) as questions, count(*) filter (where has_attachment or has_link) as shares, count(*) filter (where is_laugh) as laughs from ct join f using (room_id, line) group by 1, 2)
, sd as (select room_id, day, sender, count(*) as c from f where not is_system group by 1, 2, 3)
, sk as (select room_id, day, string_agg(sender, ' ' order by r) as speakers from (select *, row_number() over (partition by room_id, day order by c desc, sender) as r from sd) where r <= 3 group by 1, 2)
, pf as (select sm.room_id, sm.day, text, row_number() over (partition by sm.room_id, sm.day order by len(list_filter(kws, lambda k: contains(lower(text), lower(k)))) > 0 desc, score desc, length desc, line) as r from sm join dk on dk.room_id = sm.room_id and dk.day = sm.day)
, pe0 as (select room_id, day, case when length(text) > 56 then substr(text, 1, 55) || '…' else text end as e, min(r) as r from pf where r <= 2 group by 1, 2, 3)
, pg as (select room_id, day, string_agg(e, ' | ' order by r) as evidence from pe0 group by 1, 2)
, ho as (select hb.room_id, hb.day, hb.messages, """ + round_sql("hb.messages / greatest(av, 1.0)", 1) + """ as lift, coalesce(keywords, '') as keywords, plans, questions, shares, laughs, speakers, bu.day is not null as is_burst, evidence
 from hb left join dk using (room_id, day) left join sg using (room_id, day) left join sk using (room_id, day) left join pg using (room_id, day) left join bu on bu.room_id = hb.room_id and bu.day = hb.day)
"""
MOMENT_ROWS = """, a as (select *, avg(messages) over (partition by room_id) as av, count(*) over (partition by room_id) as n, row_number() over (partition by room_id order by messages desc, day) as r, sum(messages) over (partition by room_id order by day) as hi from d)
, mo as (select room_id, day, 'peak_activity' as type, 'peak' as title, messages from a where messages >= av * 2 union all select room_id, day, 'shared_joy', 'busy_day', messages from a where r <= greatest(1, ceil(n * 0.1))
 union all select room_id, arg_min(day, line), 'milestone', 'first', 1 from f group by 1 union all select room_id, arg_max(day, line), 'milestone', 'last', 1 from f group by 1
 union all select room_id, day, 'milestone', 'message ' || v, v from a, (values (1000), (5000), (10000), (50000), (100000)) t(v) where v > hi - messages and v <= hi union all select room_id, day, type, title, 0 from mt)"""
WEIGHT = "case type when 'peak_activity' then 50 when 'emotional_spike' then 44 when 'shared_joy' then 38 when 'conflict_resolution' then 36 else 22 end + log10(greatest(messages, 1))"


@query("moments", CHAT_TK + HOT_TOPICS + SENT.replace(DAYS, "") + MOMENT_ROWS + ", ms as (select mo.*, keywords, " + round_sql(f"{WEIGHT} + case when coalesce(keywords, '') <> '' then 12 else 0 end".replace("messages", "mo.messages"), 6) + """ as score from mo left join ho using (room_id, day))
  , tz as (select * from ms qualify row_number() over (partition by room_id, type order by score desc, day, title) <= 2)
select room_id, day, type, title, cast(messages as bigint) as messages, keywords, score, row_number() over (partition by room_id order by score desc, day, type, title) as rank from tz qualify rank <= 8""")
def moments(spark, folder):
    return _report(spark, folder).moments


@query("moments_plain", CHAT_F + SENT + MOMENT_ROWS + ", ms as (select *, " + round_sql(WEIGHT, 6) + """ as score from mo)
  , tz as (select * from ms qualify row_number() over (partition by room_id, type order by score desc, day, title) <= 2)
select room_id, day, type, title, cast(messages as bigint) as messages, score, row_number() over (partition by room_id order by score desc, day, type, title) as rank from tz qualify rank <= 8""")
def moments_plain(spark, folder):
    """Moments without the keyword bonus (no hot topics given)."""
    r = _report(spark, folder)
    none = r.days.filter(F.lit(False)).select("room_id", "day", F.lit("").alias("keywords"))
    ends = r.summary.select("room_id", "first_ts", "last_ts")
    return ins.moments(r.days, r.sentiment, ser.milestones(r.days), ends, none).drop("keywords")


@query("hot_topics", CHAT_TK + HOT_TOPICS + "select * from ho")
def hot_topics(spark, folder):
    return _report(spark, folder).hot_topics


ROLES = CHAT_F + """
, pp as (select room_id, sender, min(line) as first_line, count(*) as am, count(*) filter (where not is_system) as n, coalesce(sum(chars) filter (where not is_system), 0) as ch, count(*) filter (where not is_system and is_night) as ni, count(*) filter (where not is_system and has_attachment) as atm, count(*) filter (where not is_system and has_link) as li, count(*) filter (where not is_system and is_laugh) as la, count(*) filter (where not is_system and is_short) as sh from f group by 1, 2)
""" + USER + f""", rn as (select *, sum(case when ps is null or ps <> sender then 1 else 0 end) over (partition by room_id order by line rows unbounded preceding) as run from u), rl as (select room_id, sender, max(c) as run from (select room_id, sender, run, count(*) as c from rn group by 1, 2, 3) group by 1, 2)
, pq as (select pp.*, {round_sql('ch / greatest(n, 1)', 1)} as avl, {pct_sql('n', 'sum(am) over (partition by pp.room_id)')} as share, row_number() over (partition by pp.room_id order by n desc, first_line) as rk, coalesce(run, 0) as run, greatest(n, 1) as msg from pp left join rl using (room_id, sender))
, pr as (select *, avg(avl) over (partition by room_id) as ma from pq)
, rc as (select room_id, sender, first_line, unnest([
 case when rk = 1 and share >= 18 then {{'s': share + 30, 'i': 0, 'r': 'leader'}} end, case when avl >= greatest(28, ma * 1.45) then {{'s': avl, 'i': 1, 'r': 'long_writer'}} end,
 case when la / msg >= 0.12 and la >= 8 then {{'s': la / msg * 100, 'i': 2, 'r': 'mood_maker'}} end, case when sh / msg >= 0.22 and sh >= 12 then {{'s': sh / msg * 100, 'i': 3, 'r': 'reactor'}} end,
 case when li / msg >= 0.08 and li >= 8 then {{'s': li / msg * 100, 'i': 4, 'r': 'link_sharer'}} end, case when atm / msg >= 0.1 and atm >= 8 then {{'s': atm / msg * 100, 'i': 5, 'r': 'attachment_sharer'}} end,
 case when ni / msg >= 0.25 and ni >= 10 then {{'s': ni / msg * 100, 'i': 6, 'r': 'night_owl'}} end, case when run >= 10 then {{'s': cast(run * 3 as double), 'i': 7, 'r': 'chain_talker'}} end]) as x from pr)"""


@query("role_candidates", ROLES + " select room_id, sender, first_line, string_agg(x.r, ',' order by x.s desc, x.i) as roles from rc where x is not null group by 1, 2, 3")
def role_candidates(spark, folder):
    r = _report(spark, folder)
    return ins.role_candidates(r.people, r.runs).withColumn("roles", F.array_join("roles", ","))


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query("roles", _recursive(ROLES) + """
, ro as (select room_id, sender, first_line, list(x.r order by x.s desc, x.i) as roles from rc where x is not null group by 1, 2, 3)
, oi as (select *, row_number() over (partition by room_id order by first_line) as i from ro)
, st as (select room_id, cast(0 as bigint) as i, cast([] as varchar[]) as taken, cast(null as varchar) as sender, cast(null as varchar) as role from (select distinct room_id from oi)
  union all select room_id, i, case when f is null then taken else list_append(taken, f) end, sender, f from (
    select st.room_id, oi.i, st.taken, oi.sender, case when len(st.taken) < 6 then list_filter(oi.roles, lambda r: not list_contains(st.taken, r))[1] end as f
    from st join oi on oi.room_id = st.room_id and oi.i = st.i + 1))
select room_id, cast(len(taken) as int) as place, sender, role from st where role is not null""")
def roles(spark, folder):
    return _report(spark, folder).roles


PERSONAS = ROLES + f"""
, pt as (select room_id, sender, rk as "rank", msg, n, share, run, avl, {round_sql('ni / msg * 100.0', 1)} as ni, {round_sql('100.0 - ' + round_sql('ni / msg * 100.0', 1), 1)} as da,
  {round_sql('atm / msg * 100.0', 1)} as ap, {round_sql('li / msg * 100.0', 1)} as lp, {round_sql('la / msg * 100.0', 1)} as gp, {round_sql('sh / msg * 100.0', 1)} as sp from pq where rk <= 8)
, pc as (select room_id, sender, "rank", unnest([
 case when share >= 22 then {{'s': cast(share as double), 'i': 0, 'r': 'centre'}} end, case when ni >= 18 then {{'s': ni, 'i': 1, 'r': 'night_owl'}} end,
 case when da >= 88 and ni <= 8 then {{'s': da, 'i': 2, 'r': 'day_person'}} end, case when ap >= 12 then {{'s': ap, 'i': 3, 'r': 'attachment_master'}} end,
 case when lp >= 8 then {{'s': lp, 'i': 4, 'r': 'link_curator'}} end, case when run >= 8 then {{'s': cast(run * 3 as double), 'i': 5, 'r': 'chain_talker'}} end,
 case when avl >= 36 then {{'s': avl, 'i': 6, 'r': 'long_writer'}} end, case when avl <= 12 and msg >= 30 then {{'s': 100 - avl, 'i': 7, 'r': 'one_liner'}} end,
 case when gp >= 8 then {{'s': gp, 'i': 8, 'r': 'mood_maker'}} end, case when sp >= 18 then {{'s': sp, 'i': 9, 'r': 'short_answers'}} end,
 case when n >= 40 and share < 12 and run <= 4 then {{'s': n * 0.4, 'i': 10, 'r': 'quiet_observer'}} end]) as x from pt)
, ti as (select pt.room_id, pt.sender, pt."rank", coalesce(list(x.r order by x.s desc, x.i) filter (where x is not null), cast([] as varchar[])) as titles from pt left join pc using (room_id, sender, "rank") group by 1, 2, 3)"""


@query("persona_candidates", PERSONAS + """ select room_id, "rank", sender, array_to_string(titles, ',') as titles from ti""")
def persona_candidates(spark, folder):
    r = _report(spark, folder)
    return ins.persona_candidates(r.top_people, r.runs).withColumn("titles", F.array_join("titles", ","))


@query("personas", _recursive(PERSONAS) + """
, st as (select room_id, cast(0 as bigint) as "rank", cast([] as varchar[]) as used, cast(null as varchar) as sender, cast(null as varchar) as persona from (select distinct room_id from ti)
  union all select st.room_id, ti."rank", list_append(st.used, coalesce(list_filter(ti.titles, lambda t: len(list_filter(st.used, lambda u: u = t)) < 2)[1], ti.titles[1], 'all_rounder')), ti.sender,
    coalesce(list_filter(ti.titles, lambda t: len(list_filter(st.used, lambda u: u = t)) < 2)[1], ti.titles[1], 'all_rounder')
  from st join ti on ti.room_id = st.room_id and ti."rank" = st."rank" + 1)
select room_id, "rank", sender, persona from st where sender is not null""")
def personas(spark, folder):
    return _report(spark, folder).personas


ROOM = CHAT_KW + PULSE + EVENTS.replace(N, "") + PACE + BURSTS + PHRASES + CHAT_PEOPLE + f"""
, tp as (select room_id, sender as top_sender, share_percent as top_share from pe qualify row_number() over (partition by room_id order by messages desc, first_line) = 1)
, hh as (select room_id, hour as peak_hour from f group by 1, 2 qualify row_number() over (partition by room_id order by count(*) desc, hour) = 1)
, wd as (select room_id, dayofweek(day) as busiest_weekday from f group by 1, 2 qualify row_number() over (partition by room_id order by count(*) desc, dayofweek(day)) = 1)
, gr as (select room_id, gap, row_number() over (partition by room_id order by gap) - 1 as i, count(*) over (partition by room_id) as n from u where gap > 0 and gap <= 604800000)
, gq as (select room_id, {round_sql('max(gap) filter (where i = least(n - 1, cast(floor(n * 0.5) as bigint))) / 60000.0', 1)} as median_minutes, {round_sql('max(gap) filter (where i = least(n - 1, cast(floor(n * 0.9) as bigint))) / 60000.0', 1)} as p90_minutes from gr group by 1)
, ru as (select room_id, run, count(*) as c from (select *, sum(case when ps is null or ps <> sender then 1 else 0 end) over (partition by room_id order by line rows unbounded preceding) as run from u) group by 1, 2)
, mg as (select room_id, {pct_sql('sum(greatest(c - 2, 0))', 'max(total_messages)')} as monologue_percent from ru join tot using (room_id) group by 1)
, fc as (select room_id, max(total_messages) as total_messages, date_diff('day', cast(arg_min(ts, line) as date), cast(arg_max(ts, line) as date)) + 1 as span_days,
  {pct_sql('count(*) filter (where not is_system and is_night)', 'count(*)')} as night_percent, {pct_sql('count(*) filter (where not is_system and is_weekend)', 'count(*)')} as weekend_percent,
  count(*) filter (where not is_system and has_emoji) as emoji_messages, count(*) filter (where not is_system and has_attachment) as attachment_messages, count(*) filter (where not is_system and is_pure_laugh) as pure_laugh_messages,
  {pct_sql('count(*) filter (where not is_system and is_laugh)', 'count(*)')} as laugh_per_100, {pct_sql('count(*) filter (where not is_system and has_emoji)', 'count(*)')} as emoji_per_100 from f join tot using (room_id) group by 1)
, so as (select room_id, max(date_diff('day', pv, day) - 1) as max_silence from (select *, lag(day) over (partition by room_id order by day) as pv from d) group by 1)
, bs as (select room_id, count(*) as burst_days, max(messages) as top_burst, cast(arg_min(day, rank) as varchar) as top_burst_day from bu group by 1)
, ar as (select room_id, sum(messages) filter (where n >= 10 and a <= 7) as head, sum(messages) filter (where n >= 10 and a > n - 7) as tail from (select *, row_number() over (partition by room_id order by day) as a, count(*) over (partition by room_id) as n from d) group by 1)
, ks as (select room_id, {round_sql('count(*) / cast(sum(count) as double) * 100.0', 1)} as richness from kl group by 1)
, pk as (select room_id, max(hidden) as ph_n, cast(arg_max(day, hidden * 100000 - date_diff('day', date '1970-01-01', day)) as varchar) as ph_d, max("join") as pj_n, cast(arg_max(day, "join" * 100000 - date_diff('day', date '1970-01-01', day)) as varchar) as pj_d, max(hidden + kick) as pm_n, cast(arg_max(day, (hidden + kick) * 100000 - date_diff('day', date '1970-01-01', day)) as varchar) as pm_d from pu group by 1)
, rr as (select *, {round_sql('tail / cast(head as double)', 2)} as ratio, {round_sql('tail / cast(head as double) * 100.0')} as ratio100, "join" + leave + deleted + hidden + kick as sysn from fc join pc using (room_id) join tp using (room_id) join hh using (room_id) join wd using (room_id) join gq using (room_id) join mg using (room_id) join so using (room_id) join ar using (room_id) join pk using (room_id)
  join (select room_id, streak from st) using (room_id) left join bs using (room_id) left join ks using (room_id) left join (select * exclude (total_messages) from re) using (room_id) left join (select room_id, count as phrase_count from ph where rank = 1) using (room_id))
"""


def facts_sql(facts, k):
    """facts: (name, gate, value, label) over rr; the first k whose gate holds."""
    rows = " union all ".join(
        f"select room_id, {i} as o, '{n}' as fact, cast({v} as double) as value, cast({lab} as varchar) as label from rr where {g}"
        for i, (n, g, v, lab) in enumerate(facts)
    )
    return f", fa as ({rows}) select room_id, fact, value, label, row_number() over (partition by room_id order by o) as place from fa qualify place <= {k}"


@query("highlights", ROOM + facts_sql((
    ("top_speaker", "true", "top_share", "top_sender"), ("busiest_weekday", "true", "busiest_weekday", "null"), ("peak_hour", "true", "peak_hour", "null"),
    ("median_gap_minutes", "median_minutes is not null", "median_minutes", "null"), ("night_percent", "night_percent > 0", "night_percent", "null"),
    ("longest_streak", "streak > 1", "streak", "null"), ("emoji_messages", "emoji_messages > 0", "emoji_messages", "null"),
    ("attachment_messages", "attachment_messages > 0", "attachment_messages", "null"), ("weekend_percent", "weekend_percent > 0", "weekend_percent", "null"),
    ("gini", "gini >= 0.35", "gini", "null"), ("gap_p90_minutes", "p90_minutes >= 30", "p90_minutes", "null"), ("max_silence", "max_silence >= 7", "max_silence", "null"),
    ("rhythm", "rhythm >= 65", "rhythm", "null"), ("gaps_under_1m_percent", "under_1m_percent >= 40", "under_1m_percent", "null"),
    ("monologue_percent", "monologue_percent >= 25", "monologue_percent", "null"), ("system_notices", "sysn > 0", "sysn", "null"),
    ("pure_laugh_messages", "pure_laugh_messages > 0", "pure_laugh_messages", "null"), ("repeated_phrase", "phrase_count >= 10", "phrase_count", "null"),
    ("burst_days", "burst_days > 0", "burst_days", "top_burst_day"), ("tail_vs_head", "head > 0 and tail > 0 and (ratio >= 1.25 or ratio <= 0.8)", "ratio", "null"),
    ("lexical_richness", "richness >= 18", "richness", "null"), ("pace", "true", "null", "pace"), ("peak_hidden_day", "ph_n >= 5", "ph_n", "ph_d"),
    ("peak_join_day", "pj_n >= 20", "pj_n", "pj_d"),
), 14))
def highlights(spark, folder):
    return ins.highlights(_report(spark, folder).room_row)


@query("wrapped", ROOM + facts_sql((
    ("intro", "true", "total_messages", "null"), ("span_days", "true", "span_days", "null"), ("streak", "streak >= 2", "streak", "null"),
    ("peak_hour", "true", "peak_hour", "null"), ("main_speaker", "true", "top_share", "top_sender"), ("rhythm", "true", "rhythm", "null"),
    ("weekend", "weekend_percent >= 15", "weekend_percent", "null"), ("mood", "laugh_per_100 >= 5 or emoji_per_100 >= 3", "laugh_per_100", "null"),
    ("pace", "true", "case when under_1m_percent >= 35 then under_1m_percent else switches_per_100 end", "pace"), ("burst", "burst_days > 0", "top_burst", "top_burst_day"),
    ("arc", "head > 0 and tail > 0", "ratio100", "null"), ("moderation", "pm_n >= 3", "pm_n", "pm_d"),
), 8))
def wrapped(spark, folder):
    return ins.wrapped_cards(_report(spark, folder).room_row)


@query("narrative")
def narrative(spark, folder):
    r = _report(spark, folder)
    return ins.narrative(r.room_row, r.topics, r.personas, r.timeline)


@query("section_gates", CHAT_F + TIMELINE + USER + """, p as (select room_id, sender, count(*) filter (where not is_system) as messages from f group by 1, 2), mm as (select room_id, sender from p qualify row_number() over (partition by room_id order by messages desc, sender) <= 12)
, vr as (select u.room_id, count(*) as v from u join mm a on a.room_id = u.room_id and a.sender = ps join mm b on b.room_id = u.room_id and b.sender = u.sender where ps <> u.sender group by 1)
, te as (select room_id, count(*) as c from tl group by 1), dy as (select room_id, count(*) as days, count(distinct strftime(day, '%Y-%m')) as months from d group by 1)
select dy.room_id, coalesce(c, 0) > 0 as timeline, coalesce(v, 0) >= 3 as replies, days >= 3 as explorer, days > 0 as calendar, months >= 6 as monthly_chart from dy left join te using (room_id) left join vr using (room_id)""")
def section_gates(spark, folder):
    r = _report(spark, folder)
    return ins.section_gates(r.room_row, r.timeline)


@query("evidence_payload")
def evidence_payload(spark, folder):
    r = _report(spark, folder)
    pairs = r.public_pairs(r.aliases.select("room_id", "sender", "alias"))
    return ins.evidence_payload(r.room_row, r.keywords, r.topics, pairs)


@query("evidence_gate")
def evidence_gate(spark, folder):
    """User texts stand for generated ones: keep those that name a known term or number."""
    r = _report(spark, folder)
    texts = r.features.filter(~F.col("is_system")).select("room_id", F.col("line").alias("item"), F.col("msg").alias("text"))
    return ins.evidence_gate(texts, r.evidence_pool, ins.stat_tokens(r.room_row))


@query("archetype_fallback")
def archetype_fallback(spark, folder):
    r = _report(spark, folder)
    return ins.archetype_fallback(r.topics, r.keywords).withColumn("traits", F.array_join("traits", " "))


@query("chart_payload")
def chart_payload(spark, folder):
    return _report(spark, folder).chart_payload()


@query("json_answers", "select event_id as item, json_extract_string(props, '$.k') as k from events")
def json_answers(spark, folder):
    """JSON objects recovered from answers wrapped in fences, with a trailing comma."""
    from palaver.functions.text import json_object

    noisy = F.concat(F.lit("Answer:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    d = src.table(spark, folder, "events").select(F.col("event_id").alias("item"), json_object(noisy).alias("v"))
    return d.select("item", F.expr("variant_get(v, '$.k', 'string')").alias("k"))


@query("compact_numbers", "select o_orderkey, case when floor(o_totalprice + 0.5) >= 1e6 then cast(cast(floor(floor(o_totalprice + 0.5) / 1e4 + 0.5) as bigint) as varchar) || '만' when floor(o_totalprice + 0.5) >= 1e4 then regexp_replace(printf('%.1f', floor(o_totalprice + 0.5) / 1e4), '\\.0$', '') || '만' else format('{:,}', cast(floor(o_totalprice + 0.5) as bigint)) end as total from orders")
def compact_numbers(spark, folder):
    from palaver.functions.numeric import compact_number

    return src.table(spark, folder, "orders").select("o_orderkey", compact_number(F.col("o_totalprice")).alias("total"))


@query("gap_texts", EV + ", g as (select room_id, line, floor((epoch_us(ts) - epoch_us(lag(ts) over (partition by room_id order by line))) / 1000) / 60000.0 as mi from m) select room_id, line, case when mi is null then '—' when mi < 1.0 / 60 then '1초 미만' when mi < 1 then cast(cast(greatest(1, floor(mi * 60 + 0.5)) as bigint) as varchar) || '초' when mi < 10 then regexp_replace(printf('%.1f', floor(mi * 10 + 0.5) / 10), '\\.0$', '') || '분' else cast(cast(floor(mi + 0.5) as bigint) as varchar) || '분' end as gap from g")
def gap_texts(spark, folder):
    from palaver.functions.numeric import gap_text

    flow = fl.conversation_flow(src.event_messages(spark, folder))
    return flow.select("room_id", "line", gap_text(F.col("gap_ms") / F.lit(60000.0)).alias("gap"))


@query("period_compare", CHAT_F + DAYS + ARC)
def period_compare(spark, folder):
    return ser.activity_arc(_report(spark, folder).days)
