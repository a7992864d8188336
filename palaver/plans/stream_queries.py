"""Registered queries: the stream versions, run over all available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palaver.operators import flow as fl
from palaver.plans import text_sql as t
from palaver.plans.activity_queries import EV
from palaver.plans.flow_queries import HIST, LINK, SESS
from palaver.plans.registry import query
from palaver.session import work_dir
from palaver.sources import tables as src
from palaver.sources.sinks import ROOM_IN_PATH, write_exports
from palaver.streaming import exports
from palaver.streaming import rooms as st
from palaver.streaming import slots as sl


@query("stream_daily", EV + " select room_id, cast(ts as date) as day, count(*) as messages from m group by 1, 2")
def stream_daily(spark, folder):
    return st.latest_counts(st.daily_counts(st.event_stream(spark, folder)), "stream-daily", ["room_id", "day"])


@query("stream_hourly", EV + " select room_id, strftime(ts, '%Y-%m-%d %H') as hour, count(*) as messages from m group by 1, 2")
def stream_hourly(spark, folder):
    return st.latest_counts(st.hourly_counts(st.event_stream(spark, folder)), "stream-hourly", ["room_id", "hour"])


@query("stream_sliding", EV + ", c as (select room_id, cast(ts as date) - cast(i as int) as from_day, count(*) as messages from m, range(7) r(i) group by 1, 2) select room_id, cast(from_day as date) as from_day, messages from c")
def stream_sliding(spark, folder):
    return st.latest_counts(st.sliding_activity(st.event_stream(spark, folder)), "stream-sliding", ["room_id", "from_day"])


@query("stream_sessions", EV + SESS + ", mx as (select epoch_us(max(ts)) as mx from m) select room_id, start_us, messages from s, mx where end_us + 1800000000 <= mx - 3600000000")
def stream_sessions(spark, folder):
    return st.run_append(st.sessions(st.event_stream(spark, folder)), "stream-sessions", **st.LOCAL_SESSIONS)


@query("stream_switches", EV + LINK + " select room_id, count(*) as messages, count(*) filter (where ps <> sender) as switches from x group by 1")
def stream_switches(spark, folder):
    return fl.switches(st.flow(st.event_stream(spark, folder), 1000)[0])


@query("stream_session_sizes", EV + SESS + " select room_id, session_id, messages from s")
def stream_session_sizes(spark, folder):
    rows, _ = st.flow(st.event_stream(spark, folder))
    return rows.groupBy("room_id", "session_id").agg(F.count("*").alias("messages"))


@query("stream_gap_hist", EV + HIST + " select * from h")
def stream_gap_hist(spark, folder):
    return st.stream_gap_histogram(st.event_stream(spark, folder))


@query("stream_new_senders", EV + ", f as (select room_id, sender, arg_min(cast(ts as date), line) as day from m group by 1, 2) select room_id, day, count(*) as new_senders from f group by 1, 2")
def stream_new_senders(spark, folder):
    return st.first_seen(st.event_stream(spark, folder))


@query("stream_terms", f"with m as ({src.documents_sql('lang')})" + t.tokens_sql("m", "message") + "select room_id, term, count(*) as df from tk group by 1, 2")
def stream_terms(spark, folder):
    return st.term_counts(st.document_stream(spark, folder))


# slots that end at or before the last message less one hour of delay are closed
CLOSED = ", cl as (select (epoch_us(max(ts)) - 3600000000) // 3600000000 * 3600000000 as us from m), cm as (select m.* from m, cl where epoch_us(ts) < us)"
CLOSED_LINK = CLOSED + """, cx as (select *, lag(sender) over w as ps, epoch_us(ts) - epoch_us(lag(ts) over w) as gap from cm window w as (partition by room_id order by ts, line))
, cy as (select *, sum(case when gap is null or gap > 1800000000 then 1 else 0 end) over (partition by room_id order by ts, line rows unbounded preceding) as s from cx)"""


def _slots(spark, folder):
    return sl.run(st.event_stream(spark, folder))[0]


@query("stream_slots", EV + CLOSED + " select room_id, epoch_us(ts) // 3600000000 * 3600000 as slot_ms, count(*) as messages, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from cm group by 1, 2")
def stream_slots(spark, folder):
    """Closed hours of every room, from keyed state with timers."""
    return _slots(spark, folder).select("room_id", "slot_ms", "messages", "first_us", "last_us")


@query("stream_slot_switches", EV + CLOSED_LINK + " select room_id, count(*) as messages, count(*) filter (where ps <> sender) as switches from cx group by 1")
def stream_slot_switches(spark, folder):
    return sl.switches(_slots(spark, folder))


@query("stream_slot_sessions", EV + CLOSED_LINK + " select room_id, min(epoch_us(ts)) as start_us, max(epoch_us(ts)) as end_us, count(*) as messages from cy group by room_id, s")
def stream_slot_sessions(spark, folder):
    return sl.sessions(_slots(spark, folder))


@query("stream_exports", f"select room_id, ts, sender, message from ({src.CONVERSATIONS_SQL})")
def stream_exports(spark, folder):
    """Growing export files of all conversations, arriving in two steps: each message once."""
    messages = src.conversation_messages(spark, folder)
    base = f"{work_dir(spark)}/arriving-{uuid.uuid4().hex}"
    name = uuid.uuid4().hex
    for step, upto in (("1", 2), ("2", None)):
        write_exports(messages if upto is None else messages.where(F.col("line") < upto), f"{base}/{step}")
        found = exports.new_messages(exports.export_lines_stream(spark, base, pattern="*.txt"), resume=name, room=F.regexp_extract("path", ROOM_IN_PATH, 1))
    return found.drop("line")


@query("stream_sample", EV + " select room_id, line, sender from m qualify row_number() over (partition by room_id order by md5('42:' || line), line) <= 480")
def stream_sample(spark, folder):
    return st.sample(st.event_stream(spark, folder))
