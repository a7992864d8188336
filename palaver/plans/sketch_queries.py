"""Registered queries: sketches beside the exact operators.

A sketch's estimate depends on the order in which rows meet, so the queries return exact values
and whether the estimate lies within its stated error of them; the SQL states the exact values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators import features as feat
from palaver.operators import flow as fl
from palaver.operators import keywords as kw
from palaver.operators import sketches as sk
from palaver.plans import text_sql as t
from palaver.plans.chat_sql import CHAT_F
from palaver.plans.flow_queries import EV, GAPS
from palaver.plans.registry import query
from palaver.session import materialise
from palaver.sources import tables as src
from palaver.streaming import rooms as st

#: Items that a sketch must hold: more than twice its error.
SURE = f"2 * 3.5 / {sk.map_size()}"


def _held(exact: DataFrame, estimates: DataFrame, item: str, count: str) -> DataFrame:
    """Exact counts of the items that a sketch must hold, and whether it does, within its error."""
    total = exact.groupBy("room_id").agg(F.sum(count).alias("all"))
    sure = exact.join(total, "room_id").where(F.col(count) > 2 * sk.over(F.col("all")))
    found = sure.join(estimates.select("room_id", item, "estimate", "over"), ["room_id", item], "left")
    return found.select(
        "room_id", item, count, F.col("estimate").isNotNull().alias("held"),
        F.coalesce((F.col("estimate") >= F.col(count)) & (F.col("estimate") <= F.col(count) + F.col("over")), F.lit(False)).alias("within"),
    )


def _held_sql(counts: str, item: str, count: str) -> str:
    return f"""select room_id, {item}, {count}, true as held, true as within
  from (select *, sum({count}) over (partition by room_id) as total from ({counts})) where {count} > {SURE} * total"""


TERMS = f"with m as ({src.documents_sql('lang')})" + t.tokens_sql("m", "message")
TERM_COUNTS = "select room_id, term, count(*) as df from tk group by 1, 2"


def _terms(spark, folder) -> DataFrame:
    docs = src.document_messages(spark, folder, "lang")
    return materialise(kw.token_docs(docs, "message").select("room_id", F.explode("tokens").alias("term")), "terms")


@query("terms_sketch", TERMS + _held_sql(TERM_COUNTS, "term", "df"))
def terms_sketch(spark, folder):
    terms = _terms(spark, folder)
    exact = terms.groupBy("room_id", "term").agg(F.count("*").alias("df"))
    parts = sk.count_items(terms.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8))), ["room_id", "part"], "term")
    return _held(exact, sk.item_estimates(sk.merge_items(parts, ["room_id"]), ["room_id"], "term"), "term", "df")


@query("stream_top_terms", TERMS + _held_sql(TERM_COUNTS, "term", "df"))
def stream_top_terms(spark, folder):
    exact = _terms(spark, folder).groupBy("room_id", "term").agg(F.count("*").alias("df"))
    return _held(exact, sk.item_estimates(st.top_terms(st.document_stream(spark, folder)), ["room_id"], "term"), "term", "df")


DOMAINS = CHAT_F + _held_sql("select room_id, domain, count(*) as count from (select room_id, unnest(domains) as domain from f where not is_system) group by 1, 2", "domain", "count")


@query("domains_sketch", DOMAINS)
def domains_sketch(spark, folder):
    features = feat.message_features(src.chat_messages(spark, folder))
    hosts = features.where(~F.col("is_system") & F.col("has_link")).select("room_id", "line", F.explode("domains").alias("domain"))
    hosts = materialise(hosts, "hosts")
    exact = hosts.groupBy("room_id", "domain").agg(F.count("*").alias("count"))
    days = sk.count_items(hosts.withColumn("part", F.floor(F.col("line") / 1000)), ["room_id", "part"], "domain")
    return _held(exact, sk.item_estimates(sk.merge_items(days, ["room_id"]), ["room_id"], "domain"), "domain", "count")


RANGES = EV + GAPS + """
, b as (select room_id, line, sender, strftime(ts, '%Y-%m') as month from m union all select room_id, line, sender, 'all' from m)
, c as (select room_id, month, count(*) as messages, count(distinct sender) as senders from b group by 1, 2)
, gg as (select b.room_id, month, count(*) as gap_rows from b join g using (room_id, line) group by 1, 2)
select c.room_id, c.month, messages, senders, coalesce(gap_rows, 0) as gap_rows, true as senders_within, true as p50_within, true as p90_within
from c left join gg using (room_id, month)"""


@query("range_sketches", RANGES)
def range_sketches(spark, folder):
    """Distinct senders and gap quantiles of every month and of all days, from the days' sketches."""
    flow = materialise(fl.conversation_flow(src.event_messages(spark, folder), 1000), "flow")
    days = materialise(sk.day_sketches(flow), "day-sketches")
    month = F.date_format("day", "yyyy-MM")
    ranges = F.explode(F.array(month, F.lit("all"))).alias("month")
    keys = ["room_id", "month"]
    estimates = sk.day_estimates(sk.merge_days(days.select("*", ranges), keys), keys).withColumnRenamed("senders", "estimate")
    rows = flow.withColumn("day", F.to_date(F.timestamp_micros("us"))).select("*", ranges)
    valid = (F.col("gap_ms") > 0) & (F.col("gap_ms") <= fl.MAX_GAP_MS)
    senders = rows.groupBy(*keys, "sender").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias("senders"))
    ranks = rows.where(valid).join(estimates.select(*keys, "p50", "p90"), keys).groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("gap_ms") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p90")],
        *[F.count_if(F.col("gap_ms") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p90")],
    )
    d = estimates.join(senders, keys).join(ranks, keys, "left")
    within = lambda p, at: F.coalesce(
        (F.col(f"{p}_below") <= F.col("n") * (at + sk.RANK_ERROR)) & (F.col(f"{p}_upto") >= F.col("n") * (at - sk.RANK_ERROR)), F.lit(True)
    ).alias(f"{p}_within")
    close = F.abs(F.col("estimate") - F.col("senders")) <= F.greatest(F.lit(1.0), sk.SENDER_ERROR * F.col("senders"))
    return d.select(*keys, "messages", "senders", "gap_rows", close.alias("senders_within"), within("p50", 0.5), within("p90", 0.9))
