"""Registered queries: topics, vectors, samples."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.operators import features as feat
from palaver.operators import keywords as kw
from palaver.operators import sampling as smp
from palaver.operators import topic_cards as cards
from palaver.operators import topics as tp
from palaver.operators import vectors as vec
from palaver.operators.topk import top_k
from palaver.plans import text_queries as tq
from palaver.plans import text_sql as t
from palaver.plans.chat_sql import CHAT_F, CHAT_F1, q, scrub_sql, u16_sql
from palaver.plans.registry import query, round_sql
from palaver.session import materialise
from palaver.sources import tables as src

TD = f", td0 as (select room_id, line, ts, term, i from tk where not {t.noise_sql('term')}), td as (select room_id, line, ts, term, row_number() over (partition by room_id, line order by i) as i from td0)"
CO = TD + ", co as (select x.room_id, least(x.term, y.term) as a, greatest(x.term, y.term) as b, count(*) as weight from td x join td y on x.room_id = y.room_id and x.line = y.line and y.i > x.i and y.i < x.i + 4 group by 1, 2, 3)"
GN = CO + f", tc as (select room_id, term, count(*) as df from td group by 1, 2), sz as (select room_id, count(distinct line) as topic_docs from td group by 1), gn as (select *, row_number() over (partition by room_id order by df desc, term) as rank from tc where term not in {t.words(t.STOP_TERMS)} qualify rank <= 140)"
_pmi = "ln(cast(weight as double) * topic_docs / (na.df * nb.df))"
GE = GN + f", ge as (select co.room_id, a, b, weight, {round_sql(_pmi, 6)} as pmi from co join gn na on na.room_id = co.room_id and na.term = a join gn nb on nb.room_id = co.room_id and nb.term = b join sz on sz.room_id = co.room_id join tot on tot.room_id = co.room_id where weight >= case when total_messages >= 50000 then 4 else 2 end and na.df >= 2 and nb.df >= 2 and {_pmi} >= case when total_messages >= 50000 then 0.35 else 0 end)"


def _docs(spark, folder):
    return tp.topic_docs(tq.doc_tokens(spark, folder))


def _chat_docs(spark, folder):
    return materialise(tp.topic_docs(tq.chat_docs(spark, folder)), "topic-docs")


@query("cooccurrence", t.DOC_TK + CO + " select * from co")
def cooccurrence(spark, folder):
    return tp.cooccurrence(_docs(spark, folder))


@query("graph_nodes", t.DOC_TK + GN + " select * from gn")
def graph_nodes(spark, folder):
    return tp.graph_nodes(tp.topic_term_counts(_docs(spark, folder)))


def _graph(docs, totals):
    counts = tp.topic_term_counts(docs)
    nodes = materialise(tp.graph_nodes(counts), "graph-nodes")
    sizes = tp.document_counts(docs)
    return counts, nodes, sizes, tp.graph_edges(tp.cooccurrence(docs, nodes), nodes, sizes, totals)


@query("graph_edges", t.DOC_TK + GE + " select * from ge")
def graph_edges(spark, folder):
    docs = materialise(_docs(spark, folder), "topic-docs")
    return _graph(docs, tq.doc_totals(spark, folder))[3]


@query("neighbours", t.CHAT_TK + CO + """, sd as (select room_id, label from (select distinct room_id from tk), (values ('자동화'), ('서버'), ('데이터 파이프라인')) v(label))
, w as (select room_id, label, unnest(string_split(label, ' ')) as term from sd), e2 as (select room_id, a as term, b as neighbour, weight from co union all select room_id, b, a, weight from co)
select room_id, label, neighbour, cast(sum(weight) as bigint) as weight, row_number() over (partition by room_id, label order by sum(weight) desc, neighbour) as rank from e2 join w using (room_id, term) group by 1, 2, 3 qualify rank <= 3""")
def neighbours(spark, folder):
    docs = _chat_docs(spark, folder)
    labels = F.array(*[F.lit(x) for x in ("자동화", "서버", "데이터 파이프라인")])
    seeds = docs.select("room_id").distinct().select("room_id", F.explode(labels).alias("label"))
    return tp.neighbours(docs, seeds)


TFIDF = """, sz0 as (select room_id, class, sum(tf) as s from cl group by 1, 2), me as (select room_id, avg(s) as m from sz0 group by 1), sp0 as (select room_id, term, count(*) as d from cl group by 1, 2 having count(*) >= {min_df})
, sc as (select cl.room_id, cl.class, cl.term, cl.tf, """ + round_sql("cast(tf as double) / s * ln(1.0 + m / d)", 9) + """ as score from cl join sz0 using (room_id, class) join me on me.room_id = cl.room_id join sp0 on sp0.room_id = cl.room_id and sp0.term = cl.term)
, tt as (select *, row_number() over (partition by room_id, class order by score desc, length(term) desc, term) as rank from sc qualify rank <= {n})"""


@query("ctfidf", f"with m as ({src.documents_sql('lang')})" + t.tokens_sql("m", "message") + ", cl as (select 'all' as room_id, room_id as class, term, count(*) as tf from tk group by 1, 2, 3)" + TFIDF.format(min_df=2, n=10) + " select * from tt")
def ctfidf(spark, folder):
    """Telling terms per language over all documents."""
    terms = kw.term_stats(tq.doc_tokens(spark, folder))
    classes = terms.select(F.lit("all").alias("room_id"), F.col("room_id").alias("class"), "term", F.col("df").alias("tf"))
    return tp.class_tfidf(classes, 10, 2)


PERIODS = TD + f""", ms as (select room_id, strftime(ts, '%Y-%m') as class, count(distinct line) as n from td group by 1, 2 having count(distinct line) >= 40)
, cl as (select td.room_id, strftime(ts, '%Y-%m') as class, term, count(*) as tf from td join ms on ms.room_id = td.room_id and ms.class = strftime(ts, '%Y-%m') where term not in {t.words(t.STOP_TERMS)} group by 1, 2, 3)""" + TFIDF.format(min_df=1, n=6) + f"""
, cg as (select room_id, class, string_agg(term, ' ' order by rank) as terms from tt group by 1, 2 having count(*) >= 2)
select cg.room_id, 'month-' || class as id, 'period' as kind, class as title, terms, {round_sql('n / cast(total_messages as double) * 100.0', 1)} as percent from cg join ms using (room_id, class) join tot on tot.room_id = cg.room_id qualify row_number() over (partition by cg.room_id order by n desc, class) <= 4"""


@query("period_topics", t.DOC_TK + PERIODS)
def period_topics(spark, folder):
    docs = materialise(_docs(spark, folder), "topic-docs")
    return tp.periods(docs, tq.doc_totals(spark, folder)).withColumn("terms", F.array_join("terms", " "))


CM = """
, bl as (select room_id, term, "to" from (select room_id, a as term, b as "to", a, b, weight, pmi from ge union all select room_id, b, a, a, b, weight, pmi from ge)
  qualify row_number() over (partition by room_id, term order by weight desc, pmi desc, a, b) = 1)
, reach as (select room_id, term, "to" as at from bl union select r.room_id, r.term, bl."to" from reach r join bl on bl.room_id = r.room_id and bl.term = r.at)
, mu as (select x.room_id, x.term from bl x join bl y on x.room_id = y.room_id and x."to" = y.term and y."to" = x.term)
, ro as (select r.room_id, r.term, min(r.at) as root from reach r join mu on mu.room_id = r.room_id and mu.term = r.at group by 1, 2)
, cm0 as (select ro.*, gn.rank, min(gn.rank) over (partition by ro.room_id, root) as first from ro join gn using (room_id, term))
, cm as (select room_id, cast(dense_rank() over (partition by room_id order by first) - 1 as int) as community, cast(row_number() over (partition by room_id, root order by rank) - 1 as int) as place, term from cm0)"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _renamed(sql: str, suffix: str) -> str:
    """The same tables under other names, so that a step can be stated twice."""
    return re.sub(r"\b(sz0|me|sp0|sc|tt|cl|ms|cg)\b(?!\()", rf"\1{suffix}", sql)


def _generic_sql(x: str) -> str:
    ws = t.words(lex.GENERIC_LEADS)
    return f"(trim({x}) in {ws} or lower(regexp_extract(trim({x}), '^[^\\s]+')) in {ws})"


def _normal_sql(x: str) -> str:
    """normalise_term as one expression."""
    c = t.canonical_sql(f"trim({x})")
    p = q(lex.PARTICLE)
    bare = f"regexp_replace(({c}), {p}, '')"
    stem = f"(case when length(({c})) > 2 and regexp_matches(({c}), {p}) and length({bare}) >= 2 then {bare} else ({c}) end)"
    alias = " ".join(f"when '{k}' then '{v}'" for k, v in lex.TERM_ALIASES.items())
    return f"coalesce(case ({c}) {alias} end, case {stem} {alias} end, {stem})"


def _title_sql(terms: str, out: str) -> str:
    """``out``(room_id, id, title, terms) from ``terms``(room_id, id, r, term)."""
    return f"""
, {out}0 as (select room_id, id, coalesce(arg_min(term, r) filter (where not {_generic_sql('term')}), arg_min(term, r)) as lead from {terms} group by 1, 2)
, {out} as (select x.room_id, x.id, case when count(*) filter (where term <> lead) > 0 then any_value(lead) || ' · ' || arg_min(term, r) filter (where term <> lead) else any_value(lead) end as title,
   string_agg(term, ' ' order by r) as terms from {terms} x join {out}0 using (room_id, id) group by 1, 2)"""


def _share_sql(hits: str) -> str:
    return round_sql(f"least(100.0, {hits} / cast(greatest(total_messages, 1) as double) * 100.0)", 1)


def _overlap_sql(cards: str, out: str, least: float, title: str = "") -> str:
    """``out``(room_id, one, two) of ``cards``(room_id, id, term) whose normal terms overlap by ``least``."""
    return f"""
, {out}w as (select distinct room_id, id, {_normal_sql('term')} as term from {cards} where length({_normal_sql('term')}) >= 2)
, {out}n as (select room_id, id, count(*) as n from {out}w group by 1, 2)
, {out}k as (select x.room_id, x.id as one, y.id as two, count(*) as k from {out}w x join {out}w y on x.room_id = y.room_id and x.term = y.term and x.id <> y.id group by 1, 2, 3)
, {out} as (select k.room_id, one, two from {out}k k join {out}n a on a.room_id = k.room_id and a.id = one join {out}n b on b.room_id = k.room_id and b.id = two where {round_sql('cast(k as double) / (a.n + b.n - k)', 6)} >= {least})"""


THEMES = _renamed(
    ", cl as (select room_id, 'theme-' || community as class, term, df as tf from cm join tc using (room_id, term))"
    + TFIDF.format(min_df=1, n=6), "_th",
) + f"""
, th_w as (select room_id, class as id, term, row_number() over (partition by room_id, class order by rank, term) as r from tt_th where not {t.bad_sql('term')} qualify r <= 8)
, th_k as (select room_id, id from th_w group by 1, 2 having count(*) >= 2), th_t as (select th_w.* from th_w join th_k using (room_id, id))""" + _title_sql("th_t", "th_c") + f"""
, th_h as (select room_id, class as id, max(tf) as hits from cl_th group by 1, 2)
, th as (select c.room_id, c.id, 'theme' as kind, title, terms, {_share_sql('least(hits, topic_docs, total_messages)')} as percent from th_c c join th_h using (room_id, id) join sz using (room_id) join tot using (room_id)
   where {_share_sql('least(hits, topic_docs, total_messages)')} >= case when total_messages >= 50000 then 0.8 else 1.5 end and topic_docs >= 30)"""
GRAPH_CARDS = CM + THEMES + re.sub(r"\bselect cg_pe\.room_id", ", pe as (select cg_pe.room_id", _renamed(PERIODS.removeprefix(TD), "_pe")) + """)
, gc as (select * from th union all select * from pe)"""
REFINED = GRAPH_CARDS + """
, gt as (select *, row_number() over (partition by room_id order by percent desc, id) as p from gc where kind = 'theme')
, gw as (select room_id, id, unnest(string_split(terms, ' ')) as term from gt)""" + _overlap_sql("gw", "go", 0.55) + """
, gd as (select distinct go.room_id, one as id from go join gt x on x.room_id = go.room_id and x.id = one join gt y on y.room_id = go.room_id and y.id = two where y.p < x.p)
, rf as (select gc.*, cast(row_number() over (partition by gc.room_id order by percent desc, gc.id) as int) as place from gc anti join gd on gd.room_id = gc.room_id and gd.id = gc.id)"""


@query("communities", _recursive(t.DOC_TK + GE + CM) + " select * from cm")
def communities(spark, folder):
    totals = tq.doc_totals(spark, folder)
    _, nodes, _, edges = _graph(materialise(_docs(spark, folder), "topic-docs"), totals)
    return tp.communities(nodes, edges)


def _graph_cards(spark, folder, docs, totals):
    counts, nodes, sizes, edges = _graph(docs, totals)
    groups = materialise(tp.communities(nodes, edges), "communities")
    return tp.themes(groups, counts, sizes, totals).unionByName(tp.periods(docs, totals))


@query("themes", _recursive(t.CHAT_TK + GE + GRAPH_CARDS) + " select * from gc")
def themes(spark, folder):
    docs = _chat_docs(spark, folder)
    return _graph_cards(spark, folder, docs, tq.chat_totals(spark, folder)).withColumn("terms", F.array_join("terms", " "))


@query("refined_topics", _recursive(t.CHAT_TK + GE + REFINED) + " select * from rf")
def refined_topics(spark, folder):
    docs = _chat_docs(spark, folder)
    graph = materialise(_graph_cards(spark, folder, docs, tq.chat_totals(spark, folder)), "graph-cards")
    return cards.refined_topics(graph).withColumn("terms", F.array_join("terms", " "))


SEEDS = f"""
, sl as (select room_id, label, hits, rank, distinctive_rank, {_share_sql('hits')} as percent from kw join tot using (room_id) where (rank <= 12 or distinctive_rank <= 8) and total_messages >= 30)
, sw as (select room_id, label, unnest(string_split(label, ' ')) as term, unnest(range(1, len(string_split(label, ' ')) + 1)) as pos from sl)
, se as (select room_id, a as term, b as neighbour, weight from co union all select room_id, b, a, weight from co)
, sn as (select room_id, label, neighbour, row_number() over (partition by room_id, label order by sum(weight) desc, neighbour) as r from se join sw using (room_id, term) where length(term) >= 2 group by room_id, label, neighbour qualify r <= 3)
, st0 as (select room_id, label, pos, {_normal_sql('term')} as term from sw union all select room_id, label, 100 + r, {_normal_sql('neighbour')} from sn)
, st1 as (select room_id, label, term, min(pos) as pos from st0 where length(term) >= 2 group by 1, 2, 3)
, s_good as (select sl.* from sl where percent >= 0.5 and not ({_generic_sql('label')} and distinctive_rank > 8) and exists (select 1 from st1 where st1.room_id = sl.room_id and st1.label = sl.label and pos < 100))
, s_t as (select st1.room_id, 'kw-' || rank as id, rank, percent, {_normal_sql('label')} as word, st1.term, row_number() over (partition by st1.room_id, st1.label order by pos) as r from st1 join s_good using (room_id, label) qualify r <= 8)
, s_kn as (select distinct x.room_id, x.id from s_t x join s_t y on x.room_id = y.room_id and y.term = x.word and y.rank < x.rank)
, s_f as (select s_t.* from s_t anti join s_kn on s_kn.room_id = s_t.room_id and s_kn.id = s_t.id)""" + _overlap_sql("s_f", "s_o", 0.45) + """
, s_d as (select distinct o.room_id, one as id from s_o o join s_f x on x.room_id = o.room_id and x.id = one join s_f y on y.room_id = o.room_id and y.id = two where y.rank < x.rank)
, s_k as (select s_f.* from s_f anti join s_d on s_d.room_id = s_f.room_id and s_d.id = s_f.id)""" + _title_sql("s_k", "s_c") + """
, sd as (select room_id, id, 'theme' as kind, title, terms, percent, cast(row_number() over (partition by room_id order by percent desc, rank) as int) as place from s_c join (select distinct room_id, id, percent, rank from s_k) using (room_id, id))"""


def _chat_frames(spark, folder):
    """Features, token documents, topic documents and totals of the chat, each written once."""
    features = tq.keyword_features(spark, folder)
    tokens = materialise(kw.token_docs(features), "chat-tokens")
    totals = materialise(features.groupBy("room_id").agg(F.count("*").alias("total_messages")), "chat-totals")
    return features, tokens, materialise(tp.topic_docs(tokens), "topic-docs"), totals


def _seeds(spark, folder, features, tokens, docs, totals):
    lanes = materialise(tq.chat_lanes(spark, folder, features, tokens, totals), "lanes")
    labels = lanes.filter("rank <= 12 or distinctive_rank <= 8").select("room_id", "label")
    return lanes, materialise(tp.seed_candidates(lanes, tp.neighbours(docs, labels), totals), "seeds")


@query("seed_topics", t.CHAT_KW + CO + SEEDS + " select * from sd")
def seed_topics(spark, folder):
    _, seeds = _seeds(spark, folder, *_chat_frames(spark, folder))
    return cards.seed_topics(seeds).withColumn("terms", F.array_join("terms", " "))


MERGED = f"""
, ln0 as (select room_id, 'graph:' || id as id, title, terms, percent, 1.0 as w, row_number() over (partition by room_id order by place) as p from rf where kind = 'theme'
  union all select room_id, 'seed:' || id, title, terms, percent, 1.15, row_number() over (partition by room_id order by place) from sd)
, ln as (select room_id, id, title, terms, percent, cast(w as double) / (60.0 + p) as weight from ln0)
, lw as (select room_id, id, unnest(string_split(terms, ' ')) as term from ln)""" + _overlap_sql("lw", "lo", 0.42) + f"""
, lt0 as (select distinct room_id, id, {_normal_sql('part')} as part from (select room_id, id, unnest(regexp_split_to_array(title, '\\s*·\\s*')) as part from ln))
, lt as (select room_id, id, string_agg(part, '|' order by part) as key from lt0 where length(part) >= 2 group by 1, 2)
, lk as (select ln.room_id, ln.id, coalesce(key, '') as key from ln left join lt using (room_id, id))
, le as (select room_id, one as a, two as b from lo union select x.room_id, x.id, y.id from lk x join lk y on x.room_id = y.room_id and x.key = y.key)
, lr as (select room_id, id, id as at from ln union select lr.room_id, lr.id, le.b from lr join le on le.room_id = lr.room_id and le.a = lr.at)
, lg as (select room_id, id, min(lr.at) as theme from lr group by 1, 2)
, lp as (select ln.*, theme from ln join lg using (room_id, id))
, ls as (select room_id, theme, {round_sql('sum(weight)', 9)} as score, max(percent) as percent, arg_min(id, (-weight, id)) as id from lp group by 1, 2)
, lx0 as (select distinct lp.room_id, theme, weight, lp.id, low.term from lp join low using (room_id, id))
, lx as (select room_id, theme, term, {round_sql('sum(weight)', 9)} as w from lx0 group by 1, 2, 3)
, ly as (select lx.room_id, ls.id, term, row_number() over (partition by lx.room_id, theme order by w desc, term) as r from lx join ls using (room_id, theme) qualify r <= 8)""" + _title_sql("ly", "lc") + """
, mp as (select *, row_number() over (partition by room_id order by percent desc, id) as n from rf where kind = 'period' qualify n <= 4)
, mh as (select room_id, count(*) as held from mp group by 1)
, mt0 as (select ls.room_id, ls.id, title, terms, percent, row_number() over (partition by ls.room_id order by score desc, percent desc, ls.id) as n from ls join lc using (room_id, id))
, mg0 as (select mt0.room_id, 0 as part, n, id, 'theme' as kind, title, terms, percent from mt0 left join mh using (room_id) where n <= 12 - coalesce(held, 0)
  union all select room_id, 1, n, id, kind, title, terms, percent from mp)
, mg as (select room_id, cast(row_number() over (partition by room_id order by part, n) as int) as place, id, kind, title, terms, percent from mg0)"""
ALL_CARDS = _recursive(t.CHAT_KW + GE + REFINED + SEEDS + MERGED.replace(", mh as", ", mhd as").replace("join mh using", "join mhd using"))


def chat_topics(spark, folder):
    features, tokens, docs, totals = _chat_frames(spark, folder)
    lanes, seeds = _seeds(spark, folder, features, tokens, docs, totals)
    graph = materialise(cards.refined_topics(materialise(_graph_cards(spark, folder, docs, totals), "graph-cards")), "refined")
    seeded = materialise(cards.seed_topics(seeds), "seed-cards")
    return lanes, materialise(cards.merged_topics(graph, seeded, seeded.filter(F.lit(False)), 12, 4), "merged"), totals


@query("topic_merge", ALL_CARDS + " select * from mg")
def topic_merge(spark, folder):
    return chat_topics(spark, folder)[1].withColumn("terms", F.array_join("terms", " "))


PROPOSED = f"""
, pp as (select room_id, kw.rank as proposal, label as title, case when kw.rank % 2 = 0 then label else '없는말' end as evidence, hits from kw where contains(label, ' ') and kw.rank <= 20)
, ph as (select pp.*, k.count as found from pp join kl k on k.room_id = pp.room_id and k.label = pp.evidence)
, pw0 as (select room_id, proposal, {_normal_sql('evidence')} as term, 0 as pos from ph union all select room_id, proposal, {_normal_sql('w')}, pos from (select room_id, proposal, unnest(string_split(title, ' ')) as w, unnest(range(1, len(string_split(title, ' ')) + 1)) as pos from ph))
, pw as (select room_id, proposal, term, min(pos) as pos from pw0 where length(term) >= 2 group by 1, 2, 3)
, pc as (select ph.room_id, proposal, 'proposal-' || proposal as id, title, greatest({_share_sql('found')}, 1.2) as percent, (select string_agg(term, chr(9) order by pos) from (select * from pw where pw.room_id = ph.room_id and pw.proposal = ph.proposal order by pos limit 8)) as terms
   from ph join tot using (room_id) where (select count(*) from pw where pw.room_id = ph.room_id and pw.proposal = ph.proposal) >= 2)
, pa as (select room_id, 0 as part, place as n, id, kind, title, replace(terms, ' ', chr(9)) as terms, percent from mg union all select room_id, 1, proposal, id, 'theme', title, terms, percent from pc)
, pr as (select *, row_number() over (partition by room_id order by part, n) as p from pa)
, px as (select room_id, id, unnest(string_split(terms, chr(9))) as term from pr where kind = 'theme')""" + _overlap_sql("px", "po", 0.42) + """
, pd as (select distinct po.room_id, one as id from po join pr x on x.room_id = po.room_id and x.id = one join pr y on y.room_id = po.room_id and y.id = two where y.p < x.p)
, pf as (select * from pr where part = 0 union all select pr.* from pr anti join pd on pd.room_id = pr.room_id and pd.id = pr.id where part = 1)
, pz as (select room_id, cast(row_number() over (partition by room_id order by part desc, n) as int) as place, id, kind, title, replace(terms, chr(9), ' ') as terms, percent from pf)"""


@query("topic_proposals", ALL_CARDS + PROPOSED + " select * from pz where place <= 12")
def topic_proposals(spark, folder):
    """Proposals derived from each room's own bigrams; one cites a word nobody used."""
    lanes, topics, totals = chat_topics(spark, folder)
    pairs = lanes.filter(F.col("label").contains(" ") & (F.col("rank") <= 20)).select(
        "room_id", F.col("rank").alias("proposal"), F.col("label").alias("title"), F.split("label", " ").alias("terms"),
        F.when(F.col("rank") % 2 == 0, F.array("label")).otherwise(F.array(F.lit("없는말"))).alias("evidence"),
    )
    out = cards.accepted_proposals(topics, pairs, kw.keyword_list(lanes), totals, 12)
    return out.withColumn("terms", F.array_join("terms", " "))


SHORT_SPAN = ", sp1 as (select room_id, sum(d) < 90 and count(*) <= 2 as short from (select room_id, strftime(ts, '%Y-%m') as mth, count(distinct cast(ts as date)) as d from m group by 1, 2) group by 1)"


@query("topics_displayed", ALL_CARDS + SHORT_SPAN + " select mg.* from mg left join sp1 using (room_id) where kind = 'theme' or not coalesce(short, false)")
def topics_displayed(spark, folder):
    from palaver.operators import activity as act
    from palaver.operators import series as ser

    spans = ser.short_span(act.daily(act.hour_counts(src.chat_messages(spark, folder))))
    return tp.displayed(chat_topics(spark, folder)[1], spans).withColumn("terms", F.array_join("terms", " "))


@query("term_jaccard", t.DOC_TK + ", mo as (select room_id, strftime(ts, '%Y-%m') as month, term, count(*) as c from tk group by 1, 2, 3), mt as (select * from mo qualify row_number() over (partition by room_id, month order by c desc, length(term) desc, term) <= 40), sz as (select room_id, month, count(*) as n from mt group by 1, 2), pr as (select x.room_id, x.month as id, y.month as other, count(*) as shared from mt x join mt y on x.room_id = y.room_id and x.term = y.term and x.month < y.month group by 1, 2, 3) select pr.room_id, id, other, shared, " + round_sql("cast(shared as double) / (a.n + b.n - shared)", 4) + " as jaccard from pr join sz a on a.room_id = pr.room_id and a.month = id join sz b on b.room_id = pr.room_id and b.month = other")
def term_jaccard(spark, folder):
    """Overlap of the top terms of the months of a room."""
    top = kw.top_period_terms(kw.period_terms(tq.doc_tokens(spark, folder), "month"), "month", 40)
    months = top.groupBy("room_id", F.col("month").alias("id")).agg(F.collect_list("term").alias("terms"))
    return tp.term_overlap(months)


# ---- vectors -----------------------------------------------------------------------------

@query("cosine", f"with d as (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i, cast(unnest(embedding) as double) as x from embeddings), c as (select label, i, avg(x) as c from d group by 1, 2) select vec_id, d.label, {round_sql('sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c))', 5)} as similarity from d join c using (label, i) group by 1, 2")
def cosine(spark, folder):
    return vec.similarity_to_centroid(src.table(spark, folder, "embeddings"), "label", "vec_id")


@query("cluster_coherence", f"with d as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, cast(unnest(embedding) as double) as x from embeddings), n as (select vec_id, sqrt(sum(x * x)) as n from d group by 1), u as (select d.vec_id, label, i, x / n as u from d join n using (vec_id)), s as (select label, i, sum(u) as s from u group by 1, 2), m as (select label, count(distinct vec_id) as size, sum(u * u) as own from u group by 1) select m.label, size, {round_sql('(sum(s * s) - max(own)) / (size * (size - 1))', 5)} as coherence from m join s using (label) group by 1, 2")
def cluster_coherence(spark, folder):
    return vec.coherence(src.table(spark, folder, "embeddings"), "label")


def _clusters(spark, folder):
    vectors = src.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return materialise(vec.kmeans(vectors, "vec_id"), "clusters")


@query("kmeans_sizes")
def kmeans_sizes(spark, folder):
    return _clusters(spark, folder).groupBy("cluster").agg(F.count("*").alias("size"))


@query("kmeans_assign", """with v as (select vec_id, cast(label as varchar) as room_id, embedding, row_number() over (partition by label order by vec_id) as place from embeddings)
, c as (select room_id, cast(place - 1 as int) as cluster, embedding as e from v where place <= 5)
select room_id, vec_id, cluster from (select v.room_id, v.vec_id, c.cluster, row_number() over (partition by v.room_id, v.vec_id order by round(list_cosine_similarity(cast(v.embedding as double[]), cast(c.e as double[])), 12) desc, c.cluster) as r
  from v join c on c.room_id = v.room_id) where r = 1""")
def kmeans_assign(spark, folder):
    """The nearest of five given centres: the first vectors of each label."""
    rows = src.table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("room_id"), "vec_id", vec.unit(F.col("embedding")).alias("u"))
    five = top_k(rows, ["room_id"], [F.asc("vec_id")], 5)
    return vec.assign(rows, vec._listed(five, "rank"), "vec_id")


@query("kmeans_per_room")
def kmeans_per_room(spark, folder):
    rows = src.table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("room_id"), F.col("vec_id").alias("line"), "embedding")
    return vec.kmeans_per_room(rows, "line").groupBy("room_id", "cluster").agg(F.count("*").alias("size"))


def _cluster_items(spark, folder):
    docs = tq.doc_tokens(spark, folder).select(F.col("line").alias("vec_id"), "tokens")
    return vec.cluster_labels(_clusters(spark, folder), docs, "vec_id", least=0.0)


@query("cluster_labels")
def cluster_labels(spark, folder):
    return _cluster_items(spark, folder).withColumn("terms", F.array_join("terms", " "))


@query("semantic_keywords")
def semantic_keywords(spark, folder):
    n = src.table(spark, folder, "embeddings").count()
    return vec.semantic_topics(vec.semantic_keywords(_cluster_items(spark, folder), n)).withColumn("terms", F.array_join("terms", " "))


# ---- samples -------------------------------------------------------------------------------

@query("hash_sample", CHAT_F1 + """, k as (select room_id, line, sender, md5('42:' || line) as h from f where not is_system and not is_boilerplate and eligible and chars >= 12)
, t as (select room_id, count(*) as n from f group by 1)
select room_id, line, sender, row_number() over (partition by k.room_id order by h, line) as sample_rank from k join t using (room_id)
qualify sample_rank <= case when n >= 100000 then 2000 when n >= 50000 then 1200 when n >= 10000 then 800 else 480 end""")
def hash_sample(spark, folder):
    totals = src.chat_messages(spark, folder, False).groupBy("room_id").agg(F.count("*").alias("total_messages"))
    return smp.text_sample(feat.message_features(src.chat_messages(spark, folder, False)), totals).drop("text")


@query("sample_sizes", CHAT_F + ", k as (select f.room_id, count(*) as n, max(total_messages) as t from f join tot using (room_id) where not is_system and not is_boilerplate and eligible and chars >= 12 group by 1) select room_id, least(n, case when t >= 100000 then 2000 when t >= 50000 then 1200 when t >= 10000 then 800 else 480 end) as sampled from k")
def sample_sizes(spark, folder):
    sample = smp.text_sample(tq.chat_features(spark, folder), tq.chat_totals(spark, folder))
    return sample.groupBy("room_id").agg(F.count("*").alias("sampled"))


@query("model_gate", f"with m as ({src.chat_sql()} union all {src.documents_sql('lang')}), s as (select room_id, count(*) as texts, sum(len(regexp_extract_all(message, '[가-힣]'))) as h, sum(len(regexp_extract_all(message, '[A-Za-z]'))) as l from m where regexp_matches(message, '[가-힣A-Za-z]') group by 1) select room_id, texts, texts >= 48 and case when texts < 8 then true when h < 24 then false when l = 0 then true else h >= l * 0.85 end as run_model from s")
def model_gate(spark, folder):
    return smp.model_gate(tq.script_profile(spark, folder))


SCORED = f", cs as (select room_id, day, line, {scrub_sql('msg')} as text, least(40, {u16_sql(scrub_sql('msg'))}) + case when has_plan then 18 else 0 end + case when has_question then 10 else 0 end + case when has_attachment then 10 else 0 end + case when has_link then 8 else 0 end + case when is_laugh then 5 else 0 end as score from f where not is_system), ct as (select *, {u16_sql('text')} as length from cs where {u16_sql('text')} >= 4 and not regexp_matches(text, '^[ㅋㅎㅠㅜ]+$')), cx as (select *, row_number() over (partition by room_id, day order by score desc, length desc, line) as rank from ct qualify rank <= 18)"


@query("context_samples", CHAT_F + SCORED + " select room_id, day, line, text, cast(score as bigint) as score, cast(length as bigint) as length, rank from cx")
def context_samples(spark, folder):
    return smp.context_samples(feat.scored_context(tq.chat_features(spark, folder)).select("room_id", "day", "line", "text", "score", "length"))
