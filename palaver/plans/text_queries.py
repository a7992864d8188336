"""Registered queries: tokens, term statistics, keyword ranking, phrases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions import tokens as tok
from palaver.functions.segment import best_cut
from palaver.operators import features as feat
from palaver.operators import keywords as kw
from palaver.operators import text_nfc
from palaver.plans import text_sql as t
from palaver.plans.chat_sql import CHAT_F, q, squeeze_sql, trim_sql, u16_sql
from palaver.plans.registry import query, round_sql
from palaver.session import materialise
from palaver.sources import tables as src
from palaver.sources.sinks import ROOM_IN_PATH, write_rooms


def doc_tokens(spark, folder, room="lang"):
    return kw.token_docs(src.document_messages(spark, folder, room), "message")


def doc_totals(spark, folder, room="lang"):
    return src.document_messages(spark, folder, room).groupBy("room_id").agg(F.count("*").alias("total_messages"))


def chat_features(spark, folder):
    return feat.message_features(src.chat_messages(spark, folder))


def chat_totals(spark, folder):
    return src.chat_messages(spark, folder).groupBy("room_id").agg(F.count("*").alias("total_messages"))


def chat_docs(spark, folder):
    return kw.token_docs(chat_features(spark, folder))


def doc_profile(spark, folder):
    return kw.script_profile(src.document_messages(spark, folder, "lang"))


def chat_profile(spark, folder):
    return kw.script_profile(src.chat_messages(spark, folder))


def doc_candidates(spark, folder):
    return kw.candidates(doc_tokens(spark, folder), doc_totals(spark, folder), profile=doc_profile(spark, folder))


def hashtag_supplement(spark, folder, features=None):
    f = chat_features(spark, folder) if features is None else features
    return kw.hashtag_counts(f, f.select("room_id", "sender").distinct())


def keyword_features(spark, folder):
    """What keywords and topics read of the features, written once."""
    return materialise(chat_features(spark, folder).select("room_id", "line", "ts", "sender", "message", "keyword_text"), "keyword-features")


def chat_lanes(spark, folder, features=None, docs=None, totals=None):
    """Keyword lanes; features, token documents and totals can be given by who reads them as well."""
    f = keyword_features(spark, folder) if features is None else features
    docs = kw.token_docs(f) if docs is None else docs
    totals = chat_totals(spark, folder) if totals is None else totals
    cands = kw.candidates(docs, totals, profile=kw.script_profile(f))
    return kw.dual_lane(cands, hashtag_supplement(spark, folder, f), totals)


@query("tokens", t.DOC_TK + "select room_id, line, string_agg(term, ' ' order by i) as tokens from tk group by 1, 2")
def tokens(spark, folder):
    return doc_tokens(spark, folder).select("room_id", "line", F.array_join("tokens", " ").alias("tokens"))


@query("tokens_korean", t.CHAT_TK + "select room_id, line, string_agg(term, ' ' order by i) as tokens from tk group by 1, 2")
def tokens_korean(spark, folder):
    return chat_docs(spark, folder).select("room_id", "line", F.array_join("tokens", " ").alias("tokens"))


@query("nfc_texts", "select conv_id, turn, nfc_normalize(regexp_replace(text, 'é', 'e' || chr(769), 'g')) as text from conversations")
def nfc_texts(spark, folder):
    """Conversations with every é written as two characters, composed again."""
    d = src.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.regexp_replace("text", "é", "é").alias("text")
    )
    return text_nfc.compose(d, "text")


@query("term_stats", t.DOC_TK + t.STATS + " select * from df")
def term_stats(spark, folder):
    return kw.term_stats(doc_tokens(spark, folder))


@query("bigram_stats", t.DOC_TK + t.STATS + " select * from bg")
def bigram_stats(spark, folder):
    return kw.bigram_stats(doc_tokens(spark, folder))


@query("keyword_thresholds", t.DOC_TK + t.STATS + f" select room_id, n_docs, n_total, {round_sql('avg_len', 6)} as avg_len, min_df, min_bigram_df from lim")
def keyword_thresholds(spark, folder):
    from palaver.functions.numeric import half_up

    d = kw.thresholds(kw.vocabulary(doc_tokens(spark, folder)), doc_totals(spark, folder), doc_profile(spark, folder))
    return d.withColumn("avg_len", half_up(F.col("avg_len"), 6))


@query("keyword_candidates", t.DOC_TK + t.CANDS + f" select room_id, label, hits, {round_sql('score', 6)} as score from cd")
def keyword_candidates(spark, folder):
    from palaver.functions.numeric import half_up

    return doc_candidates(spark, folder).withColumn("score", half_up(F.col("score"), 6))


@query("bm25", t.DOC_TK + t.CANDS + " select room_id, label, hits, row_number() over (partition by room_id order by score desc, hits desc, length(label) desc, label) as rank from cd qualify rank <= 100")
def bm25(spark, folder):
    return kw.bm25_keywords(doc_candidates(spark, folder)).drop("score")


@query("dual_lane", t.DOC_TK + t.lanes_sql(t.NO_SUPP) + " select room_id, label, hits, rank, distinctive_rank, case when freq_rank is not null and score_rank is not null then 'both' when score_rank is not null then 'bm25' else 'freq' end as lane from kw where rank <= 120 or distinctive_rank <= 120")
def dual_lane(spark, folder):
    cands = doc_candidates(spark, folder)
    none = cands.filter(F.lit(False)).select("room_id", "label", F.col("hits").alias("count"))
    return kw.dual_lane(cands, none, doc_totals(spark, folder)).drop("composite")


@query("keywords_korean", t.CHAT_KW + " select * from kl")
def keywords_korean(spark, folder):
    return kw.keyword_list(chat_lanes(spark, folder))


@query("keyword_shares", t.CHAT_KW + f" select room_id, {round_sql('max(count) filter (where rank = 1) / cast(sum(count) as double) * 100.0', 1)} as top1_percent, {round_sql('count(*) / cast(sum(count) as double) * 100.0', 1)} as richness_percent from kl group by 1")
def keyword_shares(spark, folder):
    return kw.keyword_shares(keywords_korean(spark, folder))


@query("lane_fusion_legacy", t.CHAT_TK + t.CANDS + t.HASHTAGS + f"""
, br as (select *, row_number() over (partition by room_id order by score desc, hits desc, length(label) desc, label) as r from cd)
, s1 as (select *, row_number() over (partition by room_id order by count desc, length(label) desc, label) as c from sp qualify c <= 20)
, s2 as (select room_id, label, row_number() over (partition by room_id order by c) as sr from s1 where not {t.noise_sql('label')})
, fz as (select br.room_id, br.label, hits, {round_sql('1.0 / (60 + r) + coalesce(0.85 / (60 + sr), 0)', 9)} as rrf from br left join s2 using (room_id, label))
select room_id, label, hits as count, rrf, row_number() over (partition by room_id order by hits desc, rrf desc, length(label) desc, label) as rank from fz qualify rank <= 100""")
def lane_fusion_legacy(spark, folder):
    cands = kw.candidates(chat_docs(spark, folder), chat_totals(spark, folder), profile=chat_profile(spark, folder))
    return kw.legacy_fusion(cands, hashtag_supplement(spark, folder))


@query("hashtags", t.CHAT_TK + t.HASHTAGS + " select * from sp")
def hashtags(spark, folder):
    return hashtag_supplement(spark, folder)


@query("monthly_terms", t.DOC_TK + "select room_id, strftime(ts, '%Y-%m') as month, term, count(*) as count, row_number() over (partition by room_id, strftime(ts, '%Y-%m') order by count(*) desc, length(term) desc, term) as rank from tk group by 1, 2, 3 qualify rank <= 40")
def monthly_terms(spark, folder):
    return kw.top_period_terms(kw.period_terms(doc_tokens(spark, folder), "month"), "month", 40)


@query("daily_terms", t.CHAT_TK + "select room_id, cast(ts as date) as day, term, count(*) as count, row_number() over (partition by room_id, cast(ts as date) order by count(*) desc, length(term) desc, term) as rank from tk group by 1, 2, 3 qualify rank <= 4")
def daily_terms(spark, folder):
    return kw.top_period_terms(kw.period_terms(chat_docs(spark, folder), "day"), "day", 4)


@query("topic_trend", t.CHAT_KW + ", mo as (select tk.room_id, strftime(ts, '%Y-%m') as month, tk.term, count(*) as count from tk join kl on kl.room_id = tk.room_id and kl.label = tk.term group by 1, 2, 3) select *, row_number() over (partition by room_id, month order by count desc, length(term) desc, term) as rank from mo qualify rank <= 5")
def topic_trend(spark, folder):
    return kw.topic_trend(chat_docs(spark, folder), keywords_korean(spark, folder))


HALVES = """, mo as (select room_id, strftime(ts, '%Y-%m') as month, term, count(*) as count from tk group by 1, 2, 3)
, mi as (select room_id, month, row_number() over (partition by room_id order by month) as i, count(*) over (partition by room_id) as n from (select distinct room_id, month from mo))
, hv as (select mo.room_id, case when i <= n // 2 then 'head' else 'tail' end as half, term, cast(sum(count) as bigint) as count from mo join mi using (room_id, month) where n >= 2 group by 1, 2, 3)
, ht as (select *, row_number() over (partition by room_id, half order by count desc, length(term) desc, term) as rank from hv qualify rank <= 12)
"""


@query("head_tail_terms", t.DOC_TK + HALVES + " select * from ht")
def head_tail_terms(spark, folder):
    return kw.head_tail_terms(doc_tokens(spark, folder))


@query("keyword_shift", t.DOC_TK + HALVES + ", o as (select a.* from ht a left join ht b on a.room_id = b.room_id and a.half <> b.half and a.term = b.term where b.term is null) select room_id, half, term, count, rank as list_rank, row_number() over (partition by room_id, half order by rank) as rank from o qualify row_number() over (partition by room_id, half order by o.rank) <= 8")
def keyword_shift(spark, folder):
    return kw.keyword_shift(kw.head_tail_terms(doc_tokens(spark, folder)))


LINES = f"with m as ({src.documents_sql('lang')}), ln as (select room_id, cast(ts as date) as day, {squeeze_sql(trim_sql('unnest(string_split(message, chr(10)))'))} as phrase from m), pd as (select room_id, phrase, day, count(*) as count from ln where {u16_sql('phrase')} between 12 and 180 group by 1, 2, 3)"


@query("repeated_phrases", LINES + ", p as (select room_id, phrase, cast(sum(count) as bigint) as count, arg_max(day, count * 100000 - date_diff('day', date '1970-01-01', day)) as peak_day from pd group by 1, 2 having sum(count) >= 3) select room_id, case when length(phrase) > 72 then substr(phrase, 1, 69) || '…' else phrase end as label, count, peak_day, row_number() over (partition by room_id order by count desc, phrase) as rank from p qualify rank <= 8")
def repeated_phrases(spark, folder):
    d = src.document_messages(spark, folder, "lang")
    lines = d.select("room_id", "ts", F.explode(F.split("message", "\n", -1)).alias("message"))
    return kw.repeated_phrases(kw.phrases(lines, "message"))


@query("repeated_phrases_chat", CHAT_F + f", pz as (select room_id, day, {squeeze_sql(trim_sql('msg'))} as phrase from f where not is_system and not is_boilerplate and eligible), pd as (select room_id, phrase, day, count(*) as count from pz where {u16_sql('phrase')} between 12 and 180 group by 1, 2, 3), p as (select room_id, phrase, cast(sum(count) as bigint) as count, arg_max(day, count * 100000 - date_diff('day', date '1970-01-01', day)) as peak_day from pd group by 1, 2 having sum(count) >= 3) select room_id, case when length(phrase) > 72 then substr(phrase, 1, 69) || '…' else phrase end as label, count, peak_day, row_number() over (partition by room_id order by count desc, phrase) as rank from p qualify rank <= 8")
def repeated_phrases_chat(spark, folder):
    return kw.repeated_phrases(kw.phrases(chat_features(spark, folder)))


@query("script_profile", f"with m as ({src.chat_sql()} union all {src.documents_sql('lang')}), s as (select room_id, count(*) as texts, cast(sum(len(regexp_extract_all(message, '[가-힣]'))) as bigint) as hangul, cast(sum(len(regexp_extract_all(message, '[A-Za-z]'))) as bigint) as latin from m where regexp_matches(message, '[가-힣A-Za-z]') group by 1) select *, case when texts < 8 then true when hangul < 24 then false when latin = 0 then true else hangul >= latin * 0.85 end as primarily_korean from s")
def script_profile(spark, folder):
    cols = ["room_id", "line", "ts", "sender", "message"]
    both = src.chat_messages(spark, folder).select(*cols).unionByName(src.document_messages(spark, folder, "lang").select(*cols))
    return kw.script_profile(both)


_w = "case when regexp_matches(w, '^[A-Za-z0-9_+-]+$') then lower(w) else w end"


USER_WORDS = f"with m as ({src.chat_sql()}), a as (select room_id, line, unnest(regexp_split_to_array(message, {q('[' + lex.BLANK + ']+')})) as w from m), b as (select distinct room_id, line, {t.canonical_sql('(' + _w + ')')} as word from a where regexp_matches(w, '[가-힣A-Za-z]') and length(w) between 2 and 16), c as (select room_id, word, count(*) as df from b group by 1, 2), d as (select * from c where df >= case when regexp_matches(word, '[가-힣]') then 2 else 3 end and case when regexp_matches(word, '^[A-Za-z0-9_+-]+$') then length(word) between 2 and 12 else regexp_matches(word, '[가-힣]') and length(word) between 2 and 8 end and not {t.noise_sql('word')}), uw as (select *, case when regexp_matches(word, '^[A-Za-z]') then 'SL' else 'NNP' end as tag, {round_sql('least(8.0, ln(1 + df))', 6)} as score, row_number() over (partition by room_id order by df desc, length(word) desc, word) as rank from d qualify rank <= 96)"


@query("user_words", USER_WORDS + " select * from uw")
def user_words(spark, folder):
    return kw.user_words(src.chat_messages(spark, folder))


GLUED = USER_WORDS.replace("with ", "with recursive ", 1) + """
, di as (select room_id, map(list(word order by word), list(score order by word)) as m from uw where regexp_full_match(word, '[가-힣]{2,8}') group by 1)
, ru as (select distinct room_id, unnest(regexp_extract_all(message, '[가-힣]+')) as run from m)
, pa as (select room_id, run, cast(0 as int) as i, m, [{'sum': cast(0.0 as double), 'few': cast(0 as int), 'words': cast([] as varchar[])}] as best from ru join di using (room_id) where length(run) between 3 and 32
  union all select room_id, run, i + 1, m, list_append(best, list_sort(list_append(
    list_transform(list_filter(range(1, least(8, i + 1) + 1), lambda n: map_contains(m, substr(run, i + 2 - n, n))),
      lambda n: {'sum': best[i + 2 - n].sum + m[substr(run, i + 2 - n, n)] * n, 'few': cast(best[i + 2 - n].few - 1 as int), 'words': list_append(best[i + 2 - n].words, substr(run, i + 2 - n, n))}),
    best[i + 1]), 'DESC')[1]) from pa where i < length(run))
select room_id, run, array_to_string(best[i + 1].words, ' ') as cut from pa where i = length(run)"""


@query("tokens_dictionary", GLUED)
def tokens_dictionary(spark, folder):
    """The glued Hangul of all messages, cut by the user words of its room."""
    messages = src.chat_messages(spark, folder)
    words = materialise(kw.dictionaries(None, kw.user_words(messages)), "dictionaries")
    runs = messages.select("room_id", F.explode(F.regexp_extract_all("message", F.lit("[가-힣]+"), 0)).alias("run"))
    runs = runs.where(F.length("run").between(3, 32)).distinct().join(words, "room_id")
    return runs.select("room_id", "run", F.array_join(best_cut(F.col("run"), F.col("dictionary")), " ").alias("cut"))


@query("tokenizer_diff", t.CHAT_TK + t.CANDS + """, a as (select room_id, label, row_number() over (partition by room_id order by score desc, hits desc, length(label) desc, label) as rank_a from cd qualify rank_a <= 50), b as (select room_id, label, row_number() over (partition by room_id order by hits desc, score desc, length(label) desc, label) as rank_b from cd qualify rank_b <= 50)
select coalesce(a.room_id, b.room_id) as room_id, coalesce(a.label, b.label) as label, rank_a, rank_b, case when rank_b is null then 'only_a' when rank_a is null then 'only_b' when rank_a = rank_b then 'same' else 'shared' end as status from a full join b on a.room_id = b.room_id and a.label = b.label""")
def tokenizer_diff(spark, folder):
    cands = kw.candidates(chat_docs(spark, folder), chat_totals(spark, folder), profile=chat_profile(spark, folder))
    by_hits = kw.top_k(cands, ["room_id"], kw._by_hits(), 50)
    return kw.compare_rankings(kw.bm25_keywords(cands, 50), by_hits)


@query("keyword_audit", t.CHAT_KW + ", w as (select * from (select distinct room_id from kl), (values ('자동화', 'required'), ('배포', 'required'), ('진짜', 'banned'), ('서버', 'banned')) v(label, rule)) select w.room_id, w.label, w.rule, rank, case when rule = 'required' then coalesce(rank <= 30, false) else not coalesce(rank <= 20, false) end as passed from w left join kl using (room_id, label)")
def keyword_audit(spark, folder):
    return kw.keyword_audit(keywords_korean(spark, folder), ["자동화", "배포"], ["진짜", "서버"])


@query("term_normalisation", t.CHAT_TK + f""", u as (select distinct room_id, term from tk), c as (select room_id, term, {t.canonical_sql('term')} as c from u), s as (select *, case when length(c) > 2 and regexp_matches(c, {q(lex.PARTICLE)}) and length(regexp_replace(c, {q(lex.PARTICLE)}, '')) >= 2 then regexp_replace(c, {q(lex.PARTICLE)}, '') else c end as st from c)
select room_id, term, coalesce(x.v, y.v, st) as topic_term, {t.noise_sql('term')} as noise, {t.discourse_sql('term')} as discourse from s left join (values {', '.join(f"('{k}', '{v}')" for k, v in lex.TERM_ALIASES.items())}) x(k, v) on x.k = s.c left join (values {', '.join(f"('{k}', '{v}')" for k, v in lex.TERM_ALIASES.items())}) y(k, v) on y.k = s.st""")
def term_normalisation(spark, folder):
    terms = kw.term_stats(chat_docs(spark, folder)).select("room_id", "term")
    return terms.select(
        "room_id", "term", tok.normalise_term(F.col("term")).alias("topic_term"),
        tok.is_noise(F.col("term")).alias("noise"), tok.is_discourse(F.col("term")).alias("discourse"),
    )


# ---- exports: the conversations written as export lines and read back --------------------

@query("record_assembly", f"select room_id, ts, sender, message from ({src.CONVERSATIONS_SQL})")
def record_assembly(spark, folder):
    """Records out of dated lines and continuation lines."""
    from palaver.sources.chat_export import messages_from_lines

    m = src.conversation_messages(spark, folder)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.when(F.col("message").contains("\n"), F.col("message")).otherwise(quoted(F.col("message")))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), quoted(F.col("sender")), F.lit(","), body)
    parts = m.select("room_id", "line", F.posexplode(F.split(text, "\n", -1)).alias("i", "value"))
    lines = parts.select("room_id", (F.col("line") * 100_000 + F.col("i")).alias("line"), "value")
    return messages_from_lines(lines).drop("line")


def _export_files(spark, folder, spoil=False):
    """The conversations as one export file per room in the shared folder; returns its lines."""
    from palaver.session import work_dir
    from palaver.sources import export_lines as ex

    m = src.conversation_messages(spark, folder)
    odd = F.col("room_id").cast("long") % 10 if spoil else F.lit(-1)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.when(F.col("message").contains("\n"), F.col("message")).otherwise(quoted(F.col("message")))
    day = F.when(odd == 5, F.lit("2024-13-01 00:00:00")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    sender = F.when(odd == 6, F.concat(F.lit('"'), "sender")).otherwise(quoted(F.col("sender")))
    text = F.concat(day, F.lit(","), sender, F.lit(","), F.when(odd == 6, "x").otherwise(body))
    parts = m.select("room_id", "line", F.posexplode(F.split(text, "\n", -1)).alias("i", "value"))
    rooms = m.select("room_id").distinct()
    head = rooms.select("room_id", F.lit(-2).cast("long").alias("line"), F.lit(0).alias("i"), F.when(odd == 3, "Datum,User,Message").otherwise("Date,User,Message").alias("value"))
    stray = rooms.filter(odd == 4).select("room_id", F.lit(-1).cast("long").alias("line"), F.lit(0).alias("i"), F.lit("stray line").alias("value"))
    base = f"{work_dir(spark)}/exports-{uuid.uuid4().hex}"
    write_rooms(parts.unionByName(head).unionByName(stray), base)
    return ex.text_lines(ex.raw_lines(spark, base))


@query("export_scan", f"select room_id, ts, sender, message from ({src.CONVERSATIONS_SQL})")
def export_scan(spark, folder):
    """Conversations written as export files, read back through Spark's file layer."""
    from palaver.sources import export_lines as ex

    return ex.records(_export_files(spark, folder), F.regexp_extract("path", ROOM_IN_PATH, 1)).drop("line")


@query("export_scan_since", f"select room_id, ts, sender, message from ({src.CONVERSATIONS_SQL}) where ts >= timestamp '2024-01-05 00:00:00'")
def export_scan_since(spark, folder):
    """The same from a day on: older records leave before their lines are gathered."""
    from palaver.sources import export_lines as ex

    return ex.records(_export_files(spark, folder), F.regexp_extract("path", ROOM_IN_PATH, 1), since="2024-01-05").drop("line")


@query("export_warnings", f"""with m as ({src.CONVERSATIONS_SQL}), r as (select room_id, cast(room_id as bigint) % 10 as odd, count(*) as n from m group by 1, 2)
select room_id, 'unexpected_header' as code, cast(1 as bigint) as count from r where odd = 3 union all select room_id, 'continuation_without_record', 1 from r where odd = 4
union all select room_id, 'invalid_date', n from r where odd = 5 union all select room_id, 'sender_parse_error', n from r where odd = 6""")
def export_warnings(spark, folder):
    """The same with spoilt headers, dates, senders and stray lines in some rooms."""
    from palaver.sources import export_lines as ex

    found = ex.warnings(_export_files(spark, folder, True), F.regexp_extract("path", ROOM_IN_PATH, 1))
    return found.groupBy("room_id", "code").agg(F.count("*").alias("count"))


@query("export_profile", f"with m as ({src.CONVERSATIONS_SQL}) select room_id, count(*) as messages, count(distinct sender) as participants, arg_min(ts, line) as first_ts, arg_max(ts, line) as last_ts, cast(count(*) filter (where contains(message, chr(10))) as bigint) as multiline from m group by 1")
def export_profile(spark, folder):
    from palaver.sources.chat_export import export_profile as profile

    return profile(src.conversation_messages(spark, folder))


@query("embedding_texts", "select conv_id, turn, case when regexp_matches(ltrim(text), '^(query:|passage:)') then text else 'query: ' || text end as text from conversations")
def embedding_texts(spark, folder):
    from palaver.functions.text import embedding_text

    d = src.table(spark, folder, "conversations")
    return d.select("conv_id", "turn", embedding_text(F.col("text"), "query:").alias("text"))
