"""Registered queries: notices, flags, links, tone (Korean room derived from events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as text_fn
from palaver.functions import tone as tone_fn
from palaver.operators import activity as act
from palaver.operators import features as feat
from palaver.operators import inequality as ineq
from palaver.operators import room_events as ev
from palaver.operators import tone as tn
from palaver.functions import lexicon as lex
from palaver.plans.chat_sql import CHAT_F, EMO, TONE, domains_sql, scrub_sql, u16_sql
from palaver.plans.registry import pct_sql, query, round_sql
from palaver.sources import tables as src


def _features(spark, folder):
    return feat.message_features(src.chat_messages(spark, folder))


def _totals(cells):
    return act.room_summary(cells).select("room_id", "total_messages")


@query("notice_split", CHAT_F + "select room_id, line, msg, is_system, array_to_string(notices, ',') as notices, array_to_string(tags, ',') as tags from f")
def notice_split(spark, folder):
    return _features(spark, folder).select(
        "room_id", "line", "msg", "is_system", F.array_join("notices", ",").alias("notices"), F.array_join("tags", ",").alias("tags")
    )


FLAGS = ["has_link", "has_attachment", "has_question", "is_laugh", "is_pure_laugh", "is_short", "has_plan", "has_emoji", "is_night", "is_weekend", "is_boilerplate"]


@query("msg_flags", CHAT_F + f"select room_id, line, chars, {', '.join(FLAGS)}, case when not is_system and not is_boilerplate and eligible then msg end as keyword_text from f")
def msg_flags(spark, folder):
    return _features(spark, folder).select("room_id", "line", "chars", *FLAGS, "keyword_text")


N = ", n as (select room_id, day, unnest(notices) as kind from f), nd as (select room_id, day, kind, count(*) as notices from n group by 1, 2, 3)"


@query("notices", CHAT_F + N + "select * from nd")
def notices(spark, folder):
    return ev.notice_days(_features(spark, folder))


_kinds = ", ".join(f"cast(coalesce(sum(notices) filter (where kind = '{k}'), 0) as bigint) as {k}" for k in lex.NOTICE_KINDS)
EVENTS = N + f", ec as (select room_id, {_kinds}, cast(sum(notices) as bigint) as all_notices from nd group by 1), re as (select ec.room_id, total_messages, {', '.join(lex.NOTICE_KINDS)}, all_notices, " + ", ".join(f"{pct_sql(k, 'total_messages', 2)} as {k}_percent" for k in ("join", "leave", "deleted", "hidden", "kick")).replace("cast(join as", 'cast("join" as') + " from ec join tot using (room_id))"
EVENTS = EVENTS.replace("as join,", 'as "join",').replace(", join, leave", ', "join", leave').replace("total_messages, join,", 'total_messages, "join",')


@query("room_events", CHAT_F + EVENTS + " select * from re")
def room_events(spark, folder):
    f = _features(spark, folder)
    return ev.room_events(ev.notice_days(f), _totals(act.sender_day(f)))


PULSE = N + ", dd as (select distinct room_id, day from f), fs as (select room_id, sender, arg_min(day, line) as day from f group by 1, 2), ns as (select room_id, day, count(*) as n from fs group by 1, 2), pu as (select dd.room_id, dd.day, " + ", ".join(
    f"coalesce(sum(notices) filter (where kind = '{k}'), 0)::bigint as \"{k}\"" for k in ("join", "leave", "hidden", "kick")
) + ", coalesce(max(n), 0) as new_senders from dd left join nd using (room_id, day) left join ns on ns.room_id = dd.room_id and ns.day = dd.day group by 1, 2)"


@query("room_pulse", CHAT_F + PULSE + " select * from pu")
def room_pulse(spark, folder):
    f = _features(spark, folder)
    cells = act.sender_day(f)
    return ev.room_pulse(act.daily(cells, "all_messages"), ev.notice_days(f), act.first_appearances(cells))


@query("pulse_sums", CHAT_F + N + "select room_id, day, cast(sum(notices) as bigint) as pulse from nd where kind in ('join', 'leave', 'hidden', 'kick') group by 1, 2")
def pulse_sums(spark, folder):
    return ev.pulse_sums(room_pulse(spark, folder))


@query("open_room_profile", CHAT_F + EVENTS + f"""
, v as (select room_id, total_messages as t, ("join" + leave) / cast(total_messages as double) * 100 as mv, all_notices / cast(total_messages as double) * 100 as sy, case when shopSearch > 0 then 0.15 else 0 end as se from re)
, z as (select *, least(1.0, mv / 12 + sy / 40 + se) as sc from v)
select room_id, t >= 30 and (sc >= 0.45 or mv >= 8) as likely_open, case when t >= 30 then {round_sql('sc', 2)} else 0.0 end as score, case when t >= 30 then {round_sql('mv', 1)} else 0.0 end as join_leave_percent from z""")
def open_room_profile(spark, folder):
    return ev.open_room_profile(room_events(spark, folder))


@query("search_tags", CHAT_F + ", g as (select room_id, unnest(tags) as tag from f) select room_id, tag, count(*) as count, row_number() over (partition by room_id order by count(*) desc, tag) as rank from g group by 1, 2 qualify rank <= 30")
def search_tags(spark, folder):
    return ev.search_tags(_features(spark, folder))


@query("search_audit", CHAT_F + ", g as (select room_id, unnest(tags) as tag from f), u as (select room_id, count(distinct tag) as unique_tags from g group by 1) select f.room_id, cast(sum(len(list_filter(notices, lambda k: k = 'shopSearch'))) as bigint) as search_notices, cast(sum(len(tags)) as bigint) as tag_extractions, count(*) filter (where len(tags) = 0) as untagged_notices, coalesce(max(unique_tags), 0) as unique_tags from f left join u using (room_id) where list_contains(notices, 'shopSearch') group by 1")
def search_audit(spark, folder):
    return ev.search_audit(_features(spark, folder))


@query("search_misses", CHAT_F + "select room_id, row_number() over (partition by room_id order by line) as rank, line, message as sample from f where list_contains(notices, 'shopSearch') and len(tags) = 0 qualify rank <= 8")
def search_misses(spark, folder):
    return ev.search_misses(_features(spark, folder))


@query("attachments", CHAT_F + ", g as (select room_id, unnest(markers) as marker from f where not is_system) select room_id, marker, count(*) as count, row_number() over (partition by room_id order by count(*) desc, marker) as rank from g group by 1, 2 qualify rank <= 30")
def attachments(spark, folder):
    return ev.attachment_counts(_features(spark, folder))


@query("photo_share", CHAT_F + f"select room_id, {pct_sql('''count(*) filter (where list_contains(markers, '사진'))''', 'sum(len(markers))')} as photo_percent from f where not is_system and has_attachment group by 1")
def photo_share(spark, folder):
    return ev.photo_share(_features(spark, folder))


@query("link_spikes", CHAT_F + "select room_id, day, count(*) as links, row_number() over (partition by room_id order by count(*) desc, day) as rank from f where not is_system and has_link group by 1, 2 having count(*) >= 3 qualify rank <= 6")
def link_spikes(spark, folder):
    return ev.link_spikes(act.sender_day(_features(spark, folder)))


@query("plan_days", CHAT_F + "select room_id, day, count(*) as hits from f where not is_system and has_plan group by 1, 2")
def plan_days(spark, folder):
    return ev.plan_days(act.sender_day(_features(spark, folder)))


PEOPLE_COLS = {
    "messages": "true", "night_messages": "is_night", "attachment_messages": "has_attachment",
    "link_messages": "has_link", "laugh_messages": "is_laugh", "short_messages": "is_short",
}
_people = ", ".join(f"count(*) filter (where not is_system and {c}) as {n}" for n, c in PEOPLE_COLS.items())
PEOPLE = f""", pp as (select room_id, sender, min(line) as first_line, count(*) as am, {_people}, cast(coalesce(sum(chars) filter (where not is_system), 0) as bigint) as characters from f group by 1, 2)
, pt as (select room_id, sum(am) as tm, sum(characters) as tc from pp group by 1)
, pe as (select pp.* exclude (am), {round_sql('characters / greatest(messages, 1)', 1)} as average_length, {pct_sql('messages', 'tm')} as share_percent, {pct_sql('characters', 'tc')} as character_share_percent from pp join pt using (room_id))"""


@query("participant_flags", CHAT_F + PEOPLE + " select * from pe")
def participant_flags(spark, folder):
    return act.participants(act.sender_day(_features(spark, folder)))


@query("tone_rates", CHAT_F + ", s as (select room_id, " + ", ".join(
    f"count(*) filter (where not is_system and {c}) as {n}_messages" for n, c in (("laugh", "is_laugh"), ("short", "is_short"), ("emoji", "has_emoji"), ("pure_laugh", "is_pure_laugh"))
) + f" from f group by 1) select s.*, {pct_sql('laugh_messages', 'total_messages')} as laugh_per_100, {pct_sql('short_messages', 'total_messages')} as short_per_100, {pct_sql('emoji_messages', 'total_messages')} as emoji_per_100, {pct_sql('pure_laugh_messages', 'total_messages')} as pure_laugh_percent from s join tot using (room_id)")
def tone_rates(spark, folder):
    return act.tone_rates(act.room_summary(act.sender_day(_features(spark, folder))))


@query("room_summary_chat", CHAT_F + f"""
, s as (select room_id, count(*) as t, cast(coalesce(sum(chars) filter (where not is_system), 0) as bigint) as c, """ + ", ".join(
    f"count(*) filter (where not is_system and {c}) as {n}" for n, c in (("link_messages", "has_link"), ("attachment_messages", "has_attachment"), ("question_messages", "has_question"))
) + f" from f group by 1) select room_id, t as total_messages, {round_sql('c / t', 1)} as average_length, link_messages, attachment_messages, question_messages, {pct_sql('link_messages', 't', 2)} as links_per_100, {pct_sql('attachment_messages', 't', 2)} as attachments_per_100, {pct_sql('question_messages', 't', 2)} as questions_per_100 from s")
def room_summary_chat(spark, folder):
    return act.room_summary(act.sender_day(_features(spark, folder))).select(
        "room_id", "total_messages", "average_length", "link_messages", "attachment_messages", "question_messages",
        "links_per_100", "attachments_per_100", "questions_per_100",
    )


# ---- links ---------------------------------------------------------------------------

PAGES = f"with d as (select 'pages' as room_id, unnest({domains_sql('url')}) as domain from pages), c as (select room_id, domain, count(*) as count from d group by 1, 2)"


def _page_domains(spark, folder):
    pages = src.page_links(spark, folder)
    hosts = pages.select("room_id", F.explode(text_fn.domains(F.col("message"))).alias("domain"))
    return hosts.groupBy("room_id", "domain").agg(F.count("*").alias("count"))


@query("domains", PAGES + "select *, row_number() over (partition by room_id order by count desc, domain) as rank from c qualify rank <= 30")
def domains(spark, folder):
    return ev.top_domains(_page_domains(spark, folder))


@query("chat_domains", CHAT_F + "select room_id, domain, count(*) as count, row_number() over (partition by room_id order by count(*) desc, domain) as rank from (select room_id, unnest(domains) as domain from f where not is_system) group by 1, 2 qualify rank <= 30")
def chat_domains(spark, folder):
    return ev.top_domains(ev.domain_counts(_features(spark, folder)))


@query("domain_entropy", PAGES + f", p as (select *, count / sum(count) over (partition by room_id) as p from c) select room_id, count(*) as labels, {round_sql('-sum(p * log2(p))', 2)} as entropy_bits from p group by 1")
def domain_entropy(spark, folder):
    return ineq.entropy_bits(_page_domains(spark, folder))


# ---- tone ------------------------------------------------------------------------------

def _tone(spark, folder):
    return tn.tone_cells(feat.with_tone(_features(spark, folder)))


@query("emoji_counts", CHAT_F + EMO + "select room_id, category, cast(sum(c) as bigint) as count from e group by 1, 2")
def emoji_counts(spark, folder):
    return tn.emoji_categories(tn.emoji_cells(_features(spark, folder)))


@query("top_emojis", CHAT_F + EMO + "select room_id, emoji, cast(sum(c) as bigint) as count, row_number() over (partition by room_id order by sum(c) desc, emoji) as rank from e group by 1, 2 qualify rank <= 5")
def top_emojis(spark, folder):
    return tn.top_emojis(tn.emoji_cells(_features(spark, folder)))


@query("sender_emojis", CHAT_F + EMO + """, r as (select *, row_number() over (partition by room_id, sender order by c desc, emoji) as rn from e), k as (select room_id, sender, category, sum(c) as c, row_number() over (partition by room_id, sender order by sum(c) desc, category) as rn from e group by 1, 2, 3)
select a.room_id, a.sender, a.emojis, a.top_emojis, k.category as dominant_category from (select room_id, sender, cast(sum(c) as bigint) as emojis, string_agg(emoji, ' ' order by rn) filter (where rn <= 3) as top_emojis from r group by 1, 2) a join k on k.room_id = a.room_id and k.sender = a.sender and k.rn = 1""")
def sender_emojis(spark, folder):
    return tn.sender_emojis(tn.emoji_cells(_features(spark, folder)))


LEVELS = """, q0 as (select room_id, sender, count(*) filter (where style = 'honorific') as honorific, count(*) filter (where style = 'casual') as casual, count(*) as samples from w group by 1, 2)
, q1 as (select *, honorific + casual as st, case when honorific + casual > 0 then cast(honorific as double) / (honorific + casual) else 0.0 end as honorific_ratio, case when honorific + casual > 0 then cast(casual as double) / (honorific + casual) else 0.0 end as casual_ratio from q0)
, lv as (select room_id, sender, honorific, casual, samples, honorific_ratio, casual_ratio, cast(samples - st as double) / samples as neutral_ratio, case when st < 3 or cast(st as double) / samples < 0.25 then 'insufficient' when honorific_ratio >= 0.7 then 'honorific' when casual_ratio >= 0.7 then 'casual' else 'mixed' end as style from q1)"""


@query("speech_level", CHAT_F + TONE + LEVELS + " select * from lv")
def speech_level(spark, folder):
    return tn.speech_levels(_tone(spark, folder))


@query("room_relationship", CHAT_F + TONE + LEVELS + """, g as (select room_id, sum(honorific) as h, sum(casual) as c, count(*) as n, count(*) filter (where style = 'honorific') as honorific_senders, count(*) filter (where style = 'casual') as casual_senders from lv group by 1)
select room_id, honorific_senders, casual_senders, case when h + c > 0 and h / (h + c) >= 0.7 then 'formal' when h + c > 0 and c / (h + c) >= 0.7 then 'casual' else 'mixed' end as room_style,
 case when honorific_senders / n >= 0.7 then 'formal' when casual_senders / n >= 0.7 then 'friendly' when honorific_senders > 0 and casual_senders > 0 then 'hierarchical' else 'mixed' end as relationship from g""")
def room_relationship(spark, folder):
    return tn.room_relationship(tn.speech_levels(_tone(spark, folder)))


@query("lexicon_sentiment", CHAT_F + TONE + f""", s as (select room_id, day, sum(positive) as p, sum(negative) as n, sum(neutral) as u from w group by 1, 2), dd as (select distinct room_id, day from f)
, z as (select dd.room_id, dd.day, coalesce(p, 0) as p, coalesce(n, 0) as n, coalesce(p + n + u, 0) as t from dd left join s using (room_id, day))
, y as (select room_id, day, case when t > 0 then {pct_sql('p', 't')} else 0.0 end as positive, case when t > 0 then {pct_sql('n', 't')} else 0.0 end as negative, t, p, n from z)
select room_id, day, positive, negative, case when t > 0 then {round_sql('100.0 - positive - negative', 1)} else 100.0 end as neutral, case when t > 0 then floor((p - n) / cast(t as double) * 100 + 0.5) / 1.0 else 0.0 end as energy from y""")
def lexicon_sentiment(spark, folder):
    f = _features(spark, folder)
    return tn.daily_sentiment(tn.tone_cells(feat.with_tone(f)), act.daily(act.sender_day(f), "all_messages"))


PROF = ", g as (select room_id, sender, cast(sum(profanity) as bigint) as hits, count(*) filter (where profanity > 0) as messages_with_hits from w group by 1, 2)"


@query("profanity", CHAT_F + TONE + PROF + f" select room_id, cast(sum(hits) as bigint) as hits, cast(sum(messages_with_hits) as bigint) as messages_with_hits, {pct_sql('sum(messages_with_hits)', 'max(total_messages)', 2)} as per_100_messages from g join tot using (room_id) group by 1")
def profanity(spark, folder):
    f = _features(spark, folder)
    return tn.profanity_stats(tn.tone_cells(feat.with_tone(f)), _totals(act.sender_day(f)))


@query("profanity_senders", CHAT_F + TONE + PROF + " select *, row_number() over (partition by room_id order by hits desc, messages_with_hits desc, sender) as rank from g where hits > 0 qualify rank <= 8")
def profanity_senders(spark, folder):
    return tn.profanity_senders(_tone(spark, folder))


# ---- scored samples: the labels table stands for a classifier's output -------------------

SCORED = "with s as (select source as room_id, lang as sender, case when toxic = 1 then 'toxic' else 'clean' end as raw, case when quality = 1 then 0.9 else 0.65 end as score from labels join documents using (doc_id))"


def _scored(spark, folder):
    labels = src.table(spark, folder, "labels")
    docs = src.table(spark, folder, "documents").select("doc_id", "source", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("source").alias("room_id"), F.col("lang").alias("sender"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("raw"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.65).alias("score"),
    )


@query("toxicity_stats", SCORED + f", p as (select room_id, case when raw = 'toxic' then floor(score * 1000 + 0.5) / 10 else floor((1.0::double - score) * 30 + 0.5) / 10 end as p from s) select room_id, count(*) as sample, {round_sql('sum(cast(floor(p * 10 + 0.5) as bigint)) / count(*) / 10.0', 1)} as toxic_percent, count(*) filter (where p >= 50) as toxic_messages, {round_sql('100.0 - ' + round_sql('sum(cast(floor(p * 10 + 0.5) as bigint)) / count(*) / 10.0', 1), 1)} as neutral_percent from p group by 1")
def toxicity_stats(spark, folder):
    return tn.toxicity_from_scores(_scored(spark, folder).withColumnRenamed("raw", "label"))


LABELLED = ", l as (select room_id, sender, case when score < 0.72 then 'neutral' when raw = 'toxic' then 'negative' else 'positive' end as label from s)"
_c = lambda l: f"count(*) filter (where label = '{l}')"


def _labelled(spark, folder):
    raw = F.when(F.col("raw") == "toxic", "negative").otherwise("positive")
    s = _scored(spark, folder)
    return s.select("room_id", "sender", tone_fn.sentiment_label(raw, F.col("score"), binary=True).alias("label"))


@query("sentiment_stats", SCORED + LABELLED + f" select room_id, count(*) as sample, {pct_sql(_c('positive'), 'count(*)')} as positive_percent, {pct_sql(_c('negative'), 'count(*)')} as negative_percent, {pct_sql(_c('neutral'), 'count(*)')} as neutral_percent, {round_sql('(' + _c('positive') + ' - ' + _c('negative') + ') / cast(count(*) as double) * 100.0', 1)} as compound from l group by 1")
def sentiment_stats(spark, folder):
    return tn.sentiment_stats(_labelled(spark, folder))


@query("sentiment_by_sender", SCORED + LABELLED + f", g as (select room_id, sender, count(*) as sample, {pct_sql(_c('positive'), 'count(*)')} as positive_percent, {pct_sql(_c('negative'), 'count(*)')} as negative_percent from l group by 1, 2) select *, row_number() over (partition by room_id order by sample desc, positive_percent desc, sender) as rank from g qualify rank <= 12")
def sentiment_by_sender(spark, folder):
    return tn.sentiment_by_sender(_labelled(spark, folder))


@query("toxicity_lexicon", CHAT_F + TONE + f", g as (select room_id, count(*) as sample, count(*) filter (where profanity > 0) as toxic_messages from w group by 1) select *, {pct_sql('toxic_messages', 'sample')} as toxic_percent, {round_sql('100.0 - ' + pct_sql('toxic_messages', 'sample'), 1)} as neutral_percent from g")
def toxicity_lexicon(spark, folder):
    texts = _features(spark, folder).filter(~F.col("is_system") & ~F.col("is_boilerplate"))
    return tn.toxicity_from_lexicon(texts)


@query("scrub", f"with s as (select doc_id, {scrub_sql('text')} as t from documents) select doc_id, t as clean_text, case when length(t) > 56 then substr(t, 1, 55) || '…' else t end as evidence from s")
def scrub(spark, folder):
    d = src.table(spark, folder, "documents")
    return d.select("doc_id", text_fn.scrub(F.col("text")).alias("clean_text"), text_fn.evidence(F.col("text")).alias("evidence"))


@query("utf16_lengths", f"select doc_id, {u16_sql('text')} as units from documents")
def utf16_lengths(spark, folder):
    return src.table(spark, folder, "documents").select("doc_id", text_fn.utf16_length(F.col("text")).alias("units"))
