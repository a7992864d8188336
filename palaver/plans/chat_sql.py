"""SQL text (RE2 dialect) of the message features, for the checking engine."""

from __future__ import annotations

from palaver.functions import lexicon as lex
from palaver.sources import tables as src

WS = lex.BLANK


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def squeeze_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(f'[{WS}]+')}, ' ', 'g')"


def u16_sql(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


URL_RE2 = lex.URL.replace("(?<![A-Za-z0-9_])", r"\b")


def domains_sql(x: str) -> str:
    return (
        f"list_transform(regexp_extract_all({x}, {q(URL_RE2)}), lambda u: regexp_replace(lower(regexp_extract(u, "
        "'^(?:https?://)?([^/:?#]+)', 1)), '^www\\.', ''))"
    )


def scrub_sql(x: str) -> str:
    for pattern, word in lex.SCRUB:
        x = f"regexp_replace({x}, {q(pattern)}, '{word}', 'g')"
    return trim_sql(squeeze_sql(x))


def _kind() -> str:
    out = "case "
    for name, pattern in lex.NOTICE_PATTERNS:
        gift = f" and not regexp_matches(t, {q(lex.GIFT_LINE)})" if name == "kick" else ""
        out += f"when regexp_matches(t, {q(pattern)}){gift} then '{name}' "
    return out + "end"


def _tag() -> str:
    raw = f"coalesce(nullif(regexp_extract(t, '^샵검색[:\\s]+(.+)$', 1), ''), regexp_extract(t, '^(#\\S{{2,80}})$', 1))"
    raw = f"substr({trim_sql(raw)}, 1, 80)"
    return f"case when {raw} = '' then null when starts_with({raw}, '#') then {raw} else '#' || {raw} end"


def features_sql(base: str) -> str:
    """``with ... f`` over messages ``base``: one row per message like message_features."""
    tail = q(f',[{WS}]*"",[{WS}]*"')
    clean = f"""regexp_replace(regexp_replace(raw, {tail}, '', 'g'), '"$', '')"""
    line = squeeze_sql(f"""regexp_replace({trim_sql(clean)}, '^"+|"+$', '', 'g')""")
    marks = "[" + ", ".join(f"'{m}'" for m in lex.ATTACHMENT_MARKERS) + "]"
    t = trim_sql("msg")
    return f"""with m as ({base})
, l0 as (select room_id, line, unnest(range(1, len(p) + 1)) as i, unnest(p) as raw from (select *, string_split(message, chr(10)) as p from m))
, l1 as (select room_id, line, i, raw, {line} as t from l0)
, l2 as (select *, {_kind()} as kind from l1 where t <> '')
, l3 as (select *, case when kind = 'shopSearch' then {_tag()} end as tag from l2)
, l4 as (select room_id, line, coalesce({trim_sql("string_agg(raw, chr(10) order by i) filter (where kind is null)")}, '') as user_text,
   coalesce(list(kind order by i) filter (where kind is not null), cast([] as varchar[])) as kinds,
   coalesce(list(tag order by i) filter (where tag is not null), cast([] as varchar[])) as tags from l3 group by 1, 2)
, l5 as (select m.*, case when user_text <> '' then user_text else message end as msg, tags,
   case when user_text <> '' and list_has_any(kinds, ['hidden', 'deleted']) then list_concat(list_filter(kinds, lambda k: k not in ('hidden', 'deleted')), ['hidden']) else kinds end as notices,
   len(kinds) > 0 and user_text = '' as is_system from m join l4 using (room_id, line))
, f0 as (select *, cast(ts as date) as day, cast(hour(ts) as int) as hour, list_filter({marks}, lambda k: contains(msg, k)) as markers,
   case when regexp_matches(msg, {q(lex.LINK_HINT)}) then {domains_sql("msg")} else cast([] as varchar[]) end as domains from l5)
, f as (select *, {u16_sql("msg")} as chars, len(domains) > 0 as has_link, len(markers) > 0 as has_attachment,
   contains(msg, '?') or contains(msg, '？') as has_question, regexp_matches(msg, {q(lex.LAUGH)}) as is_laugh,
   regexp_matches({t}, {q(lex.PURE_LAUGH)}) as is_pure_laugh, {u16_sql(t)} between 1 and 3 as is_short,
   regexp_matches(msg, {q(lex.PLAN_SIGNAL)}) as has_plan, regexp_matches(msg, {q(lex.PICTOGRAPH)}) as has_emoji,
   hour in (23, 0, 1, 2, 3, 4, 5) as is_night, dayofweek(ts) in (0, 6) as is_weekend,
   {u16_sql(squeeze_sql(t))} >= 24 and (regexp_matches({squeeze_sql(t)}, {q(lex.WELCOME_TEXT)}) or (regexp_matches({squeeze_sql(t)}, {q(lex.RULES_TEXT)}) and {u16_sql(squeeze_sql(t))} >= 48)) as is_boilerplate,
   {u16_sql("msg")} >= 2 and regexp_matches(msg, {q(lex.LETTER)}) and {t} <> '' and not (len(markers) = 1 and {t} = markers[1])
     and not (len(markers) > 0 and {u16_sql(t)} <= 16 and not regexp_matches(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '[가-힣A-Za-z]{{3,}}')) as eligible
   from f0)
, tot as (select room_id, count(*) as total_messages from m group by 1)
"""


CHAT_F = features_sql(src.chat_sql())
CHAT_F1 = features_sql(src.chat_sql(False))

_pos = f"(len(regexp_extract_all(msg, {q('(?:' + chr(92) + 'b|[^가-힣A-Za-z])(?:ㅋㅋ|ㅎㅎ|ㅋㅎ|ㅎㅋ)(?:' + chr(92) + 'b|[^가-힣A-Za-z])')})) + len(regexp_extract_all(msg, {q('|'.join(lex.POSITIVE_WORDS))})))"
_neg = f"len(regexp_extract_all(msg, {q('|'.join(lex.NEGATIVE_WORDS))}))"
_sq = f"lower(regexp_replace(msg, {q(f'[{WS}' + chr(92) + 'x{200B}-' + chr(92) + 'x{200D}]+')}, '', 'g'))"
_prof = " + ".join(f"cast((length(s) - length(replace(s, '{p}', ''))) / {len(p)} as int)" for p in lex.PROFANITY)
_t = trim_sql("msg")
_hon = " or ".join(f"regexp_matches({_t}, {q(p)})" for p in lex.HONORIFIC)
_cas = " or ".join(f"regexp_matches({_t}, {q(p)})" for p in lex.CASUAL)

TONE = f"""
, w0 as (select *, {_pos} as positive, {_neg} as negative, {_sq} as s, ({_hon}) as hon, ({_cas}) as cas from f where not is_system and not is_boilerplate)
, w as (select *, case when positive + negative = 0 then 1 else 0 end as neutral, {_prof} as profanity,
   case when hon and not cas then 'honorific' when cas and not hon then 'casual' else 'neutral' end as style from w0)
"""

_cat = "case emoji " + " ".join(f"when '{m}' then '{cat}'" for m, cat in lex.EMOJI_CATEGORY.items()) + " else 'neutral' end"
EMO = f"""
, e0 as (select room_id, sender, unnest(regexp_extract_all(msg, {q(lex.EMOJI)})) as emoji from f where not is_system and has_emoji)
, e as (select room_id, sender, emoji, {_cat} as category, count(*) as c from e0 group by 1, 2, 3, 4)
"""
