"""SQL text of tokens, term statistics and keyword ranking for the checking engine."""

from __future__ import annotations

from palaver.functions import lexicon as lex
from palaver.operators.keywords import STOP_TERMS
from palaver.plans.chat_sql import CHAT_F, q
from palaver.plans.registry import round_sql
from palaver.sources import tables as src

ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789ㅋㅎㅠㅜ"


def words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def canonical_sql(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in lex.CANONICAL_TERMS.items())
    return f"case when regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*$') then case lower({x}) {cases} else lower({x}) end else {x} end"


def tokens_sql(base: str, text: str) -> str:
    """CTE chain from ``base``(room_id, line, ts, sender, <text>) to tk(room_id, line, i, term)."""
    chars = "[" + ", ".join(f"'{c}'" for c in ALNUM) + "]"
    collapsed = f"list_reduce({chars}, lambda x, c: regexp_replace(x, c || '{{4,}}', c || c, 'g'), {text})"
    plain = "case when regexp_matches(w, '^[A-Za-z0-9_+-]+$') then lower(w) else w end"
    return f"""
, t0 as (select room_id, line, ts, sender, string_split(trim(regexp_replace(regexp_replace({collapsed}, '[^가-힣a-zA-Z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' ') as ws from {base} where {text} is not null)
, t1 as (select room_id, line, ts, sender, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from t0)
, t2 as (select * exclude (w), {canonical_sql(f"({plain})")} as term from t1)
, t3 as (select * from t2 where length(term) between 2 and 32 and regexp_matches(term, '[가-힣A-Za-z]'))
, t4 as (select * from t3 union all select room_id, line, ts, sender, p + 0.5, {canonical_sql("stem")} from (select *, regexp_replace(term, {q(lex.GLUED_ENDING)}, '') as stem from t3 where regexp_matches(term, '[가-힣]{{6,}}')) where length(stem) >= 2 and stem <> term)
, t5 as (select room_id, line, ts, sender, term, min(p) as p from t4 group by all)
, tk as (select room_id, line, ts, sender, term, row_number() over (partition by room_id, line order by p) as i from t5)
"""


def stem_sql(x: str) -> str:
    once = f"regexp_replace({x}, {q(lex.CHAT_ENDING)}, '')"
    one = f"(case when length({once}) >= 2 then {once} else {x} end)"
    twice = f"regexp_replace({one}, {q(lex.CHAT_ENDING)}, '')"
    return f"(case when length({twice}) >= 2 then {twice} else {one} end)"


def discourse_sql(x: str) -> str:
    ws = words(lex.DISCOURSE_TERMS)
    return f"({x} in {ws} or {stem_sql(x)} in {ws})"


def noise_sql(x: str) -> str:
    frag = words(lex.HANGUL_FRAGMENTS)
    a, b = f"split_part({x}, ' ', 1)", f"split_part({x}, ' ', 2)"
    return (
        f"(length({x}) < 2 or regexp_matches({x}, '^[0-9]{{1,4}}$') or regexp_matches({x}, '^[A-Za-z]{{1,3}}$') "
        f"or lower({x}) in {words(lex.NOISE_LATIN)} or regexp_matches({x}, '[_/]') or regexp_matches({x}, '^[ㄱ-ㅎㅏ-ㅣ]+$') "
        f"or {x} in {frag} or {discourse_sql(x)} or {x} in {words(lex.AMBIGUOUS_TERMS)} "
        f"or (length({x}) >= 8 and not contains({x}, ' ') and not regexp_matches({x}, '^[A-Za-z]+$')) "
        f"or (contains({x}, ' ') and ({discourse_sql(a)} or {a} in {frag}) and ({discourse_sql(b)} or {b} in {frag})))"
    )


def bad_sql(x: str) -> str:
    return f"({x} in {words(STOP_TERMS)} or {noise_sql(x)})"


DOCS = f"with m as ({src.documents_sql('lang')}), tot as (select room_id, count(*) as total_messages from m group by 1)"
DOC_TK = DOCS + tokens_sql("m", "message")
CHAT_TK = CHAT_F + ", kt as (select *, case when not is_system and not is_boilerplate and eligible then msg end as keyword_text from f)" + tokens_sql("kt", "keyword_text")

STATS = """
, kp0 as (select room_id, count(*) as n, sum(len(regexp_extract_all(message, '[가-힣]'))) as h, sum(len(regexp_extract_all(message, '[A-Za-z]'))) as l from m where regexp_matches(message, '[가-힣A-Za-z]') group by 1)
, kp as (select room_id, case when n < 8 then true when h < 24 then false when l = 0 then true else h >= l * 0.85 end as korean from kp0)
, df as (select room_id, term, count(*) as df from tk group by 1, 2)
, bg as (select x.room_id, x.term as a, y.term as b, count(*) as df from tk x join tk y on x.room_id = y.room_id and x.line = y.line and y.i = x.i + 1
  where length(x.term) >= 2 and length(y.term) >= 2 and length(x.term) + length(y.term) <= 28 and not regexp_matches(x.term, '^\\d+$') and not regexp_matches(y.term, '^\\d+$') group by 1, 2, 3)
, cs as (select room_id, count(distinct line) as n_docs, greatest(1.0, count(*) / cast(count(distinct line) as double)) as avg_len from tk group by 1)
, lim0 as (select room_id, n_docs, avg_len, total_messages as n_total, case when total_messages < 200 then 2 when total_messages < 2000 then 3 when total_messages < 50000 then 4 when total_messages < 100000 then 12 else 20 end as b, coalesce(korean, true) as korean from cs join tot using (room_id) left join kp using (room_id))
, lim1 as (select *, cast(case when korean and n_total < 8000 and b > 2 then b - 1 else b end as int) as min_df from lim0)
, lim as (select room_id, n_docs, avg_len, n_total, min_df, cast(case when n_docs < 500 then greatest(2, min_df - 1) when n_docs < 10000 then greatest(3, min_df) else greatest(min_df + 2, cast(floor(sqrt(n_docs) / 30.0) as int), 4) end as int) as min_bigram_df from lim1)
"""
_idf = "ln(1.0 + (n_docs - df + 0.5) / (df + 0.5))"
_bm = f"({_idf} * (df * 2.2) / (df + 1.2 * (1 - 0.75 + 0.75 * 1.0 / avg_len)))"
_pmi = "log2((cast(df as double) / n_docs) / ((cast(da as double) / n_docs) * (cast(db as double) / n_docs)) + 1e-12)"
_least = "(case when n_docs < 500 then 3.0 when n_docs < 10000 then 3.5 else 4.0 end)"
_stutter = f"(case when starts_with(a, b) or starts_with(b, a) then a = b or abs(length(a) - length(b)) <= 4 else a in {words(lex.WEAK_BIGRAM_PARTS)} or b in {words(lex.WEAK_BIGRAM_PARTS)} end)"
CANDS = STATS + f"""
, uni as (select room_id, term as label, df as hits, {_bm} as score from df join lim using (room_id) where df >= min_df and not {bad_sql('term')})
, bi0 as (select bg.room_id, a || ' ' || b as label, bg.df as df, n_docs, avg_len, da.df as da, db.df as db, a, b from bg join lim on lim.room_id = bg.room_id and bg.df >= min_bigram_df
   left join df da on da.room_id = bg.room_id and da.term = a left join df db on db.room_id = bg.room_id and db.term = b)
, bi1 as (select * from bi0 where not {_stutter} and not {bad_sql('a')} and not {bad_sql('b')} and not {bad_sql('label')})
, bi as (select room_id, label, df as hits, {_bm} * 1.12 * (case when da >= 2 and db >= 2 and df >= 2 and {_pmi} >= {_least} then 1.0 + least(0.4, ({_pmi} - {_least}) * 0.05) else 1.0 end) as score from bi1)
, cd as (select room_id, label, hits, {round_sql('score', 9)} as score from (select * from uni union all select * from bi))
"""


def lanes_sql(supp: str, limit: int = 120, weight: float = 0.5) -> str:
    """``supp``: CTE sp(room_id, label, count) of supplement labels."""
    return CANDS + supp + f"""
, fr as (select cd.*, row_number() over (partition by room_id order by hits desc, score desc, length(label) desc, label) as freq_rank, row_number() over (partition by room_id order by score desc, hits desc, length(label) desc, label) as score_rank from cd)
, fl as (select fr.*, total_messages as n, case when total_messages >= 50000 then 80 when total_messages >= 10000 then 60 when total_messages >= 2000 then 48 else 32 end as fc, least(200, floor(80 + sqrt(total_messages))) as sc from fr join tot using (room_id))
, s1 as (select *, row_number() over (partition by room_id order by count desc, length(label) desc, label) as c from sp qualify c <= {max(8, limit // 5)})
, s2 as (select room_id, label, row_number() over (partition by room_id order by c) as supp_rank from s1 where not {noise_sql('label')})
, mt as (select fl.room_id, fl.label, hits, n, case when freq_rank <= fc or score_rank <= sc then score else 0 end as score, case when freq_rank <= fc then freq_rank end as freq_rank, case when score_rank <= sc then score_rank end as score_rank, supp_rank
   from fl left join s2 using (room_id, label) where freq_rank <= fc or score_rank <= sc or supp_rank is not null)
, mx as (select room_id, max(hits) filter (where freq_rank = 1) as mh, max(score) filter (where score_rank = 1) as ms from mt group by 1)
, fu as (select mt.*, {round_sql('0.55 * ln(1 + hits) / ln(1 + greatest(1, mh)) + case when freq_rank is not null or score_rank is not null then 0.45 * score / greatest(1e-9, ms) * least(1.0, hits / greatest(4.0, sqrt(n))) else 0 end', 9)} as composite,
  {round_sql(f'coalesce(1.0 / (60 + freq_rank), 0) + coalesce(0.92 / (60 + score_rank), 0) + coalesce({weight} / (60 + supp_rank), 0)', 9)} as rrf from mt join mx using (room_id))
, di as (select *, row_number() over (partition by room_id order by composite desc, hits desc, rrf desc, length(label) desc, label) as distinctive_rank from fu)
, kw as (select *, row_number() over (partition by room_id order by hits desc, composite desc, distinctive_rank) as rank from di)
, kl as (select room_id, cast(rank as int) as rank, label, hits as count, case when freq_rank is not null and score_rank is not null then 'both' when score_rank is not null then 'bm25' when freq_rank is not null then 'freq' end as lane from kw where rank <= {limit})
"""


HASHTAGS = f", hs as (select distinct room_id, line, unnest(regexp_extract_all(keyword_text, {q(lex.HASHTAG)}, 1)) as label from kt where keyword_text is not null), sp as (select room_id, label, count(*) as count from hs where label not in {words([*lex.ATTACHMENT_MARKERS, *lex.NOTICE_STOP_TERMS])} and label not in (select lower(sender) from m) group by 1, 2)"
NO_SUPP = ", sp as (select room_id, label, hits as count from cd where false)"
KEYWORDS = lanes_sql(HASHTAGS)
CHAT_KW = CHAT_TK + KEYWORDS
