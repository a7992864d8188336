"""Keywords: token documents, term statistics, BM25, dual-lane ranking, phrases.

Tokens stay an array per message until the explode in front of an aggregate that
combines on the map side; quality filters run on the aggregated terms, where they
touch each term once, and after the document-frequency cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import lexicon as lex
from palaver.functions import tokens as tok
from palaver.functions.segment import dictionary_tokenizer
from palaver.functions.frames import once
from palaver.functions.numeric import half_up, percent_or_null
from palaver.functions.text import hashtags, script_counts, squeeze, trim_all, utf16_length
from palaver.operators.topk import top_k
from palaver.session import materialise

ROOM = ["room_id"]
K1, B = 1.2, 0.75
BIGRAM_BOOST = 1.12
RRF = 60.0
STOP_TERMS = tuple(dict.fromkeys([*lex.DISCOURSE_TERMS, *lex.NOTICE_STOP_TERMS, *lex.ATTACHMENT_MARKERS]))


def token_docs(texts: DataFrame, text: str = "keyword_text", extra: tok.Tokenizer | None = None) -> DataFrame:
    """(room_id, line, day, month, sender, tokens) of the messages that have a token.

    Tokens are distinct within a message, so a term's frequency equals its number of
    messages.
    """
    d = once(texts.filter(F.col(text).isNotNull()), "tokens", tok.tokens(F.col(text), extra))
    return d.filter(F.size("tokens") > 0).select(
        "room_id", "line", F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), "sender", "tokens"
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """All counts of a corpus in one pass: (room_id, a, b, df).

    ``b`` is set for a bigram, NULL for a term; the row with ``a`` NULL holds the
    number of documents. One explode and one map-side combined aggregate replace
    separate scans for terms, bigrams and corpus size.
    """
    none = F.lit(None).cast("string")
    entry = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    terms = F.transform("tokens", lambda t: entry(t, none))
    entries = F.concat(F.array(entry(none, none)), terms, F.array_compact(_neighbours(F.col("tokens"))))
    d = docs.select("room_id", F.explode(entries).alias("e")).select("room_id", "e.a", "e.b")
    return d.groupBy("room_id", "a", "b").agg(F.count("*").alias("df"))


def _neighbours(tokens: Column) -> Column:
    return F.zip_with(
        tokens, F.slice(tokens, 2, F.size(tokens)),
        lambda a, b: F.when(tok.pairs_up(a, b), F.struct(a.alias("a"), b.alias("b"))),
    )


def corpus_stats(vocab: DataFrame) -> DataFrame:
    """Documents with tokens and mean number of tokens per room.

    Tokens are distinct per document, so the term counts add up to the token hits.
    """
    n = F.sum(F.when(F.col("a").isNull(), F.col("df")))
    hits = F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNull(), F.col("df")))
    return vocab.groupBy("room_id").agg(n.alias("n_docs"), F.greatest(F.lit(1.0), hits / n).alias("avg_len"))


def term_stats(docs: DataFrame) -> DataFrame:
    return docs.select("room_id", F.explode("tokens").alias("term")).groupBy("room_id", "term").agg(F.count("*").alias("df"))


def bigram_stats(docs: DataFrame) -> DataFrame:
    d = docs.select("room_id", F.explode(F.array_compact(_neighbours(F.col("tokens")))).alias("p"))
    return d.groupBy("room_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("df"))


def min_count(n: Column, korean: Column) -> Column:
    """Least document frequency of a keyword by number of messages; lower in small Korean rooms."""
    base = F.when(n < 200, 2).when(n < 2_000, 3).when(n < 50_000, 4).when(n < 100_000, 12).otherwise(20)
    return F.when(korean & (n < 8_000) & (base > 2), base - 1).otherwise(base)


def min_bigram_count(n: Column, unigram_min: Column) -> Column:
    scaled = F.floor(F.sqrt(n) / 30.0).cast("int")
    return (
        F.when(n < 500, F.greatest(F.lit(2), unigram_min - 1))
        .when(n < 10_000, F.greatest(F.lit(3), unigram_min))
        .otherwise(F.greatest(unigram_min + 2, scaled, F.lit(4)))
    )


def bm25(tf: Column, df: Column, n: Column, avg_len: Column) -> Column:
    idf = F.ln(1.0 + (n - df + 0.5) / (df + 0.5))
    length = F.greatest(F.lit(1.0), tf / F.greatest(df, F.lit(1)))
    norm = tf + K1 * (1.0 - B + B * length / F.greatest(avg_len, F.lit(1.0)))
    return idf * (tf * (K1 + 1.0)) / norm


def pmi_multiplier(df: Column, df_a: Column, df_b: Column, n: Column) -> Column:
    """1 to 1.4 by how much more often two terms meet than by chance."""
    pmi = F.log2((df / n) / ((df_a / n) * (df_b / n)) + 1e-12)
    least = F.when(n < 500, 3.0).when(n < 10_000, 3.5).otherwise(4.0)
    ok = (df_a >= 2) & (df_b >= 2) & (df >= 2) & (pmi >= least)
    return F.when(ok, 1.0 + F.least(F.lit(0.4), (pmi - least) * 0.05)).otherwise(F.lit(1.0))


def thresholds(vocab: DataFrame, totals: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Per room: n_docs, avg_len, n_total and the two frequency floors.

    The unigram floor uses all messages, the bigram floor the messages with tokens.
    ``profile`` (``script_profile``) tells which rooms are mainly Korean; without it all are.
    """
    d = corpus_stats(vocab).join(totals.select("room_id", F.col("total_messages").alias("n_total")), ROOM)
    korean = F.lit(True)
    if profile is not None:
        d = d.join(profile.select("room_id", "primarily_korean"), ROOM, "left")
        korean = F.coalesce("primarily_korean", F.lit(True))
    d = d.withColumn("min_df", min_count(F.col("n_total"), korean)).drop("primarily_korean")
    return d.withColumn("min_bigram_df", min_bigram_count(F.col("n_docs"), F.col("min_df")))


def candidates(
    docs: DataFrame, totals: DataFrame, stop_terms: tuple[str, ...] = (), profile: DataFrame | None = None
) -> DataFrame:
    """(room_id, label, hits, score): unigrams and bigrams that pass all filters.

    Scores are cut to nine decimals so that ties do not hang on the last bit. The
    vocabulary and the result are written once to the shared folder: both are read
    several times downstream, and the texts must be tokenised only once.
    """
    stop = tuple(dict.fromkeys([*STOP_TERMS, *stop_terms]))
    vocab = materialise(vocabulary(docs), "vocabulary")
    limits = thresholds(vocab, totals, profile)
    n, avg = F.col("n_docs"), F.col("avg_len")
    terms = vocab.filter("a is not null and b is null").select("room_id", F.col("a").alias("term"), "df")
    # no keyword occurs once; the parts of a bigram are at least as frequent as the bigram
    good = terms.filter(F.col("df") >= 2).filter(~F.col("term").isin(*stop) & ~tok.is_noise(F.col("term"), stop_terms))

    uni = good.join(limits, ROOM).filter(F.col("df") >= F.col("min_df"))
    uni = uni.select("room_id", F.col("term").alias("label"), F.col("df").alias("hits"), bm25(F.col("df"), F.col("df"), n, avg).alias("score"))

    label = F.concat_ws(" ", "a", "b")
    bi = vocab.filter("b is not null and df >= 2").join(limits, ROOM).filter(F.col("df") >= F.col("min_bigram_df"))
    bi = bi.filter(~label.isin(*stop) & ~tok.is_stutter(F.col("a"), F.col("b")))
    bi = bi.join(good.select("room_id", F.col("term").alias("a"), F.col("df").alias("df_a")), ["room_id", "a"])
    bi = bi.join(good.select("room_id", F.col("term").alias("b"), F.col("df").alias("df_b")), ["room_id", "b"])
    score = bm25(F.col("df"), F.col("df"), n, avg) * BIGRAM_BOOST * pmi_multiplier(F.col("df"), F.col("df_a"), F.col("df_b"), n)
    bi = bi.select("room_id", label.alias("label"), F.col("df").alias("hits"), score.alias("score"))
    return materialise(uni.unionByName(bi).withColumn("score", half_up(F.col("score"), 9)), "candidates")


def _by_score() -> list[Column]:
    return [F.desc("score"), F.desc("hits"), F.desc(F.length("label")), F.asc("label")]


def _by_hits() -> list[Column]:
    return [F.desc("hits"), F.desc("score"), F.desc(F.length("label")), F.asc("label")]


def bm25_keywords(cands: DataFrame, k: int = 100) -> DataFrame:
    return top_k(cands, ROOM, _by_score(), k)


def lane_caps(n: Column) -> tuple[Column, Column]:
    """(frequency lane, BM25 lane) sizes by number of messages."""
    freq = F.when(n >= 50_000, 80).when(n >= 10_000, 60).when(n >= 2_000, 48).otherwise(32)
    return freq, F.least(F.lit(200), F.floor(80 + F.sqrt(n))).cast("int")


def supplement_hits(cands: DataFrame, supplement: DataFrame, limit: int, stop_terms=()) -> DataFrame:
    """Top supplement labels (hashtags, cluster terms) that are candidates themselves."""
    order = [F.desc("count"), F.desc(F.length("label")), F.asc("label")]
    top = top_k(supplement, ROOM, order, max(8, limit // 5), "_cut").filter(~tok.is_noise(F.col("label"), stop_terms))
    w = Window.partitionBy("room_id").orderBy("_cut")
    top = top.withColumn("supp_rank", F.row_number().over(w)).select("room_id", "label", "supp_rank")
    return top.join(cands.select("room_id", "label", "hits"), ["room_id", "label"])


def dual_lane(
    cands: DataFrame, supplement: DataFrame, totals: DataFrame, limit: int = 120, weight: float = 0.5, stop_terms=(),
    most: tuple[int | None, int | None] = (80, 200),
) -> DataFrame:
    """Frequency lane and BM25 lane fused; one row per kept label with both final ranks.

    Lanes hold as many labels as the room's size allows, ``most`` at most; a lane whose bound is
    None holds all candidates.
    """
    n = totals.select("room_id", F.col("total_messages").alias("_n"))
    freq_cap, score_cap = lane_caps(F.col("_n"))
    lane = lambda order, k, rank, cap: top_k(cands, ROOM, order, k, rank).join(n, ROOM).filter(
        F.lit(True) if k is None else F.col(rank) <= cap
    )
    freq, best = lane(_by_hits(), most[0], "freq_rank", freq_cap), lane(_by_score(), most[1], "score_rank", score_cap)
    supp = supplement_hits(cands, supplement, limit, stop_terms).join(n, ROOM)
    none = F.lit(None).cast("int")
    cols = ["room_id", "label", "hits", "_n"]
    lanes = (
        freq.select(*cols, "score", "freq_rank", none.alias("score_rank"), none.alias("supp_rank"))
        .unionByName(best.select(*cols, "score", none.alias("freq_rank"), "score_rank", none.alias("supp_rank")))
        .unionByName(supp.select(*cols, F.lit(0.0).alias("score"), none.alias("freq_rank"), none.alias("score_rank"), "supp_rank"))
    )
    room = Window.partitionBy("room_id")  # at most 80 + 200 + 24 rows, unless the lanes are unbounded
    fused = lanes.groupBy("room_id", "label").agg(
        F.max("hits").alias("hits"), F.max("score").alias("score"), F.max("_n").alias("_n"),
        F.max("freq_rank").alias("freq_rank"), F.max("score_rank").alias("score_rank"), F.max("supp_rank").alias("supp_rank"),
    )
    top_hits = F.max(F.when(F.col("freq_rank") == 1, F.col("hits"))).over(room)
    top_score = F.max(F.when(F.col("score_rank") == 1, F.col("score"))).over(room)
    in_lane = F.col("freq_rank").isNotNull() | F.col("score_rank").isNotNull()
    floor = F.greatest(F.lit(4.0), F.sqrt(F.col("_n")))
    composite = 0.55 * F.log1p("hits") / F.log1p(F.greatest(F.lit(1), top_hits)) + F.when(
        in_lane, 0.45 * F.col("score") / F.greatest(F.lit(1e-9), top_score) * F.least(F.lit(1.0), F.col("hits") / floor)
    ).otherwise(F.lit(0.0))
    part = lambda c, w: F.coalesce(w / (RRF + F.col(c)), F.lit(0.0))
    rrf = part("freq_rank", 1.0) + part("score_rank", 0.92) + part("supp_rank", weight)
    d = fused.withColumn("composite", half_up(composite, 9)).withColumn("rrf", half_up(rrf, 9))
    distinctive = room.orderBy(
        F.desc("composite"), F.desc("hits"), F.desc("rrf"), F.desc(F.length("label")), F.asc("label")
    )
    d = d.withColumn("distinctive_rank", F.row_number().over(distinctive))
    by_hits = room.orderBy(F.desc("hits"), F.desc("composite"), F.asc("distinctive_rank"))
    d = d.withColumn("rank", F.row_number().over(by_hits))
    f, s = F.col("freq_rank").isNotNull(), F.col("score_rank").isNotNull()
    lane = F.when(f & s, "both").when(s, "bm25").when(f, "freq")
    return d.filter((F.col("rank") <= limit) | (F.col("distinctive_rank") <= limit)).select(
        "room_id", "label", "hits", "rank", "distinctive_rank", lane.alias("lane"), "composite"
    )


def keyword_list(lanes: DataFrame, limit: int = 120) -> DataFrame:
    return lanes.filter(F.col("rank") <= limit).select("room_id", "rank", "label", F.col("hits").alias("count"), "lane")


def legacy_fusion(cands: DataFrame, supplement: DataFrame, limit: int = 100, weight: float = 0.85, stop_terms=()) -> DataFrame:
    """Older fusion: message hits first, then reciprocal ranks of BM25 and supplement.

    Only labels among the first ``limit`` by hits can be returned. Ties at the last
    kept hit count are broken by rank terms, so candidates are first cut by
    (hits, score), which orders ties exactly like their BM25 rank; supplement labels
    are few and join separately.
    """
    ranked = top_k(cands, ROOM, _by_hits(), limit, "_h").select("room_id", "label", "hits", "score")
    supp = supplement_hits(cands, supplement, limit, stop_terms)
    pool = ranked.unionByName(
        cands.join(supp.select("room_id", "label"), ["room_id", "label"], "left_semi").select("room_id", "label", "hits", "score")
    ).dropDuplicates(["room_id", "label"])
    rank = score_ranks(cands, pool)
    d = rank.join(supp.select("room_id", "label", "supp_rank"), ["room_id", "label"], "left")
    rrf = 1.0 / (RRF + F.col("score_rank")) + F.coalesce(weight / (RRF + F.col("supp_rank")), F.lit(0.0))
    d = d.withColumn("rrf", half_up(rrf, 9))
    return top_k(
        d, ROOM, [F.desc("hits"), F.desc("rrf"), F.desc(F.length("label")), F.asc("label")], limit
    ).select("room_id", "rank", "label", F.col("hits").alias("count"), "rrf")


def score_ranks(cands: DataFrame, pool: DataFrame) -> DataFrame:
    """BM25 rank of the few ``pool`` labels among all candidates of their room.

    Candidates are counted per score bin; windows run over the bins of a room and
    inside the bins that hold a pool label, never over a room's whole vocabulary.
    """
    binned = cands.withColumn("_bin", F.floor(F.col("score") * 1000.0))
    above = Window.partitionBy("room_id").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    base = binned.groupBy("room_id", "_bin").agg(F.count("*").alias("_c")).select(
        "room_id", "_bin", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_base")
    )
    wanted = pool.select("room_id", F.floor(F.col("score") * 1000.0).alias("_bin")).distinct()
    inside = Window.partitionBy("room_id", "_bin").orderBy(*_by_score())
    placed = binned.join(wanted, ["room_id", "_bin"], "left_semi").withColumn("_r", F.row_number().over(inside))
    placed = placed.join(pool.select("room_id", "label"), ["room_id", "label"], "left_semi")
    return placed.join(base, ["room_id", "_bin"]).withColumn("score_rank", F.col("_base") + F.col("_r")).drop(
        "_bin", "_base", "_r"
    )


def keyword_shares(keywords: DataFrame) -> DataFrame:
    """Share of the first keyword and type richness of the list, in percent."""
    d = keywords.groupBy("room_id").agg(
        F.sum("count").alias("_s"), F.count("*").alias("_n"), F.max(F.when(F.col("rank") == 1, F.col("count"))).alias("_first")
    )
    return d.select(
        "room_id", percent_or_null(F.col("_first"), F.col("_s")).alias("top1_percent"),
        percent_or_null(F.col("_n"), F.col("_s")).alias("richness_percent"),
    )


def hashtag_counts(features: DataFrame, people: DataFrame) -> DataFrame:
    """Hashtags once per message, without sender names and marker words."""
    d = features.filter(F.col("keyword_text").isNotNull() & F.col("keyword_text").contains("#"))
    tags = d.select("room_id", F.explode(hashtags(F.col("keyword_text"))).alias("label"))
    tags = tags.filter(~F.col("label").isin(*lex.ATTACHMENT_MARKERS, *lex.NOTICE_STOP_TERMS))
    counts = tags.groupBy("room_id", "label").agg(F.count("*").alias("count"))
    name = F.when(F.col("sender").rlike("^[A-Za-z0-9_+-]+$"), F.lower("sender")).otherwise(F.trim("sender"))
    names = people.select("room_id", name.alias("label"))
    return counts.join(names, ["room_id", "label"], "left_anti")


def period_terms(docs: DataFrame, grain: str) -> DataFrame:
    """Term counts per ``day`` or ``month``."""
    d = docs.select("room_id", grain, F.explode("tokens").alias("term"))
    return d.groupBy("room_id", grain, "term").agg(F.count("*").alias("count"))


def top_period_terms(counts: DataFrame, grain: str, k: int) -> DataFrame:
    return top_k(counts, ["room_id", grain], [F.desc("count"), F.desc(F.length("term")), F.asc("term")], k)


def topic_trend(docs: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """Per month the most used of the room's keywords."""
    counts = period_terms(docs, "month").join(
        keywords.select("room_id", F.col("label").alias("term")), ["room_id", "term"], "left_semi"
    )
    return top_period_terms(counts, "month", k)


def head_tail_terms(docs: DataFrame, k: int = 12) -> DataFrame:
    """Top terms of the earlier and the later half of the months."""
    monthly = period_terms(docs, "month")
    months = monthly.select("room_id", "month").distinct()
    w = Window.partitionBy("room_id")
    months = months.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("month")))
    months = months.filter(F.col("_n") >= 2).withColumn(
        "half", F.when(F.col("_i") <= F.floor(F.col("_n") / 2), "head").otherwise("tail")
    )
    d = monthly.join(months.select("room_id", "month", "half"), ["room_id", "month"])
    sums = d.groupBy("room_id", "half", "term").agg(F.sum("count").alias("count"))
    return top_k(sums, ["room_id", "half"], [F.desc("count"), F.desc(F.length("term")), F.asc("term")], k)


def keyword_shift(halves: DataFrame, k: int = 8) -> DataFrame:
    """Terms of one half that the other half's list does not have, in list order."""
    other = halves.select("room_id", F.when(F.col("half") == "head", "tail").otherwise("head").alias("half"), "term")
    only = halves.join(other, ["room_id", "half", "term"], "left_anti").withColumnRenamed("rank", "list_rank")
    return top_k(only, ["room_id", "half"], [F.asc("list_rank")], k)


def phrases(texts: DataFrame, text: str = "keyword_text") -> DataFrame:
    """Repeated texts of 12-180 UTF-16 units per day (base of ``repeated_phrases``)."""
    d = texts.filter(F.col(text).isNotNull()).select(
        "room_id", F.to_date("ts").alias("day"), squeeze(trim_all(F.col(text))).alias("phrase")
    )
    d = d.filter(utf16_length(F.col("phrase")).between(12, 180))
    return d.groupBy("room_id", "phrase", "day").agg(F.count("*").alias("count"))


def repeated_phrases(phrase_days: DataFrame, k: int = 8, least: int = 3) -> DataFrame:
    d = phrase_days.groupBy("room_id", "phrase").agg(
        F.sum("count").alias("count"), F.max_by("day", F.struct(F.col("count"), -F.unix_date("day"))).alias("peak_day")
    ).filter(F.col("count") >= least)
    label = F.when(F.length("phrase") > 72, F.concat(F.substring("phrase", 1, 69), F.lit("…"))).otherwise(F.col("phrase"))
    return top_k(d, ROOM, [F.desc("count"), F.asc("phrase")], k).select(
        "room_id", "rank", label.alias("label"), "count", "peak_day"
    )


# ---- vocabulary helpers ----------------------------------------------------------------

def script_profile(messages: DataFrame) -> DataFrame:
    """Hangul and Latin letters per room and whether the room is mainly Korean."""
    hangul, latin = script_counts(F.col("message"))
    d = messages.filter(F.col("message").rlike(lex.LETTER)).groupBy("room_id").agg(
        F.count("*").alias("texts"), F.sum(hangul).alias("hangul"), F.sum(latin).alias("latin")
    )
    primary = (
        F.when(F.col("texts") < 8, True).when(F.col("hangul") < 24, False)
        .when(F.col("latin") == 0, True).otherwise(F.col("hangul") >= F.col("latin") * 0.85)
    )
    return d.withColumn("primarily_korean", primary)


def user_words(messages: DataFrame, stop_terms=(), k: int = 96) -> DataFrame:
    """Candidate words for a tokenizer dictionary, by number of messages."""
    raw = F.filter(F.split("message", f"[{lex.BLANK}]+"), lambda t: t.rlike(lex.LETTER) & F.length(t).between(2, 16))
    # words of a message are distinct only after canonical spelling, hence two steps
    low = lambda t: F.when(t.rlike("^[A-Za-z0-9_+-]+$"), F.lower(t)).otherwise(t)
    words = F.array_distinct(F.transform(raw, lambda t: tok.canonical(low(t))))
    d = messages.filter(F.col("message").rlike(lex.LETTER)).select("room_id", F.explode(words).alias("word"))
    counts = d.groupBy("room_id", "word").agg(F.count("*").alias("df"))
    w = F.col("word")
    latin = w.rlike("^[A-Za-z0-9_+-]+$")
    size = F.length(w)
    fits = F.when(latin, size.between(2, 12)).otherwise(w.rlike("[가-힣]") & size.between(2, 8))
    least = F.when(w.rlike("[가-힣]"), 2).otherwise(3)
    kept = counts.filter((F.col("df") >= least) & fits & ~w.isin(*stop_terms, "") & ~tok.is_noise(w, stop_terms))
    top = top_k(kept, ROOM, [F.desc("df"), F.desc(size), F.asc("word")], k)
    return top.select(
        "room_id", "rank", "word", "df", F.when(w.rlike("^[A-Za-z]"), "SL").otherwise("NNP").alias("tag"),
        half_up(F.least(F.lit(8.0), F.log1p("df")), 6).alias("score"),
    )


def merge_user_words(glossary: DataFrame, words: DataFrame) -> DataFrame:
    """Glossary entries win over counted words."""
    extra = words.join(glossary.select("room_id", "word"), ["room_id", "word"], "left_anti")
    return glossary.select("room_id", "word", "tag", "score").unionByName(extra.select("room_id", "word", "tag", "score"))


def dictionaries(glossary: DataFrame | None, words: DataFrame) -> DataFrame:
    """(room_id, dictionary): the room's words with their scores as a map; at most 96 and the glossary."""
    every = words if glossary is None else merge_user_words(glossary, words)
    hangul = every.filter(F.col("word").rlike("^[가-힣]{2,8}$"))
    return hangul.groupBy("room_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "score"))).alias("dictionary"))


def dictionary_docs(texts: DataFrame, words: DataFrame, text: str = "keyword_text", extra: tok.Tokenizer | None = None) -> DataFrame:
    """``token_docs`` with the words of the room's dictionary cut out of glued Hangul."""
    cut = dictionary_tokenizer(F.col("dictionary"))
    none = F.array().cast("array<string>")
    both = cut if extra is None else lambda doc: F.concat(F.coalesce(extra(doc), none), F.coalesce(cut(doc), none))
    return token_docs(texts.join(words, ROOM, "left"), text, both)


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ranked lists (room_id, rank, label) side by side: same rank, shared, only one."""
    left = a.select("room_id", "label", F.col("rank").alias("rank_a"))
    right = b.select("room_id", "label", F.col("rank").alias("rank_b"))
    d = left.join(right, ["room_id", "label"], "full_outer")
    status = (
        F.when(F.col("rank_b").isNull(), "only_a").when(F.col("rank_a").isNull(), "only_b")
        .when(F.col("rank_a") == F.col("rank_b"), "same").otherwise("shared")
    )
    return d.withColumn("status", status)


def keyword_audit(keywords: DataFrame, required: list[str], banned: list[str], within=(30, 20)) -> DataFrame:
    """Data-quality check: required terms in the first 30, banned ones not in the first 20."""
    spec = F.array(
        *[F.struct(F.lit(t).alias("label"), F.lit("required").alias("rule")) for t in required],
        *[F.struct(F.lit(t).alias("label"), F.lit("banned").alias("rule")) for t in banned],
    )
    want = keywords.select("room_id").distinct().select("room_id", F.explode(spec).alias("s")).select("room_id", "s.*")
    d = want.join(keywords.select("room_id", "label", "rank"), ["room_id", "label"], "left")
    seen = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    ok = F.when(F.col("rule") == "required", seen(within[0])).otherwise(~seen(within[1]))
    return d.withColumn("passed", ok)
