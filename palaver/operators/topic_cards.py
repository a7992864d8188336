"""Topic cards: seeds, near-repeats, fusion of lanes, proposals. All rooms at once, as sets.

A card is (room_id, id, kind, title, terms, percent); lanes also carry ``place``. Cards are
compared through an index on their normalised terms, so only cards that share a term meet.

* A card repeats a better one if they overlap by more than a threshold; "better" is an order
  fixed beforehand, so the outcome does not depend on the sequence of comparisons.
* Cards of several lanes are fused into one theme per connected component of the overlap
  graph; a theme's score is the sum of reciprocal ranks of its cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import tokens as tok
from palaver.functions.numeric import half_up
from palaver.operators.components import components
from palaver.operators.topics import card_title

ROOM = ["room_id"]
FUSE, REPEAT, SEED = 0.42, 0.55, 0.45  # overlaps from which cards are one theme, a repeat, a known seed
RANK_SHIFT = 60.0
LANES = {"graph": 1.0, "seed": 1.15, "semantic": 1.05}
TERMS = 8  # terms of a card


def normal_terms(terms: Column) -> Column:
    """Distinct topic forms of at least two characters, in order."""
    return F.filter(F.array_distinct(F.transform(terms, tok.normalise_term)), lambda t: F.length(t) >= 2)


def title_words(title: Column) -> Column:
    """The same for ``a · b`` and ``b · a``."""
    return F.array_join(F.sort_array(normal_terms(F.split(title, r"\s*·\s*"))), "|")


def overlaps(cards: DataFrame, key: str = "id") -> DataFrame:
    """(room_id, one, two, overlap): Jaccard values of cards that share a normalised term."""
    words = cards.select("room_id", F.col(key).alias("one"), normal_terms(F.col("terms")).alias("w"))
    words = words.select("room_id", "one", F.size("w").alias("n"), F.explode("w").alias("term"))
    other = words.select("room_id", F.col("one").alias("two"), F.col("n").alias("m"), "term")
    shared = words.join(other, ["room_id", "term"]).filter("one <> two").groupBy("room_id", "one", "two").agg(
        F.count("*").alias("k"), F.max("n").alias("n"), F.max("m").alias("m")
    )
    return shared.select("room_id", "one", "two", half_up(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("overlap"))


def _ranked(cards: DataFrame, order: list[Column], name: str) -> DataFrame:
    return cards.withColumn(name, F.row_number().over(Window.partitionBy(*ROOM).orderBy(*order)).cast("int"))


def without_repeats(cards: DataFrame, order: str, least: float) -> DataFrame:
    """Cards that overlap by ``least`` or more with none that comes before them."""
    rank = lambda c, n: cards.select("room_id", F.col("id").alias(c), F.col(order).alias(n))
    close = overlaps(cards).filter(F.col("overlap") >= least)
    later = close.join(rank("one", "p"), ["room_id", "one"]).join(rank("two", "q"), ["room_id", "two"]).filter("q < p")
    return cards.join(later.select("room_id", F.col("one").alias("id")).distinct(), ["room_id", "id"], "left_anti")


def refined_topics(cards: DataFrame) -> DataFrame:
    """Graph cards without themes that repeat a larger theme; ``place`` by share."""
    themes = _ranked(cards.filter("kind = 'theme'"), [F.desc("percent"), F.asc("id")], "p")
    kept = without_repeats(themes, "p", REPEAT).drop("p").unionByName(cards.filter("kind <> 'theme'"))
    return _ranked(kept, [F.desc("percent"), F.asc("id")], "place").select(
        "room_id", "place", "id", "kind", "title", "terms", "percent"
    )


def seed_topics(seeds: DataFrame, least_percent: float = 0.5) -> DataFrame:
    """Cards of keyword seeds: the seed's words and its neighbours.

    A seed is left out if it is rare, a generic word that is not distinctive, or close to a
    seed that ranks before it: equal words among the other's terms, or overlapping terms.
    """
    own = normal_terms(F.split("label", " "))
    cards = seeds.select(
        "room_id", F.concat(F.lit("kw-"), F.col("rank").cast("string")).alias("id"), F.lit("theme").alias("kind"), "rank",
        tok.normalise_term(F.col("label")).alias("word"), own.alias("own"), "percent",
        F.slice(normal_terms(F.concat(F.split("label", " "), "neighbours")), 1, TERMS).alias("terms"),
        (tok.is_generic_lead(F.col("label")) & (F.col("distinctive_rank") > 8)).alias("dull"),
    ).filter((F.size("own") > 0) & (F.col("percent") >= least_percent) & ~F.col("dull"))
    named = cards.select("room_id", F.explode("terms").alias("word"), F.col("rank").alias("r"))
    known = cards.select("room_id", "id", "word", "rank").join(named, ["room_id", "word"]).filter("r < rank")
    fresh = cards.join(known.select("room_id", "id").distinct(), ["room_id", "id"], "left_anti")
    kept = without_repeats(fresh, "rank", SEED)
    return _ranked(kept, [F.desc("percent"), F.asc("rank")], "place").select(
        "room_id", "place", "id", "kind", card_title(F.col("terms")).alias("title"), "terms", "percent"
    )


def fused_themes(cards: DataFrame, least: float = FUSE) -> DataFrame:
    """(room_id, id, terms, percent, score): one theme per component of overlapping cards.

    ``cards`` have room_id, id (unique in the room), terms, percent, title and ``weight``, the
    card's reciprocal rank. A theme has the id of its first card, the largest share, the sum
    of weights, and the terms that weigh most.
    """
    node = lambda c: F.concat_ws("\t", "room_id", c)
    close = overlaps(cards).filter(F.col("overlap") >= least).select(node("one").alias("a"), node("two").alias("b"))
    titled = cards.select(node("id").alias("b"), "room_id", title_words(F.col("title")).alias("key"))
    same = titled.groupBy("room_id", "key").agg(F.min("b").alias("a"))
    same = titled.join(same, ["room_id", "key"]).select("a", "b")
    stars = components(close.unionByName(same), "a", "b")
    placed = cards.withColumn("node", node("id")).join(stars, "node", "left").withColumn("theme", F.coalesce("root", "node"))
    sums = placed.groupBy("room_id", "theme").agg(
        half_up(F.sum("weight"), 9).alias("score"), F.max("percent").alias("percent"),
        F.min_by("id", F.struct((-F.col("weight")).alias("w"), "id")).alias("id"),
    )
    words = placed.select("room_id", "theme", "weight", F.explode(normal_terms(F.col("terms"))).alias("term"))
    words = words.groupBy("room_id", "theme", "term").agg(half_up(F.sum("weight"), 9).alias("w"))
    top = Window.partitionBy("room_id", "theme").orderBy(F.desc("w"), "term")
    listed = words.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= TERMS).groupBy("room_id", "theme").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("terms")
    )
    return sums.join(listed, ["room_id", "theme"]).drop("theme")


def merged_topics(graph: DataFrame, seeds: DataFrame, semantic: DataFrame, top: int | None = None, periods: int | None = None) -> DataFrame:
    """Themes of all lanes, fused, best first, then the period cards of the graph lane.

    ``top`` and ``periods`` limit what a report shows; without them all cards stay.
    """
    lanes = None
    for lane, cards in zip(LANES, (graph, seeds, semantic)):
        d = _ranked(cards.filter("kind = 'theme'"), [F.col("place")], "p").select(
            "room_id", F.concat_ws(":", F.lit(lane), "id").alias("id"), "title", "terms", "percent",
            (F.lit(LANES[lane]) / (RANK_SHIFT + F.col("p"))).alias("weight"),
        )
        lanes = d if lanes is None else lanes.unionByName(d)
    themes = _ranked(fused_themes(lanes), [F.desc("score"), F.desc("percent"), F.asc("id")], "n")
    months = _ranked(graph.filter("kind = 'period'"), [F.desc("percent"), F.asc("id")], "n")
    if periods is not None:
        months = months.filter(F.col("n") <= periods)
    if top is not None:
        held = months.groupBy("room_id").agg(F.count("*").alias("held"))
        themes = themes.join(held, ROOM, "left").filter(F.col("n") <= top - F.coalesce("held", F.lit(0))).drop("held")
    both = themes.select(
        "room_id", F.lit(0).alias("part"), "n", "id", F.lit("theme").alias("kind"), card_title(F.col("terms")).alias("title"), "terms", "percent"
    ).unionByName(months.select("room_id", F.lit(1).alias("part"), "n", "id", "kind", "title", "terms", "percent"))
    return _ranked(both, [F.col("part"), F.col("n")], "place").select("room_id", "place", "id", "kind", "title", "terms", "percent")


def accepted_proposals(
    topics: DataFrame, proposals: DataFrame, keywords: DataFrame, totals: DataFrame, top: int | None = None
) -> DataFrame:
    """Proposed cards(room_id, proposal, title, terms, evidence) join the topics in front, if

    a piece of their evidence is a keyword of the room, they have two terms, and they overlap
    with no topic and no earlier proposal.
    """
    proof = proposals.select("room_id", "proposal", F.explode(F.coalesce("evidence", "terms")).alias("label"))
    hits = proof.join(keywords.select("room_id", "label", "count"), ["room_id", "label"]).groupBy("room_id", "proposal").agg(
        F.max("count").alias("hits")
    )
    good = proposals.join(hits, ["room_id", "proposal"]).join(totals.select("room_id", "total_messages"), ROOM)
    share = half_up(F.least(F.lit(100.0), F.col("hits") / F.greatest(F.col("total_messages"), F.lit(1)) * 100.0), 1)
    new = good.select(
        "room_id", F.lit(1).alias("part"), F.col("proposal").cast("int").alias("n"),
        F.concat(F.lit("proposal-"), F.col("proposal").cast("string")).alias("id"), F.lit("theme").alias("kind"), "title",
        F.slice(normal_terms(F.concat(F.coalesce("evidence", "terms"), "terms")), 1, TERMS).alias("terms"),
        F.greatest(share, F.lit(1.2)).alias("percent"),
    ).filter(F.size("terms") >= 2)
    old = topics.select("room_id", F.lit(0).alias("part"), F.col("place").alias("n"), "id", "kind", "title", "terms", "percent")
    ranked = _ranked(old.unionByName(new), [F.col("part"), F.col("n")], "p")
    themes = ranked.filter("kind = 'theme'")
    fresh = without_repeats(themes, "p", FUSE).filter("part = 1").unionByName(ranked.filter("part = 0"))
    out = _ranked(fresh, [F.desc("part"), F.col("n")], "place")
    out = out if top is None else out.filter(F.col("place") <= top)
    return out.select("room_id", "place", "id", "kind", "title", "terms", "percent")
