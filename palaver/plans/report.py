"""The whole analysis: gold tables for all rooms from one message table.

``Report`` writes the few frames that everything else reads (features, sender-day
and hour cells, flow, token documents, ...) to the shared folder once and builds the
gold tables from them on demand.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import tone as tone_fn
from palaver.operators import activity as act
from palaver.operators import features as feat
from palaver.operators import flow as fl
from palaver.operators import inequality as ineq
from palaver.operators import insights as ins
from palaver.operators import keywords as kw
from palaver.operators import room_events as ev
from palaver.operators import sampling as smp
from palaver.operators import series as ser
from palaver.operators import text_nfc
from palaver.operators import tone as tn
from palaver.operators import topic_cards as cards
from palaver.operators import topics as tp
from palaver.operators import vectors as vec
from palaver.operators.topk import top_k
from palaver.options import AnalysisOptions
from palaver.session import materialise

ROOM = ["room_id"]


class Report:
    def __init__(self, messages: DataFrame, options: AnalysisOptions | None = None):
        self.options = options or AnalysisOptions()
        self.messages = text_nfc.compose(feat.since(messages, self.options.since))

    # ---- frames written once -------------------------------------------------------
    @cached_property
    def features(self) -> DataFrame:
        """Silver table: features with scrubbing left to the samples."""
        return materialise(feat.message_features(self.messages), "features")

    @cached_property
    def cells(self) -> DataFrame:
        return materialise(act.sender_day(self.features), "sender-day")

    @cached_property
    def hours(self) -> DataFrame:
        return materialise(act.hour_counts(self.features), "hours")

    @cached_property
    def flow(self) -> DataFrame:
        rows = self.features.filter(~F.col("is_system"))
        return materialise(fl.conversation_flow(rows, self.options.chunk_rows), "flow")

    @cached_property
    def tone(self) -> DataFrame:
        return materialise(tn.tone_cells(feat.with_tone(self.features)), "tone")

    @cached_property
    def docs(self) -> DataFrame:
        o = self.options
        if not (o.dictionary or o.glossary):
            return materialise(kw.token_docs(self.features, extra=o.tokenizer), "tokens")
        return materialise(kw.dictionary_docs(self.features, self.dictionaries, extra=o.tokenizer), "tokens")

    @cached_property
    def dictionaries(self) -> DataFrame:
        """The words by which glued Hangul of a room is cut; glossary entries win over counted words."""
        o = self.options
        words = kw.user_words(self.messages, o.stop_terms)
        if not o.dictionary:
            words = words.limit(0)
        rooms = self.features.select("room_id").distinct()
        glossary = rooms.withColumn("g", F.explode(F.array(*[
            F.struct(F.lit(w).alias("word"), F.lit(t).alias("tag"), F.lit(float(s)).alias("score")) for w, t, s in o.glossary
        ]))).select("room_id", "g.*") if o.glossary else None
        return materialise(kw.dictionaries(glossary, words), "dictionaries")

    @cached_property
    def topic_docs(self) -> DataFrame:
        return materialise(tp.topic_docs(self.docs, self.options.stop_terms), "topic-docs")

    @cached_property
    def notices(self) -> DataFrame:
        return materialise(ev.notice_days(self.features), "notices")

    @cached_property
    def lanes(self) -> DataFrame:
        o = self.options
        cands = kw.candidates(self.docs, self.totals, o.stop_terms, kw.script_profile(self.features))
        supplement = kw.hashtag_counts(self.features, self.people)
        lanes = kw.dual_lane(cands, supplement, self.totals, o.keyword_limit, o.supplement_weight, o.stop_terms, (o.frequency_lane, o.score_lane))
        return materialise(lanes, "lanes")

    @cached_property
    def scored(self) -> DataFrame:
        """Texts scrubbed and weighed once, for samples and signals."""
        return materialise(feat.scored_context(self.features), "scored-context")

    @cached_property
    def samples(self) -> DataFrame:
        return materialise(smp.context_samples(self.scored), "samples")

    @cached_property
    def edges(self) -> DataFrame:
        return materialise(fl.reply_edges(self.flow), "edges")

    # ---- gold tables -----------------------------------------------------------------
    @cached_property
    def summary(self) -> DataFrame:
        return materialise(act.room_summary(self.cells), "summary")

    @property
    def totals(self) -> DataFrame:
        return self.summary.select("room_id", "total_messages")

    @cached_property
    def people(self) -> DataFrame:
        return materialise(act.participants(self.cells), "people")

    @cached_property
    def days(self) -> DataFrame:
        return materialise(act.daily(self.cells, "all_messages"), "days")

    @property
    def aliases(self) -> DataFrame:
        return act.aliases(self.people, self.options.privacy, self.options.chunk_rows)

    @property
    def top_people(self) -> DataFrame:
        return act.top_participants(self.people, self.options.top)

    @property
    def runs(self) -> DataFrame:
        return fl.longest_runs(self.flow)

    @cached_property
    def gaps(self) -> DataFrame:
        return fl.gaps(self.flow)

    @cached_property
    def bursts(self) -> DataFrame:
        return materialise(ser.bursts(self.days, self.options.burst_method), "bursts")

    @cached_property
    def pulse(self) -> DataFrame:
        return materialise(ev.room_pulse(self.days, self.notices, act.first_appearances(self.cells)), "pulse")

    @property
    def keywords(self) -> DataFrame:
        return kw.keyword_list(self.lanes, self.options.keyword_limit)

    @property
    def keyword_distinctive(self) -> DataFrame:
        return self.lanes.filter(F.col("distinctive_rank") <= self.options.keyword_limit)

    @cached_property
    def phrases(self) -> DataFrame:
        return materialise(kw.repeated_phrases(kw.phrases(self.features)), "phrases")

    @cached_property
    def topics(self) -> DataFrame:
        o, docs = self.options, self.topic_docs
        counts = tp.topic_term_counts(docs)
        nodes, sizes = tp.graph_nodes(counts, o.stop_terms, o.graph_terms), tp.document_counts(docs)
        nodes = materialise(nodes, "graph-nodes")
        edges = tp.graph_edges(tp.cooccurrence(docs, nodes), nodes, sizes, self.totals, o.large_room)
        groups = materialise(tp.communities(nodes, edges), "communities")
        graph = tp.themes(groups, counts, sizes, self.totals, o.stop_terms, o.large_room).unionByName(
            tp.periods(docs, self.totals, o.stop_terms)
        )
        graph = materialise(cards.refined_topics(materialise(graph, "graph-cards")), "refined")
        labels = self.lanes.filter("rank <= 12 or distinctive_rank <= 8").select("room_id", "label")
        seeds = materialise(tp.seed_candidates(self.lanes, tp.neighbours(docs, labels), self.totals), "seeds")
        seeded = materialise(cards.seed_topics(seeds), "seed-cards")
        merged = cards.merged_topics(graph, seeded, seeded.filter(F.lit(False)), o.topics, o.period_cards)
        return materialise(merged, "topics")

    @cached_property
    def sentiment(self) -> DataFrame:
        return materialise(tn.daily_sentiment(self.tone, self.days), "sentiment")

    @cached_property
    def hot_topics(self) -> DataFrame:
        terms = kw.top_period_terms(kw.period_terms(self.docs, "day"), "day", 4)
        scored = None if self.options.signals_from_samples else self.scored
        hot = ins.hot_topics(self.days, terms, self.samples, act.sender_day_counts(self.cells), self.bursts, scored=scored)
        return materialise(hot, "hot-topics")

    @cached_property
    def timeline(self) -> DataFrame:
        events = ins.timeline(
            self.days, self.bursts, ser.silence(self.days), self.pulse, ev.link_spikes(self.cells), self.phrases,
            ev.plan_days(self.cells), ser.month_peaks(self.days),
        )
        return materialise(events, "timeline")

    @property
    def moments(self) -> DataFrame:
        ends = self.summary.select("room_id", "first_ts", "last_ts")
        return ins.moments(self.days, self.sentiment, ser.milestones(self.days), ends, self.hot_topics)

    @property
    def personas(self) -> DataFrame:
        return ins.personas(ins.persona_candidates(self.top_people, self.runs))

    @property
    def roles(self) -> DataFrame:
        return ins.participant_roles(ins.role_candidates(self.people, self.runs))

    @cached_property
    def members(self) -> DataFrame:
        return fl.matrix_members(self.people)

    @cached_property
    def room_row(self) -> DataFrame:
        """The wide row per room from which facts, cards and gates are taken."""
        first = lambda d, cond, *cols: d.filter(cond).select("room_id", *cols)
        arc = ser.activity_arc(self.days).groupBy("room_id").agg(*[
            F.max(F.when(F.col("segment") == s, F.col("messages"))).alias(f"{s}_messages") for s in ("head", "tail")
        ])
        bursts = self.bursts.groupBy("room_id").agg(
            F.count("*").alias("burst_days"), F.min_by("day", "rank").alias("top_burst_day"), F.max("messages").alias("top_burst")
        )
        peak = lambda v, name: [
            F.max(v).alias(name), F.max_by("day", F.struct(v.alias("v"), -F.unix_date("day"))).alias(f"{name}_day")
        ]
        pulse = self.pulse.groupBy("room_id").agg(
            *peak(F.col("hidden"), "peak_hidden"), *peak(F.col("join"), "peak_join"),
            *peak(F.col("hidden") + F.col("kick"), "peak_moderation"),
        )
        pairs = fl.top_pairs(self.edges, self.members)
        parts = [
            act.tone_rates(self.summary).select("room_id", "laugh_per_100", "emoji_per_100"),
            fl.flow_summary(self.flow, self.totals),
            fl.gap_quantiles(self.gaps).drop("gaps"),
            fl.gap_profile(self.gaps).drop("gaps"),
            act.peaks(self.hours),
            ser.streaks(self.days),
            ser.silence(self.days).select("room_id", "max_silence"),
            ser.short_span(self.days).select("room_id", "months"),
            ineq.gini(self.people),
            ineq.top3_share(self.people, self.totals),
            ineq.median_messages(self.people),
            first(self.top_people, "rank = 1", F.col("sender").alias("top_sender"), F.col("share_percent").alias("top_share")),
            first(self.phrases, "rank = 1", F.col("count").alias("phrase_count")),
            first(pairs, "rank = 1", F.concat_ws("→", "source", "target").alias("top_pair")),
            fl.visible_edges(self.edges, self.members).groupBy("room_id").agg(F.sum("replies").alias("visible_replies")),
            ev.room_events(self.notices, self.totals).drop("total_messages"),
            kw.keyword_shares(self.keywords), arc, bursts, pulse,
        ]
        d = self.summary
        for part in parts:
            d = d.join(part, ROOM, "left")
        d = d.withColumn("rhythm", ineq.rhythm_score(F.col("gini"), F.col("longest_streak"), F.col("density_per_day")))
        d = d.withColumn("pace", ins.pace_label(
            F.col("under_1m_percent"), F.col("switches_per_100"), F.col("gini"), F.col("over_60m_percent"), F.col("rhythm")
        ))
        return materialise(d, "room-row")

    @property
    def evidence_pool(self) -> DataFrame:
        return ins.evidence_pool(self.keywords, self.topics, self.hot_topics)

    # ---- model hooks ---------------------------------------------------------------------
    def model_texts(self, force: bool = False) -> DataFrame:
        """Texts a model sees: all of the gated rooms (room_id, line, sender, text).

        With ``options.model_sample`` only a uniform sample by room size.
        """
        gate = smp.model_gate(kw.script_profile(self.messages), self.options.model_least_texts, force)
        rows = smp.gated(self.features, gate)
        if self.options.model_sample:
            return smp.text_sample(rows, self.totals)
        return rows.filter(F.col("keyword_text").isNotNull()).select("room_id", "line", "sender", F.col("keyword_text").alias("text"))

    def model_sentiment(self, model, force: bool = False, binary: bool = True) -> tuple[DataFrame, DataFrame]:
        """(per room, per sender) sentiment; ``model`` maps a text column to a struct(label, score)."""
        s = self.model_texts(force).withColumn("_s", model(F.col("text")))
        label = tone_fn.sentiment_label(F.col("_s.label"), F.col("_s.score"), binary, self.options.binary_sentiment_floor)
        scored = materialise(s.select("room_id", "sender", label.alias("label")), "scored")
        return tn.sentiment_stats(scored), tn.sentiment_by_sender(scored)

    def model_toxicity(self, model, force: bool = False) -> DataFrame:
        s = self.model_texts(force).withColumn("_s", model(F.col("text")))
        return tn.toxicity_from_scores(s.select("room_id", "_s.label", "_s.score"))

    def model_clusters(self, model, force: bool = False) -> DataFrame:
        """k-means inside every room; ``model`` maps a text column to an array of floats."""
        s = self.model_texts(force).withColumn("embedding", model(F.col("text")))
        return vec.kmeans_per_room(s.select("room_id", "line", "embedding"), "line")

    def tables(self) -> dict[str, DataFrame]:
        """Every gold table; senders are replaced by their public names."""
        o = self.options
        docs, links = self.docs, ev.domain_counts(self.features)
        emoji = tn.emoji_cells(self.features)
        levels = tn.speech_levels(self.tone)
        halves = kw.head_tail_terms(docs)
        grid = ser.calendar_grid(self.days)
        bands = self.room_row.select(
            "room_id", "gini", F.col("night_percent").alias("night"), F.col("switches_per_100").alias("switch"), "rhythm",
            F.col("weekend_percent").alias("weekend"),
        )
        named = {
            "participants": self.top_people,
            "participants_by_characters": act.top_participants(self.people, o.top, "characters"),
            "participant_map": ins.participant_map(self.top_people),
            "roles": self.roles, "personas": self.personas,
            "profanity_senders": tn.profanity_senders(self.tone),
            "sender_emojis": tn.sender_emojis(emoji), "speech_levels": levels,
        }
        tables = {
            "rooms": self.room_row.drop("top_sender", "top_pair"), "daily": self.days, "monthly": act.monthly(self.days),
            "hourly": act.hourly(self.hours), "weekdays": act.weekdays(self.hours), "dayparts": act.dayparts(self.hours),
            "sessions": fl.session_stats(fl.sessions(self.flow)), "gap_histogram": fl.gap_histogram(self.gaps),
            "domains": ev.top_domains(links, o.top), "domain_entropy": ineq.entropy_bits(links),
            "attachments": ev.attachment_counts(self.features, o.top), "photo_share": ev.photo_share(self.features),
            "search_tags": ev.search_tags(self.features, o.search_tags), "search_audit": ev.search_audit(self.features),
            "room_pulse": self.pulse, "open_room": ev.open_room_profile(ev.room_events(self.notices, self.totals)),
            "keywords": self.keywords, "keywords_distinctive": self.keyword_distinctive, "topics": self.topics,
            "topic_trend": kw.topic_trend(docs, self.keywords), "keyword_halves": halves, "keyword_shift": kw.keyword_shift(halves),
            "repeated_phrases": self.phrases, "emoji_categories": tn.emoji_categories(emoji), "top_emojis": tn.top_emojis(emoji),
            "profanity": tn.profanity_stats(self.tone, self.totals), "relationship": tn.room_relationship(levels),
            "hot_topics": self.hot_topics.drop("speakers", "evidence"),
            "daily_sentiment": self.sentiment, "bursts": self.bursts, "activity_arc": ser.activity_arc(self.days),
            "calendar": grid, "calendar_months": ser.month_labels(grid), "timeline": self.timeline, "moments": self.moments,
            "sections": ins.section_gates(self.room_row, self.timeline), "reference_bands": ineq.reference_bands(bands),
        }
        names = self.aliases.select("room_id", "sender", "alias")
        for name, d in named.items():
            tables[name] = d.join(names, ["room_id", "sender"]).drop("sender")
        pairs = materialise(self.public_pairs(names), "reply-pairs")
        tables["reply_pairs"] = pairs
        return tables | self.story(names, pairs)

    def story(self, names: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
        """Facts of the room's story, with public names in place of senders."""
        public = lambda d, column: d.join(
            names.select("room_id", F.col("sender").alias(column), F.col("alias").alias("_name")), ["room_id", column], "left"
        ).withColumn(column, F.col("_name")).drop("_name")
        first = pairs.filter("rank = 1").select("room_id", F.concat_ws("→", "source", "target").alias("top_pair"))
        room = materialise(public(self.room_row.drop("top_pair"), "top_sender").join(first, ROOM, "left"), "public-room")
        people = public(self.personas, "sender")
        return {
            "chapters": public(ser.chapters(self.days, self.cells), "top_sender"),
            "milestones": ser.milestones(self.days), "streaks": ser.streaks(self.days), "silence": ser.silence(self.days),
            "gap_quantiles": fl.gap_quantiles(self.gaps), "month_peaks": ser.month_peaks(self.days),
            "highlights": ins.highlights(room), "wrapped": ins.wrapped_cards(room),
            "narrative": ins.narrative(room, self.topics, people, self.timeline),
        }

    def public_pairs(self, names: DataFrame) -> DataFrame:
        d = fl.top_pairs(self.edges, self.members)
        for end in ("source", "target"):
            d = d.join(names.select("room_id", F.col("sender").alias(end), F.col("alias").alias(f"{end}_alias")), ["room_id", end])
        return d.select("room_id", "rank", F.col("source_alias").alias("source"), F.col("target_alias").alias("target"), "replies")

    def chart_payload(self, domains: int = 24, people: int = 24, themes: int = 12) -> DataFrame:
        """One JSON document per room with the slices a front end draws."""
        def rows(d: DataFrame, name: str, *cols: str) -> DataFrame:
            return d.groupBy("room_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

        names = self.aliases.select("room_id", "sender", "alias")
        top = top_k(self.people, ROOM, [F.desc("messages"), F.asc("first_line")], people).join(names, ["room_id", "sender"])
        parts = [
            rows(self.days, "daily", "day", "messages"), rows(act.hourly(self.hours), "hourly", "hour", "messages"),
            rows(act.monthly(self.days), "monthly", "month", "messages"),
            rows(ev.top_domains(ev.domain_counts(self.features), domains), "domains", "rank", "domain", "count"),
            rows(top, "participants", "rank", "alias", "messages", "share_percent"),
            rows(self.topics.filter(F.col("place") <= themes), "topics", "place", "kind", "title", "percent"),
        ]
        d = self.totals
        for part in parts:
            d = d.join(part, ROOM, "left")
        return d.select("room_id", F.to_json(F.struct(*[c for c in d.columns if c != "room_id"])).alias("payload"))


def analyze(messages: DataFrame, options: AnalysisOptions | None = None) -> dict[str, DataFrame]:
    return Report(messages, options).tables()
