"""Options of an analysis run; the defaults are the documented display limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


#: One machine's memory limits of the original tool, for results that are to be compared with its own.
SMALL_MACHINE = {"signals_from_samples": True, "evidence_chars": 180, "model_sample": True}


@dataclass(frozen=True)
class AnalysisOptions:
    top: int = 30                       # participants, domains, markers
    search_tags: int = 30
    topics: int | None = 12             # cards shown; None: all
    period_cards: int | None = 4        # of them months
    burst_method: str = "heuristic"     # or "mad"
    privacy: str = "masked"             # or "anonymous"
    since: str | None = None            # inclusive YYYY-MM-DD
    supplement_weight: float = 0.5
    binary_sentiment_floor: float = 0.72
    model_sample: bool = False          # models see a sample by room size instead of every text
    model_least_texts: int = 48         # texts of a room from which models run on it
    signals_from_samples: bool = False  # hot topics count signals in the day's samples only
    evidence_chars: int | None = None   # characters of a text in which evidence is looked for; None: all
    graph_terms: int | None = 140       # most frequent terms of a room in the topic graph; None: all
    large_room: int | None = 50_000     # messages from which a room's topics need more support; None: never
    frequency_lane: int | None = 80     # keywords of a room in the frequency lane at most; None: all
    score_lane: int | None = 200        # and in the lane of scores
    stop_terms: tuple[str, ...] = field(default_factory=tuple)
    glossary: tuple[tuple[str, str, float], ...] = ()  # (word, tag, score) for the dictionary of every room
    dictionary: bool = False            # cut glued Hangul by the room's user words and the glossary
    tokenizer: Callable | None = None   # hook: text column to an array of tokens that come first
    chunk_rows: int = 200_000           # rows of one room that share a task

    @property
    def keyword_limit(self) -> int:
        return max(120, 3 * self.top)
