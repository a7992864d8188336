"""All registered queries and their SQL statements."""

from palaver.plans import activity_queries, chat_queries, flow_queries, insight_queries, sketch_queries, stream_queries, text_queries, topic_queries  # noqa: F401
from palaver.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
