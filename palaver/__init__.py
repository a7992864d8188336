"""palaver: analytics for conversation logs, written as PySpark DataFrame jobs."""

from palaver.options import AnalysisOptions

__all__ = ["AnalysisOptions", "analyze"]


def analyze(messages, options=None):
    """Compute every gold table for all rooms in ``messages`` (see plans.report)."""
    from palaver.plans.report import analyze as run

    return run(messages, options or AnalysisOptions())
