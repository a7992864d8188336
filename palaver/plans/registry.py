"""Registry of runnable queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            # zone-free timestamps are read as UTC; the zone is fixed when a plan is built
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = in_utc
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def pct_sql(part: str, whole: str, digits: int = 1) -> str:
    f = 10**digits
    return f"(floor(cast({part} as double) / {whole} * 100.0 * {f} + 0.5) / {f})"


def round_sql(value: str, digits: int = 0) -> str:
    f = 10**digits
    return f"(floor(cast({value} as double) * {f} + 0.5) / {f})"
