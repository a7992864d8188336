"""Small DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-row generator.

    A filter on it (or on columns derived from it) is then not copied below the
    projection, so the value is computed once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
