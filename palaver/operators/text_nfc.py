"""Unicode composition (NFC). Spark has no built-in, so only the rare rows with

combining marks or conjoining jamo pass through an Arrow-batched function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.frames import once
from palaver.functions.text import PLAIN_TEXT

NEEDS_COMPOSITION = r"[\p{M}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{F900}-\x{FAFF}\x{212A}\x{212B}]"


def compose(rows: DataFrame, column: str = "message") -> DataFrame:
    """``rows`` with ``column`` in NFC, in one pass; texts that are composed already stay in the JVM.

    The test is a column of its own: as a filter it would move below a shuffle that deals the rows,
    with everything that makes the texts.
    """

    @F.pandas_udf("string")
    def to_nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    decomposed = F.coalesce(~F.col(column).rlike(PLAIN_TEXT) & F.col(column).rlike(NEEDS_COMPOSITION), F.lit(False))
    d = once(rows, "_decomposed", F.when(decomposed, F.col(column)))
    return d.withColumn(column, F.coalesce(to_nfc(F.col("_decomposed")), F.col(column))).select(*rows.columns)
