"""Rounding, shares and display formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; 0 when the whole is 0."""
    return F.when(whole > 0, half_up(part.cast("double") / whole * 100.0, digits)).otherwise(F.lit(0.0))


def percent_or_null(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, half_up(part.cast("double") / whole * 100.0, digits))


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(F.coalesce(value, F.lit(0.0)), 1)))


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, no trailing ``.0``.

    A tie is decided by the binary value of the quotient, as printing a double does:
    the quotient times 2^52 is an exact integer and is compared with n * 2^52 / unit.
    """
    step = unit // 10
    rest = F.pmod(n, F.lit(step)) * 2
    exact = (n / F.lit(float(unit)) * F.lit(float(2**52))).cast("bigint").cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)")
    tie_up = exact >= n.cast("decimal(12,0)") * F.lit(2**52).cast("decimal(17,0)")
    up = F.when((rest > step) | ((rest == step) & tie_up), 1).otherwise(0)
    tenths = F.floor(n / F.lit(step)) + up
    digit = F.pmod(tenths, F.lit(10))
    return F.concat(
        F.floor(tenths / 10).cast("string"),
        F.when(digit == 0, F.lit("")).otherwise(F.concat(F.lit("."), digit.cast("string"))),
    )


def compact_number(value: Column) -> Column:
    """12,345 -> 1.2만, 123,456,789 -> 1.2억."""
    n = half_up(value).cast("bigint")
    whole = lambda unit: half_up(n / F.lit(float(unit))).cast("bigint").cast("string")
    return (
        F.when(n.isNull() | (value < 0), F.lit("0"))
        .when(n >= 1_000_000_000, F.concat(whole(100_000_000), F.lit("억")))
        .when(n >= 100_000_000, F.concat(_tenths(n, 100_000_000), F.lit("억")))
        .when(n >= 1_000_000, F.concat(whole(10_000), F.lit("만")))
        .when(n >= 10_000, F.concat(_tenths(n, 10_000), F.lit("만")))
        .otherwise(F.format_number(n, 0))
    )


def gap_text(minutes: Column) -> Column:
    """A reply gap in words: seconds below one minute, else minutes."""
    seconds = F.greatest(F.lit(1.0), half_up(minutes * 60.0)).cast("bigint").cast("string")
    return (
        F.when(minutes.isNull(), F.lit("—"))
        .when(minutes < 1.0 / 60.0, F.lit("1초 미만"))
        .when(minutes < 1, F.concat(seconds, F.lit("초")))
        .when(minutes < 10, F.concat(F.regexp_replace(half_up(minutes, 1).cast("string"), r"\.0$", ""), F.lit("분")))
        .otherwise(F.concat(half_up(minutes).cast("bigint").cast("string"), F.lit("분")))
    )


def month_day(day: Column) -> Column:
    return F.concat(F.month(day).cast("string"), F.lit("/"), F.dayofmonth(day).cast("string"))


def epoch_ms(ts: Column) -> Column:
    """Wall-clock milliseconds; TIMESTAMP_NTZ read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000.0)
