"""Percentages and averages with the rounding each report asks for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def when_count(cond: Column) -> Column:
    return F.count_if(cond)


def share_pct(part: Column, whole: Column, places: int) -> Column:
    """100*part/whole, half away from zero; null when whole is 0."""
    return F.round(F.try_divide(part.cast("decimal(20,0)") * 100, F.nullif(whole, F.lit(0)).cast("decimal(18,0)")),
                   places)


def share_pct_even(part: Column, whole: Column, places: int) -> Column:
    """As :func:`share_pct` with ties to even."""
    return F.bround(F.try_divide(part.cast("decimal(20,0)") * 100, F.nullif(whole, F.lit(0)).cast("decimal(18,0)")),
                    places)


def mean(total: Column, n: Column, places: int, kind: str = "decimal(26,6)") -> Column:
    """total/n for a decimal total that fits ``kind``, half away from zero; null when n is 0."""
    return F.round(F.try_divide(total.cast(kind), F.nullif(n, F.lit(0)).cast("decimal(18,0)")), places)


def hours_between(later: Column, earlier: Column) -> Column:
    """Exact decimal hours between two timestamps."""
    micros = (F.unix_micros(later) - F.unix_micros(earlier)).cast("decimal(20,0)")
    return (micros / F.lit(3_600_000_000).cast("decimal(10,0)")).cast("decimal(24,10)")
