"""Metrics per period and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def period_end(ts: Column, period: str) -> Column:
    """Last date of the week (Sunday), month or quarter a timestamp falls in."""
    d = F.to_date(ts)
    if period == "W":
        return F.next_day(F.date_sub(d, 1), "SU")
    if period == "ME":
        return F.last_day(d)
    if period == "QE":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    raise ValueError(f"unknown period {period!r}")


def metric_by_period(df: DataFrame, date_col: str = "created_at", value_col: str = "value",
                     period: str = "ME") -> DataFrame:
    """AG-29: sum, mean and count per period, empty periods included (0, null, 0)."""
    v = F.col(value_col).cast("decimal(24,6)")
    sums = (df.where(F.col(date_col).isNotNull()).groupBy(period_end(F.col(date_col), period).alias("period"))
            .agg(F.sum(v).alias("s"), F.count(v).alias("n")))
    step = {"W": "INTERVAL 7 DAYS", "ME": "INTERVAL 1 MONTH", "QE": "INTERVAL 3 MONTHS"}[period]
    ends = sums.agg(F.min("period").alias("a"), F.max("period").alias("z"))
    if period != "W":  # step over first days of months, then take the month's last day
        ends = ends.select(F.trunc("a", "month").alias("a"), F.trunc("z", "month").alias("z"))
    calendar = ends.select(F.explode(F.sequence("a", "z", F.expr(step))).alias("period"))
    if period != "W":
        calendar = calendar.select(F.last_day("period").alias("period"))
    mean = F.bround(F.try_divide(F.col("s"), F.nullif(F.col("n"), F.lit(0)).cast("decimal(18,0)")), 2)
    return (calendar.join(sums, "period", "left")
            .select("period", F.coalesce("s", F.lit(0).cast("decimal(34,6)")).alias("sum"), mean.alias("mean"),
                    F.coalesce("n", F.lit(0)).alias("count"))
            .orderBy("period"))


def hours_saved(df: DataFrame, manual: str = "manual_minutes", automated: str = "automated_minutes") -> DataFrame:
    """PRJ-7: hours and percentage saved; the percentage is null where manual time is 0."""
    saved = (F.col(manual) - F.col(automated)).cast("decimal(24,4)")
    pct = F.bround(F.try_divide(saved * 100, F.nullif(F.col(manual), F.lit(0)).cast("decimal(18,4)")), 1)
    return df.withColumns({"hours_saved": (F.col(manual) - F.col(automated)) / F.lit(60.0), "savings_pct": pct})


def error_reduction(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """PRJ-8: reduction in percent and absolute change; 0 percent when there was nothing before."""
    change = F.col(before) - F.col(after)
    pct = F.bround(F.try_divide(change.cast("decimal(20,2)") * 100,
                                F.nullif(F.col(before), F.lit(0)).cast("decimal(18,0)")), 1)
    return df.withColumns({"reduction_pct": F.coalesce(pct, F.lit(0).cast("decimal(10,1)")),
                           "absolute_change": change.cast("double")})
