"""Per-field confidence maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scored fields with their weight, default confidence, review limit.
WEIGHTS = {
    "invoice_number": 2, "issue_date": 2, "issuer_name": 2, "issuer_nif": 2, "total_with_vat": 2,
    "receiver_name": 1, "receiver_nif": 1, "total_without_vat": 1, "vat_total": 1, "currency": 1,
}
DEFAULT = 0.5
REVIEW_BELOW = 0.7
#: Confidences as exact numbers: 15 decimals are all that a double near one holds.
EXACT = "decimal(22,15)"
EXACT_SUM = "decimal(32,15)"


def of_field(fc: Column, field: str) -> Column:
    return F.coalesce(F.try_element_at(fc, F.lit(field)), F.lit(DEFAULT))


def complete_map(fc: Column) -> Column:
    """AG-36: the map over exactly the scored fields, gaps filled with the default."""
    return F.create_map(*[x for f in WEIGHTS for x in (F.lit(f), of_field(fc, f))])


def overall(fc: Column) -> Column:
    """AG-36: weighted mean to two places (half up)."""
    total = sum(((of_field(fc, f).cast(EXACT) * w).cast(EXACT_SUM) for f, w in WEIGHTS.items()), F.lit(0).cast(EXACT_SUM))
    # whole hundredths of the doubled mean, so that halves are met exactly
    double = 2 * sum(WEIGHTS.values())
    hundredths = F.floor((total * 200 + sum(WEIGHTS.values())).cast("decimal(36,15)") / double)
    return hundredths.cast("decimal(9,0)") / 100


def needs_review(fc: Column) -> Column:
    """VAL-7: some field is below the limit (a value at the limit is not); no map, no review."""
    return F.coalesce(F.exists(F.map_values(fc), lambda v: v < REVIEW_BELOW), F.lit(False))


def band(c: Column) -> Column:
    """PRJ-6."""
    return F.when(c >= 0.85, "high").when(c >= 0.5, "medium").otherwise("low")
