"""STR-11: masks for identifiers and amounts. Two policies are in use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mask_id(c: Column, style: str = "short") -> Column:
    """``short``: 2-3 leading and 2 trailing characters stay. ``long``: 3 and 3."""
    n = F.length(c)
    if style == "short":
        lead = F.when(n <= 6, F.substring(c, 1, 2)).otherwise(F.substring(c, 1, 3))
        return F.when(n < 5, "***").otherwise(F.concat(lead, F.lit("****"), F.right(c, F.lit(2))))
    return F.when(n >= 6, F.concat(F.substring(c, 1, 3), F.lit("***"), F.right(c, F.lit(3)))).otherwise("***")


def mask_amount(c: Column, style: str = "short") -> Column:
    """``short`` hides everything; ``long`` keeps the first digit and the decimals."""
    if style == "short":
        return F.when(c.isNotNull(), "***.**")
    s = c.cast("string")
    whole, frac = F.substring_index(s, ".", 1), F.substring(F.regexp_replace(s, r"^[^.]*\.", ""), 1, 2)
    head = lambda p: F.when(F.length(p) > 1, F.concat(F.substring(p, 1, 1), F.lit("***"))).otherwise("***")
    return F.when(s.isNull(), "***").when(s.contains("."), F.concat(head(whole), F.lit("."), frac, F.lit("*"))) \
        .otherwise(head(s))
