"""STR-12: slugs, truncation and durations as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .names import strip


def slugify(c: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(c)), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]", ""), r"-+", "-")
    return F.regexp_replace(s, r"^-|-$", "")


def truncate(c: Column, limit: int) -> Column:
    if limit < 4:
        return F.substring(c, 1, max(limit, 0))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def duration_text(ms: Column) -> Column:
    """``1h 2m 3s``; below a second ``Nms``; negative is ``0ms``."""
    sec = F.floor(ms / 1000)
    part = lambda v, unit: F.when(v > 0, F.concat(v.cast("string"), F.lit(unit)))
    long = F.concat_ws(" ", part(F.floor(sec / 3600), "h"), part(F.floor(sec / 60) % 60, "m"), part(sec % 60, "s"))
    return (F.when(ms < 0, "0ms").when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))
            .otherwise(long))
