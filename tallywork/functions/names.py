"""Name normalisation. Three rules exist because three comparisons use them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: ASCII and Unicode blanks.
BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def match_name(c: Column) -> Column:
    """STR-1: lower case, anything but ASCII word characters becomes one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+", " "))


def lookup_name(c: Column) -> Column:
    """STR-2: lower case, only comma, dot, hyphen and ampersand become a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[,.\-&]", " "), BLANKS, " "))


def compare_name(c: Column) -> Column:
    """STR-3: as STR-1, keeping letters and digits of every script."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))


def squeeze(c: Column) -> Column:
    """Trimmed, blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, BLANKS, " ")))
