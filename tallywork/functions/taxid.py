"""Tax identifiers: normalisation and the nine-digit checksum."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .names import BLANKS, strip

# Accepted first digits and checksum weights of a nine-digit id.
FIRST_DIGITS = ["1", "2", "5", "6", "7", "8", "9"]
WEIGHTS = [9, 8, 7, 6, 5, 4, 3, 2]


def normalize_tax_id(c: Column) -> Column:
    """STR-9: blank is null; blanks, dots and hyphens go; ``PT`` before nine digits goes."""
    bare = F.regexp_replace(F.regexp_replace(c, BLANKS, ""), r"[.\-]", "")
    bare = F.regexp_replace(bare, r"^(?i:PT)(?=\d{9}$)", "")
    return F.when(strip(c) != "", bare)


def is_nine_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]{9}$")


def valid_tax_id(c: Column) -> Column:
    """STR-10: nine digits, allowed first digit, modulo-11 check digit; null is not valid."""
    def check(n):
        # Weighted digits and the check digit (weight 1) add up to a multiple of 11; the check digit is 0 where it would be 10 or 11.
        total = sum(((F.call_function("div", n, F.lit(10 ** (8 - i))) % 10) * w for i, w in enumerate(WEIGHTS)), F.lit(0))
        rest, last = total % 11, n % 10
        return ((rest > 1) & (rest + last == 11)) | ((rest <= 1) & (last == 0))

    # The one-element array binds the number, so it is computed once and not once per digit; other texts give no number.
    text = F.coalesce(c, F.lit(""))
    number = F.when(text.rlike(f"^[{''.join(FIRST_DIGITS)}][0-9]{{8}}$"), text.try_cast("long"))
    return F.exists(F.array(number), lambda n: F.coalesce(check(n), F.lit(False)))
