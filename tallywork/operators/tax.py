"""Tax bands of an invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import strip

# Tax codes and the accepted rates (percent).
TAX_CODES = {"IVA": "IVA", "VAT": "VAT", "TVA": "TVA", "MWST": "MwSt"}
VALID_RATES = [0, 6, 13, 23]


def bands(breakdown: Column) -> Column:
    """TAX-1: the raw band array as structs (tax_code, rate, taxable_base, tax_amount, is_valid).

    A raw band may name its parts in several ways; the first name that is filled
    wins.  Bands without a rate are left out; no array gives null.
    """
    money = "decimal(14,2)"
    zero = F.lit(0).cast(money)

    def one(b):
        rate = F.coalesce(b["rate"], b["vat_rate"])
        code = F.upper(strip(b["tax_code"]))
        known = F.create_map(*[F.lit(x) for pair in TAX_CODES.items() for x in pair])
        return F.struct(
            F.coalesce(F.try_element_at(known, code), F.lit("IVA")).alias("tax_code"), rate.alias("rate"),
            F.coalesce(b["taxable_base"], b["base"], zero).cast(money).alias("taxable_base"),
            F.coalesce(b["tax_amount"], b["vat_amount"], b["amount"], zero).cast(money).alias("tax_amount"),
            rate.isin(VALID_RATES).alias("is_valid"))

    with_rate = F.filter(breakdown, lambda b: F.coalesce(b["rate"], b["vat_rate"]).isNotNull())
    return F.transform(with_rate, one)


def tax_rows(invoices: DataFrame) -> DataFrame:
    """TAX-1: one row per usable tax band."""
    return (invoices.select(F.col("id").alias("invoice_id"), F.explode(bands(F.col("vat_breakdown"))).alias("b"))
            .select("invoice_id", "b.*"))
