"""Validation rules and review routing of extracted invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.confidence import REVIEW_BELOW, needs_review
from .tax import bands

# Money tolerance, amount limit, rule codes, routing reasons.
TOLERANCE = "0.02"
AMOUNT_LIMIT = 10_000
RULES = {
    "r1": ("R1-total-integrity", "net plus tax equals gross"),
    "r2": ("R2-items-sum", "line gross amounts add up to gross"),
    "r5": ("R5-vat-breakdown-mismatch", "tax bands add up to the tax total"),
    "r6": ("R6-invalid-vat-rate", "every tax rate is an accepted one"),
    "r7": ("R7-low-confidence", f"every field confidence is at least {REVIEW_BELOW}"),
    "r8": ("R8-supplier-unresolved", "the supplier needs no review"),
}
PRIORITIES = {
    "vat_invalid": 1, "math_mismatch": 1, "supplier_unresolved": 1,
    "amount_above_threshold": 1, "first_time_supplier": 2, "low_confidence": 2,
}


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(4,2)")


def totals_agree(net: str = "total_without_vat", vat: str = "vat_total", gross: str = "total_with_vat",
                 missing: bool = True) -> Column:
    """PRJ-12: |gross - (net + vat)| within tolerance; ``missing`` is the answer when a part is absent."""
    return F.coalesce(near(F.col(gross), F.col(net) + F.col(vat)), F.lit(missing))


def _compared(parts: Column, sum_: Column, want: Column, passed: Column, known: Column, missing: str) -> Column:
    """Detail of a sum rule: the sum and what it was compared with, the difference when it fails, why it was skipped."""
    text = lambda c: c.cast("string")
    fine = F.concat(parts, F.lit(" = "), text(sum_), F.lit(" agrees with "), text(want))
    off = F.concat(parts, F.lit(" = "), text(sum_), F.lit(", expected "), text(want), F.lit(" (off by "), text(F.abs(sum_ - want)), F.lit(")"))
    return F.when(known, F.when(passed, fine).otherwise(off)).otherwise(F.lit(f"Skipped: {missing}"))


def checks(invoices: DataFrame, items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row per invoice with the outcome of every rule (true = passed or not applicable).

    Items are summed per invoice before the join; bands are summed inside the
    row.  ``resolutions`` holds (invoice_id, needs_review, method, confidence).
    """
    lines = items.groupBy(F.col("invoice_id").alias("_i")).agg(
        F.sum(F.coalesce("gross_amount", F.lit(0).cast("decimal(14,2)"))).alias("_items"))
    method = F.col("method") if "method" in resolutions.columns else F.lit("unknown")
    res = resolutions.select(F.col("invoice_id").alias("_r"), F.col("needs_review").alias("unresolved"), method.alias("_method"))
    b = F.col("_bands")
    tax = F.aggregate(b, F.lit(0).cast("decimal(24,2)"), lambda acc, x: (acc + x["tax_amount"]).cast("decimal(24,2)"))
    ok = lambda c: F.coalesce(c, F.lit(True))
    return (invoices.select("id", "supplier_id", "total_with_vat", "total_without_vat", "vat_total",
                            "field_confidence", bands(F.col("vat_breakdown")).alias("_bands"))
            .join(lines, F.col("id") == F.col("_i"), "left").join(res, F.col("id") == F.col("_r"), "left")
            .select(F.col("id").alias("invoice_id"), "supplier_id", "total_with_vat",
                    F.coalesce("unresolved", F.lit(True)).alias("unresolved"),
                    totals_agree().alias("r1"),
                    ok(near(F.col("_items"), F.col("total_with_vat"))).alias("r2"),
                    ok(F.when(F.size(b) > 0, near(tax, F.col("vat_total")))).alias("r5"),
                    ok(F.forall(b, lambda x: x["is_valid"])).alias("r6"),
                    (~needs_review(F.col("field_confidence"))).alias("r7"),
                    (~F.coalesce("unresolved", F.lit(True))).alias("r8"),
                    F.col("total_without_vat").alias("_net"), F.col("vat_total").alias("_vat"), "_items", tax.alias("_tax"), b.alias("_b"),
                    F.coalesce("_method", F.lit("unknown")).alias("_method"))
            .withColumn("details", F.struct(*[c.alias(r) for r, c in _details().items()]))
            .drop("_net", "_vat", "_items", "_tax", "_b", "_method"))


def _details() -> dict[str, Column]:
    c = F.col
    gross, net, vat = c("total_with_vat"), c("_net"), c("_vat")
    wrong = F.transform(F.filter("_b", lambda x: ~x["is_valid"]), lambda x: F.concat(F.regexp_replace(x["rate"].cast("string"), r"\.0+$", ""), F.lit("%")))
    return {
        "r1": _compared(F.concat(net.cast("string"), F.lit(" + "), vat.cast("string")), net + vat, gross, c("r1"),
                        (gross + net + vat).isNotNull(), "a total is missing"),
        "r2": _compared(F.lit("sum of lines"), c("_items"), gross, c("r2"), c("_items").isNotNull() & gross.isNotNull(), "no lines or no total"),
        "r5": _compared(F.lit("sum of bands"), c("_tax"), vat, c("r5"), (F.coalesce(F.size("_b"), F.lit(0)) > 0) & vat.isNotNull(), "no bands or no tax total"),
        "r6": F.when(c("r6"), "all rates are accepted ones").otherwise(F.concat(F.lit("Rates not accepted: "), F.array_join(wrong, ", "))),
        "r7": F.when(c("r7"), f"every confidence is at least {REVIEW_BELOW}").otherwise(f"a confidence is below {REVIEW_BELOW}"),
        "r8": F.concat(F.when(c("r8"), "resolved by ").otherwise("needs review, method "), c("_method")),
    }


def rule_rows(checked: DataFrame) -> DataFrame:
    """VAL-1: six rows per invoice (rule_code, rule_description, passed, detail); a detail tells a skipped rule from a passed one."""
    rows = [F.struct(F.lit(code).alias("rule_code"), F.lit(text).alias("rule_description"), F.col(c).alias("passed"), F.col("details")[c].alias("detail"))
            for c, (code, text) in RULES.items()]
    return checked.select("invoice_id", F.inline(F.array(*rows)))


def route(checked: DataFrame, first_time: DataFrame) -> DataFrame:
    """VAL-6: reasons to review an invoice and whether it can be accepted as it is.

    ``first_time`` holds (supplier_id, first_time), one row per supplier.
    """
    flags = {
        "vat_invalid": ~F.col("r6"),
        "math_mismatch": ~(F.col("r1") & F.col("r2") & F.col("r5")),
        "supplier_unresolved": F.col("unresolved"),
        "amount_above_threshold": F.col("total_with_vat") > AMOUNT_LIMIT,
        "first_time_supplier": F.coalesce("first_time", F.lit(True)) & ~F.col("unresolved"),
        "low_confidence": ~F.col("r7"),
    }
    found = [F.when(cond, F.struct(F.lit(r).alias("reason_code"), F.lit(PRIORITIES[r]).alias("priority")))
             for r, cond in flags.items()]
    return (checked.join(first_time, "supplier_id", "left")
            .withColumn("reasons", F.filter(F.array(*found), lambda x: x.isNotNull()))
            .select("invoice_id", (F.size("reasons") == 0).alias("auto_accept"), "reasons"))


def queue_rows(routed: DataFrame) -> DataFrame:
    """VAL-6: one pending queue row per reason."""
    return routed.select("invoice_id", F.inline("reasons")).withColumn("status", F.lit("pending"))


def first_time_suppliers(log: DataFrame) -> DataFrame:
    """AG-31: per supplier, at most one automatic resolution so far."""
    return (log.where(F.col("resolved_supplier_id").isNotNull())
            .groupBy(F.col("resolved_supplier_id").alias("supplier_id"))
            .agg((F.count_if(F.col("created_by") == "auto") <= 1).alias("first_time")))


def exact_totals(fields: DataFrame) -> DataFrame:
    """VAL-2: subtotal + vat_amount must equal total exactly; the three arrive as text.

    Numbers of up to 18 digits before and behind the point, exponents written out, are compared as they are;
    longer ones, and exponents of more than four digits, count as unreadable and are never rounded.
    """
    parts = ["subtotal", "vat_amount", "total"]
    missing = F.lit(False)
    for p in parts:
        missing = missing | F.col(p).isNull()
    def read(p: str) -> Column:
        c = F.trim(p)
        exponent = F.regexp_extract(c, r"[eE]([+-]?[0-9]{1,4})$", 1)
        behind = F.regexp_extract(c, r"[.]([0-9]*)", 1)
        digits = F.concat(F.regexp_extract(c, r"^[+-]?([0-9]*)", 1), behind)
        zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
        decimals = F.length(behind) - F.coalesce(exponent.try_cast("int"), F.lit(0)) - zeros
        exact = (decimals <= 18) & (~c.rlike("[eE]") | (exponent != ""))
        return F.when(exact, c.try_cast("decimal(36,18)"))
    n = {p: read(p) for p in parts}
    unreadable = n["subtotal"].isNull() | n["vat_amount"].isNull() | n["total"].isNull()
    both = (n["subtotal"] + n["vat_amount"]).cast("decimal(37,18)")
    gap = F.abs(both - n["total"])
    return fields.withColumns({
        "outcome": F.when(missing, "skipped").when(unreadable, "unreadable").when(gap != 0, "mismatch").otherwise("exact"),
        "discrepancy": F.when(~missing, gap),
    }).withColumn("valid", F.col("outcome").isin("skipped", "exact"))


def terminal_status(runs: DataFrame, errors: str = "errors", math_valid: str = "math_valid") -> DataFrame:
    """PRJ-15: failed on any error or bad arithmetic, else validated; joined reasons; status for the caller."""
    bad = (F.coalesce(F.size(errors), F.lit(0)) > 0) | ~F.coalesce(F.col(math_valid), F.lit(True))
    return runs.withColumns({
        "final_status": F.when(bad, "failed").otherwise("validated"),
        "review_reason": F.when(bad, F.array_join(F.coalesce(F.col(errors), F.array().cast("array<string>")), "; ")),
        "caller_status": F.when(bad, "error").otherwise("ok"),
    })


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """R-1: one row per broken rule, all rules in one scan; a rule that evaluates to null holds."""
    broken = [F.when(~holds, F.lit(name)) for name, holds in rules.items()]
    return df.select(key, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("rule"))


def invoice_rules() -> dict[str, Column]:
    """Standing rules of the invoice table."""
    c = F.col
    statuses = ["processing", "ok", "requires_review", "duplicate", "fiscal_duplicate", "error",
                "duplicado", "failed", "validated"]
    return {
        "source_type": c("source_type").isin("gmail", "drive", "manual", "storage"),
        "processing_status": c("processing_status").isin(statuses),
        "payment_status": c("payment_status").isin("unpaid", "partial", "paid"),
        "totals_agree": totals_agree(),
    }


def queue_item_rules() -> dict[str, Column]:
    c = F.col
    return {"reason_code": c("reason_code").isin(list(PRIORITIES)), "priority": c("priority").isin(1, 2, 3),
            "status": c("status").isin("pending", "in_review", "resolved", "auto_resolved")}


def client_rules() -> dict[str, Column]:
    c = F.col
    return {
        "ingest_channel": c("drive_folder_id").isNotNull() | c("allows_manual_upload"),
        "capital_not_negative": c("capital_social") >= 0,
        "legal_name_length": F.length("legal_name").between(1, 200),
        "status": c("status").isin("draft", "active", "inactive", "archived"),
        "legal_form": c("legal_form").isin("LDA", "SA", "ENI", "UNIPESSOAL", "OUTRO"),
    }


def visible_rows(df: DataFrame, memberships: DataFrame, key: str, member_key: str, allowed: Column) -> DataFrame:
    """R-2: rows of ``df`` for which the caller has an allowed membership row."""
    return df.join(memberships.where(allowed).select(F.col(member_key).alias(key)), key, "left_semi")
