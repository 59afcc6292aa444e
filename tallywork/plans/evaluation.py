"""Extractions scored field by field against expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import compare_name, squeeze, strip
from ..functions.similarity import indel_ratio
from ..operators.rules import totals_agree

# Scored and required fields, tolerances, gate limits, parity fields.
SCORED = ["invoice_number", "issue_date", "due_date", "issuer_name", "issuer_nif", "receiver_name", "receiver_nif",
          "total_with_vat", "total_without_vat", "vat_total", "vat_breakdown", "document_type", "items"]
REQUIRED = ["invoice_number", "issue_date", "issuer_name", "issuer_nif", "total_with_vat", "document_type"]
MONEY_TOLERANCE, QUANTITY_TOLERANCE = "0.02", "0.001"
GATE = {"overall": 95.0, "math": 0.0, "field": 90.0, "null": 10.0}
PARITY_EXACT = ["subtotal", "vat_amount", "total", "vat_rate", "currency"]
PARITY_FUZZY = ["supplier_name", "supplier_nif", "invoice_number", "invoice_date"]
PARITY_PASS = 0.98


def _both(e: Column, a: Column, same: Column) -> Column:
    """Both absent is correct, one absent is not."""
    return F.when(e.isNull() & a.isNull(), True).when(e.isNull() | a.isNull(), False).otherwise(same)


def exact_text(e: Column, a: Column) -> Column:
    return _both(e, a, squeeze(e) == squeeze(a))


def same_value(e: Column, a: Column) -> Column:
    return _both(e, a, e.cast("string") == a.cast("string"))


def close_name(e: Column, a: Column) -> Column:
    """Equal names need no normal form; of others it is made once: the one-element array binds it."""
    near = lambda p: p["x"].contains(p["y"]) | p["y"].contains(p["x"]) | (F.levenshtein(p["x"], p["y"], 3) >= 0)
    forms = F.array(F.struct(compare_name(e).alias("x"), compare_name(a).alias("y")))
    return _both(e, a, F.when(e == a, True).otherwise(F.exists(forms, near)))


def same_digits(e: Column, a: Column) -> Column:
    digits = lambda c: F.regexp_replace(c.cast("string"), r"\D", "")
    return _both(e, a, digits(e) == digits(a))


def close_number(e: Column, a: Column, tolerance: str = MONEY_TOLERANCE) -> Column:
    d = lambda c: c.cast("decimal(36,12)")
    return _both(e, a, F.abs(d(e) - d(a)) <= F.lit(tolerance).cast("decimal(6,4)"))


def close_description(e: Column, a: Column) -> Column:
    def near(p):
        edits, longest = F.levenshtein(p["x"], p["y"]), F.greatest(F.length(p["x"]), F.length(p["y"]))
        return edits <= F.greatest(F.lit(5), F.floor(longest / 5))
    forms = F.array(F.struct(compare_name(e).alias("x"), compare_name(a).alias("y")))
    return _both(e, a, F.when(e == a, True).otherwise(F.exists(forms, near)))


def _list(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def same_bands(e: Column, a: Column) -> Column:
    """SCO-2: equally many bands; by rate (the last actual band of a rate counts), base and amount within tolerance."""
    def matches(x):
        y = F.try_element_at(F.filter(a, lambda b: b["rate"].eqNullSafe(x["rate"])), F.lit(-1))
        return y.isNotNull() & close_number(x["base"], y["base"]) & close_number(x["amount"], y["amount"])
    return _both(_list(e), _list(a), (F.size(e) == F.size(a)) & F.forall(e, matches))


def in_line_order(items: Column) -> Column:
    """LIM-6: items by line number, a missing one as 0."""
    no = lambda x: F.coalesce(x["line_number"], F.lit(0))
    return F.array_sort(items, lambda x, y: F.when(no(x) < no(y), -1).when(no(x) > no(y), 1).otherwise(0))


def same_items(e: Column, a: Column) -> Column:
    """SCO-3: equally many items, equal in line order: description, quantity, amounts and rate."""
    def pair(x, y):
        ok = close_description(x["description"], y["description"]) & x["vat_rate"].eqNullSafe(y["vat_rate"])
        ok = ok & close_number(x["quantity"], y["quantity"], QUANTITY_TOLERANCE)
        for c in ("unit_price", "net_amount", "vat_amount", "gross_amount"):
            ok = ok & close_number(x[c], y[c])
        return ok
    return _both(_list(e), _list(a), (F.size(e) == F.size(a)) & F.forall(
        F.zip_with(in_line_order(e), in_line_order(a), pair), lambda ok: F.coalesce(ok, F.lit(False))))


SCORERS = {
    "invoice_number": exact_text, "issue_date": same_value, "due_date": same_value, "issuer_name": close_name,
    "issuer_nif": same_digits, "receiver_name": close_name, "receiver_nif": same_digits,
    "total_with_vat": close_number, "total_without_vat": close_number, "vat_total": close_number,
    "vat_breakdown": same_bands, "document_type": same_value, "items": same_items,
}


def case_scores(expected: DataFrame, actual: DataFrame, key: str = "case_id") -> DataFrame:
    """SCO-1, JN-21: one row per case with a score per field, whether all are right, and the arithmetic check.

    Fields named in an optional ``manual_review`` list of the expected row are
    left out.  A case without an actual row is skipped.
    """
    fields = [f for f in SCORED if f in expected.columns and f in actual.columns]
    e = expected.select(key, *[F.col(f).alias(f"e_{f}") for f in fields],
                        *(["manual_review"] if "manual_review" in expected.columns else []))
    a = actual.select(F.col(key).alias("_k"), *[F.col(f).alias(f"a_{f}") for f in fields],
                      *([totals_agree().alias("_sums"), (F.col("total_with_vat") + F.col("total_without_vat")
                         + F.col("vat_total")).isNotNull().alias("_summable")]
                        if {"total_with_vat", "total_without_vat", "vat_total"} <= set(actual.columns) else []))
    left_out = (lambda f: F.coalesce(F.array_contains("manual_review", f), F.lit(False))) if "manual_review" in e.columns \
        else (lambda f: F.lit(False))
    scores = [F.when(~left_out(f), F.struct(
        F.lit(f).alias("field"), SCORERS[f](F.col(f"e_{f}"), F.col(f"a_{f}")).alias("correct"),
        (F.col(f"e_{f}").isNotNull() & F.col(f"a_{f}").isNull()).alias("null_error"))) for f in fields]
    joined = e.join(a, F.col(key) == F.col("_k"), "left")
    math_ok = F.when(F.col("_summable"), F.col("_sums")) if "_summable" in a.columns else F.lit(None).cast("boolean")
    out = joined.select(key, F.col("_k").isNull().alias("skipped"),
                        F.filter(F.array(*scores), lambda s: s.isNotNull()).alias("scores"), math_ok.alias("math_ok"))
    return out.withColumn("all_correct", F.forall("scores", lambda s: s["correct"]))


def field_scores(scored: DataFrame, key: str = "case_id") -> DataFrame:
    """JN-21: scores as rows (case, field, correct, null_error)."""
    return scored.where("NOT skipped").select(key, F.inline("scores"))


def field_accuracy(scored: DataFrame) -> DataFrame:
    """AG-33: per field the share correct, and the null rate over all evaluated cases for required fields."""
    n = scored.agg(F.count_if(~F.col("skipped"))).scalar()
    rows = field_scores(scored, "skipped").groupBy("field").agg(
        (F.count_if("correct") * 100 / F.count("*")).alias("accuracy"), F.count_if("null_error").alias("_nulls"))
    return rows.select("field", "accuracy", F.when(F.col("field").isin(REQUIRED), F.col("_nulls") * 100 / n).alias("null_rate"))


def overall_accuracy(scored: DataFrame) -> DataFrame:
    """AG-33: case counts, share of cases without any error, share of checkable cases with wrong arithmetic."""
    done, checked = ~F.col("skipped"), ~F.col("skipped") & F.col("math_ok").isNotNull()
    passed = F.count_if(done & F.col("all_correct"))
    pct = lambda part, whole: F.try_divide(part * 100, whole)
    return scored.agg(
        F.count("*").alias("total_cases"), F.count_if(done).alias("evaluated"), F.count_if("skipped").alias("skipped"),
        passed.alias("pass_count"), pct(passed, F.count_if(done)).alias("overall_accuracy"),
        pct(F.count_if(checked & ~F.col("math_ok")), F.count_if(checked)).alias("math_error_rate"))


def gate_reasons(overall: DataFrame, fields: DataFrame) -> DataFrame:
    """AG-35: the conditions that keep the gate shut, as rows (measure, field, value); no row means it passes."""
    o = overall.select(F.inline(F.filter(F.array(
        F.when(F.col("overall_accuracy").isNull() | (F.col("overall_accuracy") < GATE["overall"]),
               F.struct(F.lit("overall_accuracy").alias("measure"), F.lit(None).cast("string").alias("field"),
                        F.col("overall_accuracy").alias("value"))),
        F.when(F.col("math_error_rate") > GATE["math"],
               F.struct(F.lit("math_error_rate").alias("measure"), F.lit(None).cast("string").alias("field"),
                        F.col("math_error_rate").alias("value")))), lambda x: x.isNotNull())))
    f = fields.select(F.inline(F.filter(F.array(
        F.when(F.col("accuracy") < GATE["field"], F.struct(F.lit("accuracy").alias("measure"), F.col("field"), F.col("accuracy").alias("value"))),
        F.when(F.col("null_rate") > GATE["null"], F.struct(F.lit("null_rate").alias("measure"), F.col("field"), F.col("null_rate").alias("value")))),
        lambda x: x.isNotNull())))
    return o.unionByName(f)


def accuracy_deltas(history: DataFrame) -> DataFrame:
    """WN-4: change of each field's accuracy against the previous report (report_date, field, accuracy)."""
    w = Window.partitionBy("field").orderBy("report_date")
    return history.withColumn("delta", F.col("accuracy") - F.lag("accuracy").over(w))


def parity(extracted: DataFrame, expected: DataFrame, key: str = "case_id") -> DataFrame:
    """AG-34, SCO-4: mean of nine field scores per case; fields are compared as trimmed text."""
    names = [*PARITY_FUZZY, *PARITY_EXACT]
    x = extracted.select(F.col(key).alias("_k"), *[strip(F.col(f).cast("string")).alias(f"x_{f}") for f in names])
    e = expected.select(key, *[strip(F.col(f).cast("string")).alias(f"e_{f}") for f in names])
    j = e.join(x, F.col(key) == F.col("_k"))
    cols = {}
    for f in names:
        a, b = F.col(f"x_{f}"), F.col(f"e_{f}")
        # Equal values need no comparison by characters: the function sees nulls in their place.
        ratio = F.when(a == b, 1.0).otherwise(indel_ratio(F.when(a != b, a), F.when(a != b, b)) if f in PARITY_FUZZY else F.lit(0.0))
        cols[f] = F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(ratio)
    out = j.select(key, *[c.alias(f) for f, c in cols.items()])
    overall = sum((F.col(f) for f in names), F.lit(0.0)) / len(names)
    return out.withColumn("overall_score", overall).withColumn("passing", F.col("overall_score") >= PARITY_PASS)


def parity_gate(scores: DataFrame) -> DataFrame:
    """AG-34: mean over cases, lowest case, and whether the gate opens."""
    s = scores.agg(F.avg("overall_score").alias("mean_score"), F.min("overall_score").alias("lowest"), F.count("*").alias("cases"))
    return s.withColumn("passed", (F.col("mean_score") >= PARITY_PASS) & (F.col("lowest") >= 0.95))
