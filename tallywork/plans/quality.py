"""Extraction quality, missing fields, confidence and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.percentiles import exact_percentiles
from ..operators.ratios import mean, share_pct
from ..functions.confidence import EXACT, EXACT_SUM
from .accounting import display_name

# Statuses and header fields of the reports.
STATUSES = ["ok", "duplicado", "requires_review", "failed", "processing"]
HEADER_FIELDS = ["receiver_name", "receiver_nif", "issuer_nif", "issuer_name", "invoice_number",
                 "issue_date", "due_date", "currency", "document_type", "atcud"]
CHECK_RESULT = T.StructType([T.StructField("valid", T.BooleanType()),
                             T.StructField("errors", T.ArrayType(T.StringType()))])


def since(column: str, days: int, as_of: Column) -> Column:
    """Rows of the last ``days`` days before ``as_of`` (inclusive bound)."""
    return F.col(column) >= as_of - F.make_dt_interval(days=F.lit(days))


def month_of(column: str) -> str:
    """Name of the partition column of a table stored by month of ``column``."""
    return f"{column}_month"


def recent(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Rows of :func:`since`; of a table stored by month only the months of the window are listed and read."""
    rows, month = df.where(since(column, days, as_of)), month_of(column)
    if month not in df.columns:
        return rows
    first = F.date_trunc("month", as_of - F.make_dt_interval(days=F.lit(days))).cast("date")
    return rows.where(F.col(month) >= first)


def latest(df: DataFrame, column: str) -> Column:
    """Newest value of ``column`` as a scalar subquery; of a table stored by month only its last month is read."""
    month = month_of(column)
    if month not in df.columns:
        return df.agg(F.max(column)).scalar()
    return df.where(F.col(month) >= df.agg(F.max(month)).scalar()).agg(F.max(column)).scalar()


def store_by_month(df: DataFrame, column: str, path: str, columns: dict[str, str] | None = None) -> None:
    """Write ``df`` in a folder per month of ``column``; months are split and merged to files of like size.

    With ``columns`` (expressions by name) these and ``column`` are stored; they are computed when the
    rows have been moved and sorted, so that wide values are only written.
    """
    month = month_of(column)
    moved = df.withColumn(month, F.trunc(F.col(column).cast("date"), "month")).hint("rebalance", month).sortWithinPartitions(month)
    if columns is not None:
        moved = moved.select(column, *[F.expr(e).alias(c) for c, e in columns.items()], month)
    moved.write.mode("overwrite").partitionBy(month).parquet(path)


def _status(s: str) -> Column:
    return F.col("processing_status") == s


def status_counters(invoices: DataFrame) -> DataFrame:
    """AG-5: one row with the total and the five known statuses."""
    return invoices.agg(F.count("*").alias("total"), *[F.count_if(_status(s)).alias(s) for s in STATUSES])


def extraction_quality(invoices: DataFrame) -> DataFrame:
    """AG-9: daily counts and rates, newest day first."""
    n = F.count("*")
    named = {"ok_count": "ok", "review_count": "requires_review", "fail_count": "failed",
             "duplicate_count": "duplicado"}
    rates = {"ok_rate": "ok", "review_rate": "requires_review", "fail_rate": "failed"}
    return (invoices.groupBy(F.date_trunc("day", "created_at").alias("day"))
            .agg(n.alias("total"), *[F.count_if(_status(s)).alias(c) for c, s in named.items()],
                 *[share_pct(F.count_if(_status(s)), n, 2).alias(c) for c, s in rates.items()])
            .orderBy(F.desc("day")))


def check_errors(invoices: DataFrame, *keep: str) -> DataFrame:
    """JSON-1: one row per error text of the stored arithmetic check; no errors, no rows."""
    parsed = F.from_json("math_validation_result", CHECK_RESULT)
    return (invoices.select(*keep, parsed.alias("_r"))
            .select(*keep, F.col("_r.valid").alias("valid"), F.explode("_r.errors").alias("error")))


def check_errors_by_day(invoices: DataFrame) -> DataFrame:
    """AG-10: error rows of failed checks per day and rule (a row per error, not per invoice)."""
    rules = ["r1_total_integrity", "r2_items_sum", "r3_vat_sum", "r4_line_coherence",
             "r5_breakdown_mismatch", "r6_invalid_vat_rate", "r7_credit_note"]
    return (check_errors(invoices, "created_at").where("valid = false")
            .groupBy(F.date_trunc("day", "created_at").alias("day"))
            .agg(F.count("*").alias("invoices_with_math_errors"),
                 *[F.count_if(F.col("error").startswith(r[:2].upper())).alias(r) for r in rules])
            .orderBy(F.desc("day")))


def vat_mismatches(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """JN-4: invoice by tax error text (R5, R6); exploded and filtered before the join."""
    hits = (check_errors(invoices, "id", "invoice_number", "supplier_id", "vat_total",
                         "processing_status", "created_at")
            .where(F.col("error").startswith("R5") | F.col("error").startswith("R6")))
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("nif").alias("supplier_nif"),
                         display_name().alias("supplier_name"))
    return (hits.join(s, "supplier_id", "left")
            .select("id", "invoice_number", "supplier_nif", "supplier_name", "vat_total",
                    "processing_status", "created_at", F.col("error").alias("mismatch_detail"))
            .orderBy(F.desc("created_at")))


def supplier_quality(suppliers: DataFrame, categories: DataFrame, invoices: DataFrame) -> DataFrame:
    """AG-11, JN-3, LIM-5: outcomes per supplier; a supplier without invoices counts one row."""
    per = (invoices.groupBy("supplier_id")
           .agg(F.count("*").alias("n"), F.count_if(_status("ok")).alias("ok"),
                F.count_if(_status("requires_review")).alias("review"),
                F.count_if(_status("failed")).alias("fail")))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    total, zero = F.sum(F.coalesce("n", F.lit(1))), F.lit(0)
    review, fail = F.coalesce(F.sum("review"), zero), F.coalesce(F.sum("fail"), zero)
    return (suppliers.join(c, "category_id", "left").join(per, F.col("id") == F.col("supplier_id"), "left")
            .groupBy(F.col("nif").alias("supplier_nif"), display_name().alias("supplier_name"),
                     "commercial_name", "legal_name", "category")
            .agg(total.alias("total_invoices"), F.coalesce(F.sum("ok"), zero).alias("ok_count"),
                 review.alias("review_count"), fail.alias("fail_count"),
                 share_pct(review + fail, total, 2).alias("error_rate_pct"))
            .drop("commercial_name", "legal_name").orderBy(F.desc_nulls_last("error_rate_pct")))


def missing_fields(invoices: DataFrame) -> DataFrame:
    """AG-12, SET-1, JN-20: null counts of the ten header fields from one scan."""
    one = invoices.agg(F.count("*").alias("total"),
                       *[F.count_if(F.col(f).isNull()).alias(f) for f in HEADER_FIELDS])
    return (one.unpivot(["total"], HEADER_FIELDS, "field_name", "null_count")
            .withColumn("missing_pct", share_pct(F.col("null_count"), F.col("total"), 2))
            .orderBy(F.desc("missing_pct")))


def ai_quality(invoices: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-17: confidence, auto-approvable, review and correction rates of the window."""
    decided = F.count_if(F.col("approval_status").isin("approved", "edited", "rejected"))
    n = F.count("*")
    return recent(invoices, "created_at", days, as_of).agg(
        mean(F.sum("llm_confidence"), F.count("llm_confidence"), 4).alias("avg_confidence"),
        share_pct(F.count_if(F.col("llm_confidence") >= F.lit(0.90).cast("decimal(5,2)")), n, 2)
        .alias("auto_approvable_pct"),
        share_pct(F.count_if("review_required"), n, 2).alias("requires_review_pct"),
        share_pct(F.count_if(F.col("approval_status") == "edited"), decided, 2).alias("correction_rate_pct"),
        n.alias("total_invoices"))


def confidence_trend(invoices: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-18: mean confidence per day, oldest first."""
    return (recent(invoices, "created_at", days, as_of).where(F.col("llm_confidence").isNotNull())
            .groupBy(F.to_date("created_at").alias("day"))
            .agg(mean(F.sum("llm_confidence"), F.count("*"), 4).alias("avg_confidence"),
                 F.count("*").alias("invoice_count"))
            .orderBy("day"))


def confidence_entries(invoices: DataFrame, *keep: str) -> DataFrame:
    """JSON-2: one row per key of the per-field confidence map."""
    return invoices.select(*keep, F.explode("field_confidence").alias("field_name", "confidence")).withColumn(
        "confidence", F.col("confidence").cast(EXACT))


def field_confidence_by_client(invoices: DataFrame, clients: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-19, JN-7: mean confidence per client name and field; summed per client before the join."""
    per = (confidence_entries(recent(invoices, "created_at", days, as_of), "client_id")
           .groupBy("client_id", "field_name")
           .agg(F.sum("confidence").alias("s"), F.count("confidence").alias("n")))
    names = clients.select(F.col("id").alias("client_id"), F.col("legal_name").alias("client_name"))
    return (per.join(names, "client_id").groupBy("client_name", "field_name")
            .agg(mean(F.sum("s"), F.sum("n"), 4, EXACT_SUM).alias("avg_confidence"))
            .orderBy("client_name", "field_name"))


def latency_percentiles(invoices: DataFrame) -> DataFrame:
    """AG-25: p50..p99, extremes and mean of processing time per client."""
    timed = invoices.where(F.col("processing_time_ms").isNotNull())
    ranks = {"p50_ms": .5, "p75_ms": .75, "p90_ms": .9, "p95_ms": .95, "p99_ms": .99}
    points = exact_percentiles(timed, ["client_id"], "processing_time_ms", list(ranks.values()), list(ranks))
    ms = F.col("processing_time_ms")
    base = timed.groupBy("client_id").agg(
        F.count("*").alias("total_invoices"), F.max(ms).alias("max_ms"), F.min(ms).alias("min_ms"),
        (F.sum(ms) / F.count("*")).alias("avg_ms"))
    p = points.withColumnRenamed("client_id", "_c")
    return (base.join(p, base.client_id.eqNullSafe(p._c))
            .select("client_id", "total_invoices", *ranks, "max_ms", "min_ms", "avg_ms"))


def approximate_latency_percentiles(invoices: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """AG-25 by sketch, for when a bounded rank error is enough."""
    ranks = [.5, .75, .9, .95, .99]
    p = F.percentile_approx("processing_time_ms", F.array(*map(F.lit, ranks)), F.lit(accuracy))
    names = ["p50_ms", "p75_ms", "p90_ms", "p95_ms", "p99_ms"]
    return (invoices.where(F.col("processing_time_ms").isNotNull()).groupBy("client_id")
            .agg(F.count("*").alias("total_invoices"), p.alias("_p"))
            .select("client_id", "total_invoices", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]))


# --- 30-day rollups ---------------------------------------------------------

def extraction_rollup(invoices: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """AG-26: per client and day; counts the status ``error``, not ``failed``."""
    n = F.count("*")
    return (recent(invoices, "created_at", days, as_of)
            .groupBy("client_id", F.date_trunc("day", "created_at").alias("day"))
            .agg(n.alias("total"), F.count_if(_status("ok")).alias("ok_count"),
                 F.count_if(_status("requires_review")).alias("review_count"),
                 F.count_if(_status("error")).alias("error_count"),
                 share_pct(F.count_if(_status("ok")), n, 2).alias("ok_rate_pct")))


def supplier_rollup(invoices: DataFrame, suppliers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """AG-27: per client and supplier, with mean processing time in whole ms."""
    per = (recent(invoices, "created_at", days, as_of).where(F.col("supplier_id").isNotNull())
           .groupBy("client_id", "supplier_id")
           .agg(F.count("*").alias("total"), F.count_if(_status("ok")).alias("ok_count"),
                mean(F.sum("processing_time_ms"), F.count("processing_time_ms"), 0).alias("avg_processing_ms")))
    s = suppliers.select(F.col("id").alias("supplier_id"), display_name().alias("supplier_name"))
    return per.join(s, "supplier_id", "left").select(
        "client_id", "supplier_id", "supplier_name", "total", "ok_count", "avg_processing_ms")


def confidence_rollup(invoices: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """AG-28: sample size, mean and median confidence per client and field."""
    entries = confidence_entries(recent(invoices, "created_at", days, as_of), "client_id")
    keys = ["client_id", "field_name"]
    base = entries.groupBy(*keys).agg(F.count("confidence").alias("sample_size"),
                                      mean(F.sum("confidence"), F.count("confidence"), 4, EXACT_SUM).alias("avg_confidence"))
    med = (exact_percentiles(entries, keys, "confidence", [.5], ["_m"], scale=10 ** 15)
           .select(F.col("client_id").alias("_c"), F.col("field_name").alias("_f"),
                   F.round(F.col("_m").cast(EXACT), 4).alias("median_confidence")))
    return (base.join(med, base.client_id.eqNullSafe(med._c) & (base.field_name == med._f))
            .select("client_id", F.col("field_name").alias("field_key"), "sample_size",
                    "avg_confidence", "median_confidence"))
