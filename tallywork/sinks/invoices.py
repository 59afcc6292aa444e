"""Rows written for extracted invoices, payments, retention and the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.units import normalize_unit

# Fixed value: extracted header fields.
HEADER = ["invoice_number", "issuer_nif", "receiver_nif", "issuer_name", "issue_date", "total_with_vat",
          "total_without_vat", "vat_total", "llm_confidence", "receiver_name", "due_date", "currency",
          "document_type", "origin_country", "atcud"]


def invoice_rows(extractions: DataFrame) -> DataFrame:
    """SNK-5: flat rows from (source columns, ``fields`` struct, ``status``, ``duplicate_of``, ``reason``)."""
    have = extractions.schema["fields"].dataType.fieldNames()
    field = lambda c: F.col(f"fields.{c}") if c in have else F.lit(None)
    return extractions.select(
        "source_type", "source_ref", "file_name", "document_hash", F.col("status").alias("processing_status"),
        *[field(c).alias(c) for c in HEADER], "duplicate_of", F.col("reason").alias("review_reason"),
        F.to_json("fields").alias("raw_extraction"))


def item_rows(extractions: DataFrame) -> DataFrame:
    """SNK-4: one row per line item, unit in the common vocabulary."""
    flat = extractions.select("invoice_id", "supplier_id", F.inline("items"))
    return flat.withColumn("unit", normalize_unit(F.col("unit")))


def ocr_texts(invoices: DataFrame) -> DataFrame:
    """SNK-6: recognised text of invoices that have any."""
    return invoices.where(F.col("raw_ocr_text") != "").select(F.col("id").alias("invoice_id"), "raw_ocr_text")


def payment_state(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """SNK-10: amount paid, amount due and state per invoice; payments are summed before the join."""
    paid = payments.groupBy(F.col("invoice_id").alias("id")).agg(F.sum("amount_paid").alias("_paid"))
    zero = F.lit(0).cast("decimal(24,2)")
    out = invoices.select("id", "total_with_vat").join(paid, "id", "left").withColumn("amount_paid", F.coalesce("_paid", zero))
    due = F.col("total_with_vat") - F.col("amount_paid")
    state = F.when(F.col("amount_paid") == 0, "unpaid").when(due > 0, "partial").otherwise("paid")
    return out.select("id", "amount_paid", due.alias("amount_due"), state.alias("payment_status"))


def purge(invoices: DataFrame, now: Column, client_id=None, dry_run: bool = True) -> dict[str, DataFrame]:
    """SNK-8: invoices past their retention date; a dry run only counts.

    Gives the ``summary`` row and, unless dry, the ``audit`` rows to append and
    the ``kept`` table.
    """
    gone = F.coalesce(F.col("retention_until") < now.cast("date"), F.lit(False))
    if client_id is not None:
        gone = gone & (F.col("client_id") == client_id)
    found = F.count_if(gone)
    summary = invoices.agg(F.lit(dry_run).alias("dry_run"), found.alias("found"),
                           (F.lit(0) if dry_run else found).cast("long").alias("deleted"))
    if dry_run:
        return {"summary": summary}
    image = F.struct(F.col("id").alias("invoice_id"), "client_id", "retention_until", now.alias("purged_at"))
    audit = invoices.where(gone).select(
        F.lit("invoices").alias("table_name"), F.lit("GDPR_PURGE").alias("operation"), F.col("id").alias("row_id"),
        F.lit(None).cast("string").alias("staff_user_id"), F.to_json(image).alias("new_data"))
    return {"summary": summary, "audit": audit, "kept": invoices.where(~gone)}


def change_images(old: DataFrame, new: DataFrame, key: str, table: str, actor: str | None = None) -> DataFrame:
    """SNK-9: INSERT, UPDATE and DELETE rows between two snapshots; unchanged rows give none."""
    o = old.select(F.col(key).alias("_ok"), F.to_json(F.struct("*")).alias("old_data"))
    n = new.select(F.col(key).alias("_nk"), F.to_json(F.struct("*")).alias("new_data"))
    op = (F.when(F.col("old_data").isNull(), "INSERT").when(F.col("new_data").isNull(), "DELETE").otherwise("UPDATE"))
    return (o.join(n, F.col("_ok") == F.col("_nk"), "full")
            .where(~F.col("old_data").eqNullSafe(F.col("new_data")))
            .select(F.lit(table).alias("table_name"), op.alias("operation"), F.coalesce("_nk", "_ok").alias("row_id"),
                    "old_data", "new_data", F.lit(actor).cast("string").alias("changed_by")))
