"""The review queue: reading it, grouping it and applying decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: status after a decision.
STATUS_AFTER = {"approved": "ok", "rejected": "failed", "edited": "ok"}


def status_after(decision):
    """PRJ-14: invoice status a decision leads to; unknown decisions count as accepted."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_AFTER.items() for x in pair])
    return F.coalesce(F.try_element_at(table, decision), F.lit("ok"))


def pending_queue(queue: DataFrame, invoices: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-5, LIM-4: pending items with their invoice and document, by priority, then newest."""
    fields = ["file_name", "issuer_name", "invoice_number", "issue_date", "total_with_vat", "llm_confidence",
              "processing_status", "issuer_nif", "total_without_vat", "vat_total", "review_reason"]
    pending = queue.where("status = 'pending'")
    inv = invoices.select(F.col("id").alias("_i"), "document_hash", *fields)
    inv = inv.join(pending.select(F.col("invoice_id").alias("_i")), "_i", "left_semi")   # before documents are looked up
    doc = documents.select("document_hash", "mime_type")
    whole = inv.join(doc, "document_hash", "left").select(
        "_i", F.struct(*fields, F.struct("mime_type").alias("document")).alias("invoice"))
    return (pending.join(whole, F.col("invoice_id") == F.col("_i"), "left")
            .select("id", "invoice_id", "reason_code", "priority", "status", "created_at", "invoice")
            .orderBy("priority", F.desc("created_at")))


def queue_stats(queue: DataFrame) -> DataFrame:
    """AG-6: pending and resolved totals, and pending per reason (bounded by the reason vocabulary)."""
    per = (queue.groupBy(F.coalesce("reason_code", F.lit("unknown")).alias("reason"))
           .agg(F.count_if(F.col("status") == "pending").alias("pending"),
                F.count_if(F.col("status") == "resolved").alias("resolved")))
    entries = F.collect_list(F.when(F.col("pending") > 0, F.struct("reason", "pending")))
    return per.agg(F.sum("pending").alias("total_pending"), F.sum("resolved").alias("total_resolved"),
                   F.map_from_entries(entries).alias("by_reason"))


def queue_by_invoice(queue: DataFrame, invoices: DataFrame) -> DataFrame:
    """AG-7: per invoice its queue ids and reasons in queue order, the first item's priority and the invoice itself.

    An invoice has an item per reason at most, so its lists are short.
    """
    item = F.struct(F.coalesce("priority", F.lit(2)).alias("priority"), (-F.unix_micros("created_at")).alias("age"), "id",
                    F.coalesce("reason_code", F.lit("")).alias("reason_code"))
    items = queue.groupBy("invoice_id").agg(F.array_sort(F.collect_list(item)).alias("_q"))
    whole = invoices.select(F.col("id").alias("_i"), F.struct(*invoices.columns).alias("invoice"))
    return items.join(whole, F.col("invoice_id") == F.col("_i"), "left").select(
        "invoice_id", "invoice", F.transform("_q", lambda x: x["id"]).alias("queue_ids"),
        F.transform("_q", lambda x: x["reason_code"]).alias("reason_codes"), F.col("_q")[0]["priority"].alias("priority"))


def apply_decisions(decisions: DataFrame, queue: DataFrame, invoices: DataFrame) -> dict[str, DataFrame]:
    """PRJ-14: decisions (invoice_id, decision, reason, reviewed_by, reviewed_at) as three new tables.

    ``reviews`` are rows to append; ``queue`` and ``invoices`` are the updated
    tables.  The latest decision of an invoice counts.
    """
    reviews = decisions.select("invoice_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"),
                               "reviewed_by", "reviewed_at")
    last = (reviews.groupBy(F.col("invoice_id").alias("_i"))
            .agg(F.max_by(F.struct("decision", "reason", "reviewed_by", "reviewed_at"), "reviewed_at").alias("_d")))
    hit = F.col("_d").isNotNull() & (F.col("status") == "pending")
    new_queue = (queue.join(last, F.col("invoice_id") == F.col("_i"), "left")
                 .withColumns({"resolved_at": F.when(hit, F.col("_d.reviewed_at")),
                               "resolution_notes": F.when(hit, F.col("_d.reason")),
                               "assigned_to": F.when(hit, F.col("_d.reviewed_by")),
                               "status": F.when(hit, F.lit("resolved")).otherwise(F.col("status"))})
                 .drop("_i", "_d"))
    new_invoices = (invoices.join(last, F.col("id") == F.col("_i"), "left")
                    .withColumn("processing_status", F.when(F.col("_d").isNotNull(), status_after(F.col("_d.decision")))
                                .otherwise(F.col("processing_status"))).drop("_i", "_d"))
    return {"reviews": reviews, "queue": new_queue, "invoices": new_invoices}
