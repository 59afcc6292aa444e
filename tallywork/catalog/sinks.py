import uuid

from pyspark.sql import functions as F

from ..bindings import as_of
from ..operators.tax import tax_rows
from ..plans import invoices as I, quality as Q
from ..session import shared_dir
from ..sinks import invoices as S, tables as W
from .base import num, query, stamp
from .text import UNIT_VALUES, norm


def scratch(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# Suppliers seen again (every third, new name) and suppliers that are new.
UPDATES = "(SELECT nif, name || ' SA' AS name FROM suppliers WHERE id % 3 = 0 UNION ALL SELECT 'NEW' || nif, name FROM suppliers WHERE id % 10 = 1)"


@query("snk_1_upserted_suppliers", f"""
SELECT coalesce(s.nif, u.nif) AS nif, coalesce(u.name, s.name) AS name, s.category_id,
  coalesce({norm('u.name')}, s.normalized_name) AS normalized_name
FROM suppliers s FULL JOIN {UPDATES} u ON u.nif = s.nif""", "suppliers")
def _(t):
    from ..functions.names import match_name
    s = t.suppliers
    new = (s.where("id % 3 = 0").select("nif", F.concat("name", F.lit(" SA")).alias("name"))
           .unionByName(s.where("id % 10 = 1").select(F.concat(F.lit("NEW"), "nif").alias("nif"), "name"))
           .withColumn("normalized_name", match_name(F.col("name"))))
    return W.merge_latest(s.select("nif", "name", "category_id", "normalized_name"), new, ["nif"], ["name", "normalized_name"])


@query("snk_1_upserted_aliases", """
SELECT supplier_id, alias_text, alias_type, max(confidence)::DOUBLE AS confidence FROM (
  SELECT supplier_id, alias_text || CASE WHEN supplier_id % 2 = 0 THEN '' ELSE ' (old)' END AS alias_text, alias_type, 0 AS confidence FROM aliases
  UNION ALL SELECT supplier_id, alias_text, alias_type, 1 FROM aliases) GROUP BY 1, 2, 3""", "aliases")
def _(t):
    # Every alias is in the old table; half of them under another text, so that there they are added and not updated.
    a = t.aliases
    text = F.when(F.col("supplier_id") % 2 == 0, F.col("alias_text")).otherwise(F.concat("alias_text", F.lit(" (old)")))
    old = a.withColumns({"alias_text": text, "confidence": F.lit(0).cast("decimal(5,4)")})
    return W.merge_latest(old, a, ["supplier_id", "alias_text", "alias_type"], ["confidence"])


@query("snk_2_replaced_taxes", """
SELECT invoice_id, rate::DOUBLE AS rate, CASE WHEN invoice_id % 2 = 0 THEN 1.0::DOUBLE ELSE tax_c / 100.0::DOUBLE END AS tax_amount FROM bands""", "bands")
def _(t):
    rows = tax_rows(t.invoices).select("invoice_id", "rate", "tax_amount")
    fresh = rows.where("invoice_id % 2 = 0").withColumn("tax_amount", F.lit(1).cast("decimal(14,2)"))
    return W.replace_by_key(rows, fresh, "invoice_id")


@query("snk_3_appended_log", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    path, o = scratch(t, "log"), t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    W.append(o, path)
    W.append(o.where("status = 'F'"), path)
    return t.spark.read.parquet(path)


@query("snk_4_item_rows", f"""
SELECT i.id AS invoice_id, i.supplier_id, n AS line_number, 'work' AS description, u.unit, {num('i.total_with_vat')} AS gross_amount
FROM (SELECT *, unnest([1, 2]) AS n FROM invoices) i LEFT JOIN (VALUES {UNIT_VALUES}) u(spelling, unit)
  ON u.spelling = CASE WHEN n = 1 THEN 'kgs' WHEN id % 2 = 0 THEN 'cx' ELSE 'furlong' END""", "invoices")
def _(t):
    item = lambda n, unit: F.struct(F.lit(n).alias("line_number"), F.lit("work").alias("description"), unit.alias("unit"),
                                    F.col("total_with_vat").alias("gross_amount"))
    x = t.invoices.select(F.col("id").alias("invoice_id"), "supplier_id", F.array(
        item(1, F.lit(" KGS ")), item(2, F.when(F.col("id") % 2 == 0, "CX").otherwise("furlong"))).alias("items"))
    return S.item_rows(x)


@query("snk_5_invoice_rows", f"""
SELECT document_hash, processing_status, invoice_number, issuer_nif, {num('total_with_vat')} AS total_with_vat, currency, NULL::VARCHAR AS origin_country, review_reason FROM invoices""", "invoices")
def _(t):
    fields = ["invoice_number", "issuer_nif", "receiver_nif", "issuer_name", "issue_date", "total_with_vat", "total_without_vat",
              "vat_total", "llm_confidence", "currency"]
    x = t.invoices.select("source_type", "source_ref", "file_name", "document_hash", F.struct(*fields).alias("fields"),
                          F.col("processing_status").alias("status"), F.lit(None).cast("long").alias("duplicate_of"), F.col("review_reason").alias("reason"))
    return S.invoice_rows(x).select("document_hash", "processing_status", "invoice_number", "issuer_nif", "total_with_vat", "currency",
                                    F.col("origin_country").cast("string").alias("origin_country"), "review_reason")


@query("snk_6_ocr_texts", "SELECT id AS invoice_id, raw_ocr_text FROM invoices WHERE raw_ocr_text <> ''", "invoices")
def _(t):
    return S.ocr_texts(t.invoices)


W30 = "created_at >= (SELECT max(created_at) FROM invoices) - INTERVAL 30 DAY"


@query("snk_7_refreshed_rollups", f"""
SELECT 'extraction_quality' AS "view", true AS refreshed, count(*) AS entries FROM (SELECT DISTINCT client_id, date_trunc('day', created_at) FROM invoices WHERE {W30})
UNION ALL SELECT 'supplier_quality', true, count(*) FROM (SELECT DISTINCT client_id, supplier_id FROM invoices WHERE {W30} AND supplier_id IS NOT NULL)
UNION ALL SELECT 'field_confidence', true, count(*) FROM (SELECT DISTINCT client_id, field_key FROM invoices JOIN confidences ON id = invoice_id WHERE {W30})""",
       "invoices confidences")
def _(t):
    i, base = t.invoices_by_month("client_id", "supplier_id", "processing_status", "processing_time_ms", "field_confidence"), scratch(t, "rollups")
    now = as_of(i)
    status = W.refresh_rollups(t.spark, {
        "extraction_quality": lambda: Q.extraction_rollup(i, now),
        "supplier_quality": lambda: Q.supplier_rollup(i, t.suppliers, now),
        "field_confidence": lambda: Q.confidence_rollup(i, now),
    }, base)
    counts = [t.spark.read.parquet(f"{base}/{v}").agg(F.lit(v).alias("view"), F.count("*").alias("entries"))
              for v in ("extraction_quality", "supplier_quality", "field_confidence")]
    return status.drop("error").join(counts[0].unionByName(counts[1]).unionByName(counts[2]), "view")


@query("snk_7_rollup_contents", f"""
SELECT 'extraction_quality' AS "view", client_id, {stamp("date_trunc('day', created_at)::TIMESTAMP")} AS entry, count(*) AS total, count(*) FILTER (processing_status = 'ok') AS ok_count FROM invoices WHERE {W30} GROUP BY 2, date_trunc('day', created_at)
UNION ALL SELECT 'supplier_quality', client_id, supplier_id::VARCHAR, count(*), count(*) FILTER (processing_status = 'ok') FROM invoices WHERE {W30} AND supplier_id IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'field_confidence', client_id, field_key, count(*), NULL FROM invoices JOIN confidences ON id = invoice_id WHERE {W30} GROUP BY 2, 3""", "invoices confidences")
def _(t):
    i, base = t.invoices_by_month("client_id", "supplier_id", "processing_status", "processing_time_ms", "field_confidence"), scratch(t, "rollups")
    now = as_of(i)
    W.refresh_rollups(t.spark, {
        "extraction_quality": lambda: Q.extraction_rollup(i, now),
        "supplier_quality": lambda: Q.supplier_rollup(i, t.suppliers, now),
        "field_confidence": lambda: Q.confidence_rollup(i, now),
    }, base)
    read = lambda v, entry, total, ok: t.spark.read.parquet(f"{base}/{v}").select(F.lit(v).alias("view"), "client_id", entry.alias("entry"), F.col(total).alias("total"), ok.alias("ok_count"))
    return (read("extraction_quality", F.date_format("day", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "total", F.col("ok_count"))
            .unionByName(read("supplier_quality", F.col("supplier_id").cast("string"), "total", F.col("ok_count")))
            .unionByName(read("field_confidence", F.col("field_key"), "sample_size", F.lit(None).cast("long"))))


@query("snk_1_documents_by_hash", """
SELECT document_hash, CASE WHEN bool_or(id % 3 = 0) THEN 'again' ELSE 'first' END AS state, count(*) FILTER (id % 3 <> 0) > 0 AS known FROM invoices GROUP BY 1""", "invoices")
def _(t):
    rows = t.invoices.select("id", "document_hash")
    old = rows.where("id % 3 <> 0").select("document_hash").distinct().select("document_hash", F.lit("first").alias("state"), F.lit(True).alias("known"))
    new = rows.where("id % 3 = 0").select("document_hash", F.lit("again").alias("state"), F.lit(False).alias("known"))
    return W.merge_latest(old, new, ["document_hash"], ["state"])


@query("snk_1_status_by_id", """
SELECT id, CASE WHEN id % 4 = 0 THEN 'archived' ELSE processing_status END AS processing_status FROM invoices""", "invoices")
def _(t):
    from ..sinks.buckets import read_buckets, upsert_buckets
    base, rows = scratch(t, "by_id"), t.invoices.select("id", "processing_status")
    upsert_buckets(rows, base, 0, ["id"])
    upsert_buckets(rows.where("id % 4 = 0").withColumn("processing_status", F.lit("archived")), base, 1, ["id"])
    return read_buckets(t.spark, base)


NOW = "DATE '2009-01-01'"
GONE = f"issue_date + INTERVAL 10 YEAR < {NOW}"


def retained(t):
    return I.with_retention(t.invoices)


@query("snk_8_purge_dry_run", f"SELECT true AS dry_run, count(*) FILTER ({GONE}) AS found, 0 AS deleted FROM invoices", "invoices")
def _(t):
    return S.purge(retained(t), F.expr("TIMESTAMP '2009-01-01 00:00:00'"))["summary"]


@query("snk_8_purge_summary", f"SELECT false AS dry_run, count(*) FILTER ({GONE}) AS found, count(*) FILTER ({GONE}) AS deleted FROM invoices", "invoices")
def _(t):
    return S.purge(retained(t), F.expr("TIMESTAMP '2009-01-01 00:00:00'"), dry_run=False)["summary"]


@query("snk_8_kept_and_audited", f"SELECT id, coalesce({GONE}, false) AS purged FROM invoices", "invoices")
def _(t):
    p = S.purge(retained(t), F.expr("TIMESTAMP '2009-01-01 00:00:00'"), dry_run=False)
    return (p["kept"].select("id", F.lit(False).alias("purged"))
            .unionByName(p["audit"].select(F.col("row_id").alias("id"), F.lit(True).alias("purged"))))


@query("snk_9_change_images", """
SELECT id AS row_id, CASE WHEN id % 10 = 1 THEN 'INSERT' WHEN id % 10 = 2 THEN 'DELETE' ELSE 'UPDATE' END AS operation,
  CASE WHEN id % 10 <> 1 THEN processing_status END AS old_status,
  CASE WHEN id % 10 = 1 THEN processing_status WHEN id % 10 = 3 THEN 'archived' END AS new_status
FROM invoices WHERE id % 10 IN (1, 2, 3)""", "invoices")
def _(t):
    rows = t.invoices.select("id", "processing_status", "total_with_vat")
    new = rows.where("id % 10 <> 2").withColumn("processing_status", F.when(F.col("id") % 10 == 3, "archived").otherwise(F.col("processing_status")))
    x = S.change_images(rows.where("id % 10 <> 1"), new, "id", "invoices", "tester")
    return x.select("row_id", "operation", F.get_json_object("old_data", "$.processing_status").alias("old_status"),
                    F.get_json_object("new_data", "$.processing_status").alias("new_status"))


@query("snk_10_payment_state", f"""
SELECT id, {num('paid')} AS amount_paid, {num('total_with_vat - paid')} AS amount_due,
  CASE WHEN paid = 0 THEN 'unpaid' WHEN total_with_vat > paid THEN 'partial' ELSE 'paid' END AS payment_status
FROM (SELECT i.id, i.total_with_vat, coalesce(p.paid, 0) AS paid FROM invoices i
  LEFT JOIN (SELECT invoice_id, sum(amount_paid) AS paid FROM payments GROUP BY 1) p ON p.invoice_id = i.id)""", "invoices payments")
def _(t):
    return S.payment_state(t.invoices, t.payments)
