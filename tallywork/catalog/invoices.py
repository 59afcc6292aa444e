from pyspark.sql import functions as F

from ..operators import duplicates as D, review as V, rules as K, tax as X
from ..operators.skew import position
from ..plans import invoices as I
from ..plans.accounting import display_name
from .base import day, num, query, stamp

MONEY = ("total_with_vat", "llm_confidence")


def summary(where=""):
    cols = ", ".join(day(c) + " AS " + c if c == "issue_date" else stamp("created_at") + " AS created_at" if c == "created_at"
                     else num(c) + " AS " + c if c in MONEY else c for c in I.SUMMARY)
    return f"SELECT {cols} FROM invoices {where}"


@query("prj_3_invoice_list", summary(), "invoices")
def _(t):
    return I.invoice_summaries(t.invoices)


@query("prj_3_invoices_by_status", summary("WHERE processing_status = 'requires_review'"), "invoices")
def _(t):
    return I.invoice_summaries(t.invoices, "requires_review")


@query("prj_4_point_lookup", "SELECT id, document_hash, storage_path FROM invoices WHERE id = 77", "invoices")
def _(t):
    return I.lookup(t.invoices, "id", 77).select("id", "document_hash", "storage_path")


@query("prj_4_batch_lookup", "SELECT id, storage_path FROM invoices WHERE id IN (SELECT invoice_id FROM queue WHERE priority = 1)",
       "invoices queue")
def _(t):
    ids = t.queue.where("priority = 1").select(F.col("invoice_id").alias("id")).distinct()
    return I.lookup_many(t.invoices, ids).select("id", "storage_path")


LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.STATUS_LABELS.items())


@query("prj_5_status_labels", f"SELECT CASE processing_status {LABELS} ELSE processing_status END AS label, count(*) AS n FROM invoices GROUP BY 1", "invoices")
def _(t):
    return t.invoices.groupBy(I.status_label(F.col("processing_status")).alias("label")).agg(F.count("*").alias("n"))


@query("prj_9_retention", f"SELECT id, {day('issue_date + INTERVAL 10 YEAR')} AS retention_until FROM invoices", "invoices")
def _(t):
    return I.with_retention(t.invoices).select("id", "retention_until")


@query("prj_10_public_id", """
SELECT id, 'INV-' || year(created_at) || '-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS public_invoice_id
FROM (SELECT id, created_at, row_number() OVER (ORDER BY id) AS n FROM invoices)""", "invoices")
def _(t):
    return I.with_public_id(t.invoices).select("id", "public_invoice_id")


@query("prj_11_display_name", "SELECT id, coalesce(commercial_name, legal_name, nif) AS display_name FROM suppliers", "suppliers")
def _(t):
    return t.suppliers.select("id", display_name().alias("display_name"))


@query("prj_12_totals_agree", """
SELECT id, coalesce(abs(total_with_vat - total_without_vat - vat_total) <= 0.02, true) AS agrees,
  coalesce(abs(total_with_vat - total_without_vat - vat_total) <= 0.02, false) AS proven FROM invoices""", "invoices")
def _(t):
    return t.invoices.select("id", K.totals_agree().alias("agrees"), K.totals_agree(missing=False).alias("proven"))


@query("prj_13_legal_form", """
SELECT id, CASE WHEN legal_form IS NOT NULL THEN legal_form WHEN legal_name ILIKE '%unipessoal%' THEN 'UNIPESSOAL' ELSE 'OUTRO' END AS legal_form
FROM clients""", "clients")
def _(t):
    return I.with_legal_form(t.clients).select("id", "legal_form")


def decisions(t):
    return t.approvals.select("invoice_id", "decision", F.lit("seen").alias("reason"),
                              F.concat(F.lit("user-"), F.col("decided_by").cast("string")).alias("reviewed_by"),
                              F.col("decided_at").alias("reviewed_at"))


LAST = "(SELECT invoice_id, arg_max(decision, decided_at) AS decision, arg_max(decided_by, decided_at) AS who, max(decided_at) AS decided_at FROM approvals GROUP BY 1)"


@query("prj_14_decided_invoices", f"""
SELECT i.id, CASE WHEN l.decision IS NULL THEN i.processing_status WHEN l.decision = 'rejected' THEN 'failed' ELSE 'ok' END AS processing_status
FROM invoices i LEFT JOIN {LAST} l ON l.invoice_id = i.id""", "invoices approvals")
def _(t):
    return V.apply_decisions(decisions(t), t.queue, t.invoices)["invoices"].select("id", "processing_status")


@query("prj_14_decided_queue", f"""
SELECT q.id, CASE WHEN hit THEN 'resolved' ELSE q.status END AS status, CASE WHEN hit THEN {stamp('decided_at')} END AS resolved_at
FROM (SELECT q.*, l.decided_at, l.invoice_id IS NOT NULL AND q.status = 'pending' AS hit FROM queue q LEFT JOIN {LAST} l ON l.invoice_id = q.invoice_id) q""",
       "queue approvals")
def _(t):
    return V.apply_decisions(decisions(t), t.queue, t.invoices)["queue"].select("id", "status", "resolved_at")


@query("prj_14_review_rows", f"""
SELECT invoice_id, decision, 'seen' AS reason, 'user-' || decided_by AS reviewed_by, {stamp('decided_at')} AS reviewed_at FROM approvals""", "approvals")
def _(t):
    return V.apply_decisions(decisions(t), t.queue, t.invoices)["reviews"]


@query("prj_15_terminal_status", """
SELECT id, CASE WHEN bad THEN 'failed' ELSE 'validated' END AS final_status, CASE WHEN bad THEN array_to_string(errors, '; ') END AS review_reason,
  CASE WHEN bad THEN 'error' ELSE 'ok' END AS caller_status
FROM (SELECT id, errors, len(errors) > 0 OR coalesce(math_validation_result LIKE '%"valid": false%', false) AS bad FROM (
  SELECT id, math_validation_result, coalesce(from_json(math_validation_result::JSON -> 'errors', '["VARCHAR"]'), []) AS errors FROM invoices))""", "invoices")
def _(t):
    from ..plans.quality import CHECK_RESULT
    r = F.from_json("math_validation_result", CHECK_RESULT)
    runs = t.invoices.select("id", r["errors"].alias("errors"), r["valid"].alias("math_valid"))
    return K.terminal_status(runs).select("id", "final_status", "review_reason", "caller_status")


# --- rules --------------------------------------------------------------------

@query("tax_1_bands", """
SELECT invoice_id, CASE invoice_id % 5 WHEN 1 THEN 'MwSt' WHEN 2 THEN 'VAT' ELSE 'IVA' END AS tax_code, rate::DOUBLE AS rate,
  base_c / 100.0::DOUBLE AS taxable_base, tax_c / 100.0::DOUBLE AS tax_amount, rate IN (0, 6, 13, 23) AS is_valid FROM bands""", "bands")
def _(t):
    return X.tax_rows(t.invoices)


def resolutions(t):
    return t.invoices.select(F.col("id").alias("invoice_id"),
                             (F.col("supplier_id").isNull() | (F.col("id") % 10 == 0)).alias("needs_review"),
                             F.expr("CASE WHEN id % 4 = 0 THEN 'alias' ELSE 'nif_exact' END").alias("method"))


CHECKS = """
checked AS (SELECT i.id AS invoice_id, i.supplier_id, i.total_with_vat,
  i.supplier_id IS NULL OR i.id % 10 = 0 AS unresolved,
  coalesce(abs(i.total_without_vat + i.vat_total - i.total_with_vat) <= 0.02, true) AS r1,
  coalesce(abs(s.gross - i.total_with_vat) <= 0.02, true) AS r2,
  coalesce(abs(b.tax_c / 100.0 - i.vat_total) <= 0.02, true) AS r5, coalesce(b.fine, true) AS r6, coalesce(c.low >= 70, true) AS r7,
  i.total_without_vat AS net, i.vat_total AS vat, s.gross AS lines, CAST(b.tax_c / 100.0 AS DECIMAL(18,2)) AS tax, b.wrong
FROM invoices i LEFT JOIN (SELECT invoice_id, sum(gross_amount) AS gross FROM items GROUP BY 1) s ON s.invoice_id = i.id
LEFT JOIN (SELECT invoice_id, sum(tax_c)::BIGINT AS tax_c, bool_and(rate <> 19) AS fine,
    string_agg(rate || '%', ', ') FILTER (rate = 19) AS wrong FROM bands GROUP BY 1) b ON b.invoice_id = i.id
LEFT JOIN (SELECT invoice_id, min(conf_c) AS low FROM confidences GROUP BY 1) c ON c.invoice_id = i.id)"""
CHECK_TABLES = "invoices items bands confidences"


def _sum_detail(parts, total, want, passed, missing):
    return (f"CASE WHEN {total} IS NULL OR {want} IS NULL THEN 'Skipped: {missing}' WHEN {passed} THEN {parts} || ' = ' || {total} || ' agrees with ' || {want} "
            f"ELSE {parts} || ' = ' || {total} || ', expected ' || {want} || ' (off by ' || abs({total} - {want}) || ')' END")


DETAILS = {
    "r1": _sum_detail("net || ' + ' || vat", "(net + vat)", "total_with_vat", "r1", "a total is missing"),
    "r2": _sum_detail("'sum of lines'", "lines", "total_with_vat", "r2", "no lines or no total"),
    "r5": _sum_detail("'sum of bands'", "tax", "vat", "r5", "no bands or no tax total"),
    "r6": "CASE WHEN r6 THEN 'all rates are accepted ones' ELSE 'Rates not accepted: ' || wrong END",
    "r7": "CASE WHEN r7 THEN 'every confidence is at least 0.7' ELSE 'a confidence is below 0.7' END",
    "r8": "CASE WHEN unresolved THEN 'needs review, method ' ELSE 'resolved by ' END || CASE WHEN invoice_id % 4 = 0 THEN 'alias' ELSE 'nif_exact' END",
}


@query("val_1_rule_rows", f"WITH {CHECKS} " + " UNION ALL ".join(
    f"SELECT invoice_id, '{code}' AS rule_code, {'NOT unresolved' if c == 'r8' else c} AS passed, {DETAILS[c]} AS detail FROM checked"
    for c, (code, _) in K.RULES.items()), CHECK_TABLES)
def _(t):
    return K.rule_rows(K.checks(t.invoices, t.items, resolutions(t))).drop("rule_description")


def log(t):
    """Resolution log: supplier ids are drawn from the customer keys, so many occur once."""
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resolved_supplier_id"),
        F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 'auto' ELSE 'human' END").alias("created_by"),
        F.expr("timestampadd(SECOND, o_orderkey % 86400, CAST(o_orderdate AS TIMESTAMP))").alias("created_at"))


FIRST = "first_time AS (SELECT o_custkey AS supplier_id, count(*) FILTER (o_orderkey % 6 = 0) <= 1 AS first_time FROM orders GROUP BY 1)"
ROUTED = f"""{CHECKS}, {FIRST},
flags AS (SELECT c.*, coalesce(f.first_time, true) AS first_time FROM checked c LEFT JOIN first_time f USING (supplier_id)),
routed AS (SELECT invoice_id, 'vat_invalid' AS reason_code, 1 AS priority FROM flags WHERE NOT r6
  UNION ALL SELECT invoice_id, 'math_mismatch', 1 FROM flags WHERE NOT (r1 AND r2 AND r5)
  UNION ALL SELECT invoice_id, 'supplier_unresolved', 1 FROM flags WHERE unresolved
  UNION ALL SELECT invoice_id, 'amount_above_threshold', 1 FROM flags WHERE total_with_vat > 10000
  UNION ALL SELECT invoice_id, 'first_time_supplier', 2 FROM flags WHERE first_time AND NOT unresolved
  UNION ALL SELECT invoice_id, 'low_confidence', 2 FROM flags WHERE NOT r7)"""


def routed(t):
    return K.route(K.checks(t.invoices, t.items, resolutions(t)), K.first_time_suppliers(log(t)))


@query("val_6_queue_rows", f"WITH {ROUTED} SELECT *, 'pending' AS status FROM routed", CHECK_TABLES)
def _(t):
    return K.queue_rows(routed(t))


@query("val_6_auto_accept", f"WITH {ROUTED} SELECT id AS invoice_id, id NOT IN (SELECT invoice_id FROM routed) AS auto_accept FROM invoices", CHECK_TABLES)
def _(t):
    return routed(t).select("invoice_id", "auto_accept")


@query("ag_31_first_time_suppliers", f"WITH {FIRST} SELECT * FROM first_time")
def _(t):
    return K.first_time_suppliers(log(t))


@query("wn_3_nth_resolution", """
SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate + to_seconds(o_orderkey % 86400), o_orderkey) AS nth
FROM orders WHERE o_orderkey % 6 = 0""")
def _(t):
    auto = log(t).where("created_by = 'auto'")
    return position(auto, ["resolved_supplier_id"], ["created_at", "id"], "nth").select("id", "nth")


TEXTS = "(SELECT id, CASE WHEN id % 83 = 0 THEN NULL ELSE total_without_vat::VARCHAR END AS s, vat_total::VARCHAR AS v, CASE WHEN id % 97 = 0 THEN 'n/a' ELSE total_with_vat::VARCHAR END AS g FROM invoices)"


@query("val_2_exact_totals", f"""
SELECT id, outcome, outcome IN ('skipped', 'exact') AS valid, CASE WHEN outcome IN ('exact', 'mismatch') THEN {num('gap')} END AS discrepancy FROM (
  SELECT id, gap, CASE WHEN s IS NULL OR v IS NULL OR g IS NULL THEN 'skipped' WHEN gap IS NULL THEN 'unreadable' WHEN gap = 0 THEN 'exact' ELSE 'mismatch' END AS outcome
  FROM (SELECT *, abs(try_cast(s AS DECIMAL(18,2)) + try_cast(v AS DECIMAL(18,2)) - try_cast(g AS DECIMAL(18,2))) AS gap FROM {TEXTS}))""", "invoices")
def _(t):
    f = t.invoices.select("id", F.expr("CASE WHEN id % 83 = 0 THEN NULL ELSE CAST(total_without_vat AS STRING) END").alias("subtotal"),
                          F.col("vat_total").cast("string").alias("vat_amount"),
                          F.expr("CASE WHEN id % 97 = 0 THEN 'n/a' ELSE CAST(total_with_vat AS STRING) END").alias("total"))
    return K.exact_totals(f).select("id", "outcome", "valid", "discrepancy")


# Longer numbers and exponents: thousands as 1e3, nine decimals, and one digit more than can be kept.
LONG = "(SELECT id, CASE WHEN id % 3 = 0 THEN (id % 1000) || 'e3' WHEN id % 3 = 1 THEN (id % 1000) || '.123456789' ELSE (id % 1000) || '.5E-2' END AS s, CASE WHEN id % 7 = 0 THEN '1e-19' ELSE '0.000000001' END AS v FROM invoices)"


@query("val_2_long_numbers", f"""
SELECT id, CASE WHEN gap IS NULL THEN 'unreadable' WHEN gap = 0 THEN 'exact' ELSE 'mismatch' END AS outcome, CAST(gap AS DOUBLE) AS discrepancy FROM (
  SELECT id, CASE WHEN v <> '1e-19' THEN abs(CASE WHEN id % 3 = 0 THEN (id % 1000) * 1000 WHEN id % 3 = 1 THEN (id % 1000) + 0.123456789 ELSE (id % 1000) * CAST(0.01 AS DECIMAL(4,2)) + 0.005 END
    + 0.000000001 - CASE WHEN id % 5 = 0 THEN CAST((id % 1000) AS DECIMAL(30,12)) + 0.123456790 ELSE 1 END) END AS gap FROM {LONG})""", "invoices")
def _(t):
    s = F.expr("CASE WHEN id % 3 = 0 THEN concat(id % 1000, 'e3') WHEN id % 3 = 1 THEN concat(id % 1000, '.123456789') ELSE concat(id % 1000, '.5E-2') END")
    g = F.expr("CASE WHEN id % 5 = 0 THEN concat(id % 1000, '.12345679') ELSE '1' END")
    f = t.invoices.select("id", s.alias("subtotal"), F.expr("CASE WHEN id % 7 = 0 THEN '1e-19' ELSE '0.000000001' END").alias("vat_amount"), g.alias("total"))
    return K.exact_totals(f).select("id", "outcome", F.col("discrepancy").cast("double").alias("discrepancy"))


@query("r_1_broken_queue_rows", """
SELECT id, 'priority' AS rule FROM queue WHERE id % 7 = 0 UNION ALL SELECT id, 'status' FROM queue WHERE id % 11 = 0
UNION ALL SELECT id, 'reason_code' FROM queue WHERE id % 13 = 0""", "queue")
def _(t):
    q = t.queue.withColumns({"priority": F.expr("CASE WHEN id % 7 = 0 THEN 9 ELSE priority END"), "status": F.expr("CASE WHEN id % 11 = 0 THEN 'gone' ELSE status END"),
                             "reason_code": F.expr("CASE WHEN id % 13 = 0 THEN 'other' ELSE reason_code END")})
    return K.violations(q, "id", K.queue_item_rules())


@query("r_1_invoice_violations", """
SELECT id, 'totals_agree' AS rule FROM invoices WHERE abs(total_with_vat - total_without_vat - vat_total) > 0.02""", "invoices")
def _(t):
    return K.violations(t.invoices, "id", K.invoice_rules())


@query("r_1_client_violations", """
SELECT id, 'ingest_channel' AS rule FROM clients WHERE drive_folder_id IS NULL AND NOT allows_manual_upload
UNION ALL SELECT id, 'capital_not_negative' FROM clients WHERE capital_social < 0""", "clients")
def _(t):
    return K.violations(t.clients, "id", K.client_rules())


@query("r_1_queue_violations", "SELECT id, 'priority' AS rule FROM queue WHERE priority NOT IN (1, 2, 3)", "queue")
def _(t):
    return K.violations(t.queue, "id", K.queue_item_rules())


@query("r_2_scoped_rows", """
SELECT l_orderkey AS draft_id, count(*) AS files FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) GROUP BY 1""")
def _(t):
    drafts = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uploaded_by"))
    files = t.raw("lineitem").select(F.col("l_orderkey").alias("draft_id"))
    return K.visible_rows(files, drafts, "draft_id", "id", F.col("uploaded_by") == 7).groupBy("draft_id").agg(F.count("*").alias("files"))


# --- review queue --------------------------------------------------------------

@query("jn_5_pending_queue", f"""
SELECT q.id, q.invoice_id, q.reason_code, q.priority, {stamp('q.created_at')} AS created_at, i.file_name, {num('i.total_with_vat')} AS total_with_vat, i.mime_type
FROM queue q LEFT JOIN invoices i ON i.id = q.invoice_id WHERE q.status = 'pending'""", "queue invoices")
def _(t):
    q = V.pending_queue(t.queue, t.invoices, t.invoices.select("document_hash", "mime_type"))
    return q.select("id", "invoice_id", "reason_code", "priority", "created_at", "invoice.file_name", "invoice.total_with_vat",
                    F.col("invoice.document.mime_type").alias("mime_type"))


@query("lim_4_queue_order", """
SELECT id, row_number() OVER (ORDER BY priority, created_at DESC, id) AS place FROM queue WHERE status = 'pending'""", "queue")
def _(t):
    q = t.queue.where("status = 'pending'")
    return position(q, [], ["priority", F.desc("created_at"), "id"], "place").select("id", "place")


@query("lim_5_nulls_last", """
SELECT supplier_id, avg_ms, row_number() OVER (ORDER BY avg_ms DESC NULLS LAST, supplier_id) AS place FROM (
  SELECT supplier_id, avg(CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE processing_time_ms END) AS avg_ms FROM invoices
  WHERE supplier_id IS NOT NULL GROUP BY 1)""", "invoices")
def _(t):
    per = (t.invoices.where("supplier_id IS NOT NULL").groupBy("supplier_id")
           .agg(F.avg(F.when(F.col("supplier_id") % 3 != 0, F.col("processing_time_ms"))).alias("avg_ms")))
    return position(per, [], [F.desc_nulls_last("avg_ms"), "supplier_id"], "place").select("supplier_id", "avg_ms", "place")


@query("ag_6_queue_stats", """
SELECT (SELECT count(*) FROM queue WHERE status = 'pending') AS total_pending, (SELECT count(*) FROM queue WHERE status = 'resolved') AS total_resolved,
  coalesce(reason_code, 'unknown') AS reason, count(*) AS pending FROM queue WHERE status = 'pending' GROUP BY 3""", "queue")
def _(t):
    return V.queue_stats(t.queue).select("total_pending", "total_resolved", F.explode("by_reason").alias("reason", "pending"))


@query("ag_7_queue_by_invoice", f"""
SELECT q.invoice_id, i.file_name, i.invoice_number, {num('i.total_with_vat')} AS total_with_vat, priority, queue_ids, reason_codes FROM (
  SELECT invoice_id, string_agg(id, ',' ORDER BY priority, created_at DESC, id) AS queue_ids, string_agg(coalesce(reason_code, ''), ',' ORDER BY priority, created_at DESC, id) AS reason_codes,
    arg_min(priority, (priority, -epoch_us(created_at), id)) AS priority FROM queue GROUP BY 1) q LEFT JOIN invoices i ON i.id = q.invoice_id""", "queue invoices")
def _(t):
    g = V.queue_by_invoice(t.queue, t.invoices)
    return g.select("invoice_id", "invoice.file_name", "invoice.invoice_number", "invoice.total_with_vat", "priority",
                    F.array_join(F.col("queue_ids").cast("array<string>"), ",").alias("queue_ids"), F.array_join("reason_codes", ",").alias("reason_codes"))


# --- duplicates -----------------------------------------------------------------

DUP = """
WITH f AS (SELECT *, (created_at, id) AS age FROM invoices_with_copies),
h AS (SELECT document_hash, arg_min(id, age) AS first_id FROM f GROUP BY 1),
k AS (SELECT issuer_nif, invoice_number, issue_date, total_with_vat, min(age) AS age, arg_min(id, age) AS first_id FROM f
  WHERE processing_status <> 'duplicado' AND issuer_nif IS NOT NULL AND invoice_number IS NOT NULL AND issue_date IS NOT NULL AND total_with_vat IS NOT NULL GROUP BY ALL),
d AS (SELECT f.id, CASE WHEN h.first_id <> f.id THEN h.first_id END AS a, CASE WHEN k.age < f.age THEN k.first_id END AS b
  FROM f JOIN h USING (document_hash) LEFT JOIN k USING (issuer_nif, invoice_number, issue_date, total_with_vat))"""


@query("jn_12_duplicates", DUP + """
SELECT id, coalesce(a, b) IS NOT NULL AS is_duplicate, coalesce(a, b) AS duplicate_of,
  CASE WHEN a IS NOT NULL THEN 'hash' WHEN b IS NOT NULL THEN 'fiscal_key' END AS matched_by FROM d""", "invoices_with_copies")
def _(t):
    return D.find_duplicates(t.invoices_with_copies)


@query("jn_13_fiscal_collisions", f"""
SELECT id, issuer_nif, invoice_number, {day('issue_date')} AS issue_date, count(*) OVER (PARTITION BY issuer_nif, invoice_number, issue_date) AS sharing
FROM invoices_with_copies WHERE processing_status <> 'duplicado' AND issuer_nif IS NOT NULL AND invoice_number IS NOT NULL AND issue_date IS NOT NULL
QUALIFY sharing > 1""", "invoices_with_copies")
def _(t):
    return D.fiscal_collisions(t.invoices_with_copies)


@query("wn_2_group_original", """
SELECT document_hash, min_by(id, (created_at, id)) AS original, count(*) AS n FROM invoices_with_copies GROUP BY 1 HAVING count(*) > 1""",
       "invoices_with_copies")
def _(t):
    g = D.group_originals(t.invoices_with_copies, ["document_hash"])
    return g.select("document_hash", F.col("first.id").alias("original"), "n")
