from ..bindings import as_of
from ..plans import quality as Q, sla as S
from .base import cents, day, half_up, num, query, stamp

WIN = "created_at >= (SELECT max(created_at) FROM invoices) - INTERVAL {d} DAY"
W30, W7 = WIN.format(d=30), WIN.format(d=7)


def pct(part, whole="count(*)", dp=2):
    return half_up(f"100 * ({part})", whole, dp)


def n_if(cond):
    return f"count(*) FILTER ({cond})"


def st(s):
    return n_if(f"processing_status = '{s}'")


@query("ag_5_status_counters", "SELECT count(*) AS total, " + ", ".join(
    f"{st(s)} AS {s}" for s in Q.STATUSES) + " FROM invoices", "invoices")
def _(t):
    return Q.status_counters(t.invoices)


@query("ag_9_extraction_quality", f"""
SELECT {stamp("date_trunc('day', created_at)::TIMESTAMP")} AS day, count(*) AS total, {st('ok')} AS ok_count,
  {st('requires_review')} AS review_count, {st('failed')} AS fail_count, {st('duplicado')} AS duplicate_count,
  {pct(st('ok'))} AS ok_rate, {pct(st('requires_review'))} AS review_rate, {pct(st('failed'))} AS fail_rate
FROM invoices GROUP BY date_trunc('day', created_at)""", "invoices")
def _(t):
    return Q.extraction_quality(t.invoices)


ERRORS = """(SELECT *, unnest(from_json(math_validation_result::JSON -> 'errors', '["VARCHAR"]')) AS error FROM invoices)"""


@query("json_1_check_errors", f"SELECT id, error FROM {ERRORS}", "invoices")
def _(t):
    return Q.check_errors(t.invoices, "id").select("id", "error")


@query("ag_10_check_errors_by_day", f"""
SELECT {stamp("date_trunc('day', created_at)::TIMESTAMP")} AS day, count(*) AS invoices_with_math_errors,
""" + ", ".join(f"{n_if(f'error LIKE {chr(39)}R{i}%{chr(39)}')} AS {n}" for i, n in enumerate([
    "r1_total_integrity", "r2_items_sum", "r3_vat_sum", "r4_line_coherence", "r5_breakdown_mismatch",
    "r6_invalid_vat_rate", "r7_credit_note"], 1)) + f"""
FROM {ERRORS} WHERE math_validation_result LIKE '%"valid": false%' GROUP BY date_trunc('day', created_at)""", "invoices")
def _(t):
    return Q.check_errors_by_day(t.invoices)


@query("jn_4_vat_mismatches", f"""
SELECT e.id, e.invoice_number, s.nif AS supplier_nif, coalesce(s.commercial_name, s.legal_name, s.nif) AS supplier_name,
  {num('e.vat_total')} AS vat_total, e.processing_status, {stamp('e.created_at')} AS created_at, e.error AS mismatch_detail
FROM {ERRORS} e LEFT JOIN suppliers s ON s.id = e.supplier_id WHERE substr(e.error, 1, 2) IN ('R5', 'R6')""",
       "invoices suppliers")
def _(t):
    return Q.vat_mismatches(t.invoices, t.suppliers)


SUPPLIER_QUALITY = f"""
SELECT s.nif AS supplier_nif, coalesce(s.commercial_name, s.legal_name, s.nif) AS supplier_name, c.name AS category,
  count(*) AS total_invoices, {st('ok')} AS ok_count, {st('requires_review')} AS review_count,
  {st('failed')} AS fail_count, {pct(n_if("processing_status IN ('requires_review', 'failed')"))} AS error_rate_pct
FROM suppliers s LEFT JOIN categories c ON c.id = s.category_id LEFT JOIN invoices i ON i.supplier_id = s.id
GROUP BY s.nif, s.commercial_name, s.legal_name, c.name"""


@query("ag_11_supplier_quality", SUPPLIER_QUALITY, "suppliers categories invoices")
def _(t):
    return Q.supplier_quality(t.suppliers, t.categories, t.invoices)


@query("jn_3_supplier_outer_count", f"SELECT supplier_nif, total_invoices FROM ({SUPPLIER_QUALITY})",
       "suppliers categories invoices")
def _(t):
    return Q.supplier_quality(t.suppliers, t.categories, t.invoices).select("supplier_nif", "total_invoices")


MISSING = " UNION ALL ".join(
    f"SELECT '{f}' AS field_name, {n_if(f + ' IS NULL')} AS null_count, count(*) AS total, "
    f"{pct(n_if(f + ' IS NULL'))} AS missing_pct FROM invoices" for f in Q.HEADER_FIELDS)


@query("ag_12_missing_fields", MISSING, "invoices")
def _(t):
    return Q.missing_fields(t.invoices)


@query("ag_17_ai_quality", f"""
SELECT {half_up(cents('sum(llm_confidence)'), '(100 * count(llm_confidence))', 4)} AS avg_confidence,
  {pct(n_if('llm_confidence >= 0.90'))} AS auto_approvable_pct, {pct(n_if('review_required'))} AS requires_review_pct,
  {pct(n_if("approval_status = 'edited'"), n_if("approval_status IN ('approved', 'edited', 'rejected')"))} AS correction_rate_pct,
  count(*) AS total_invoices FROM invoices WHERE {W30}""", "invoices")
def _(t):
    i = t.invoices_by_month("llm_confidence", "review_required", "approval_status")
    return Q.ai_quality(i, 30, as_of(i))


@query("ag_18_confidence_trend", f"""
SELECT {day('created_at')} AS day, {half_up(cents('sum(llm_confidence)'), '(100 * count(*))', 4)} AS avg_confidence,
  count(*) AS invoice_count FROM invoices WHERE {W30} AND llm_confidence IS NOT NULL GROUP BY 1""", "invoices")
def _(t):
    i = t.invoices_by_month("llm_confidence")
    return Q.confidence_trend(i, 30, as_of(i))


@query("json_2_confidence_entries", "SELECT invoice_id AS id, field_key AS field_name, conf_c / 100.0::DOUBLE AS confidence "
       "FROM confidences", "confidences")
def _(t):
    return Q.confidence_entries(t.invoices, "id")


# Confidences with nine decimals, one field each.
NANO = "(id * 7919 + client_id * 104729) % 1000000007"
FIELD = "CASE WHEN id % 2 = 0 THEN 'total_with_vat' ELSE 'currency' END"


def nano_invoices(t):
    from pyspark.sql import functions as F
    return t.invoices_by_month("id", "client_id").withColumn("field_confidence", F.expr(f"map({FIELD}, CAST({NANO} AS DOUBLE) / 1000000000D)"))


@query("json_2_nine_decimals", f"SELECT id, {FIELD} AS field_name, ({NANO})::DOUBLE / 1e9 AS confidence FROM invoices", "invoices")
def _(t):
    return Q.confidence_entries(nano_invoices(t), "id")


@query("ag_19_nine_decimals", f"""
SELECT k.legal_name AS client_name, field_name, {half_up('sum(v)', '(1000000000 * count(*))', 4)} AS avg_confidence
FROM (SELECT client_id, {FIELD} AS field_name, {NANO} AS v FROM invoices WHERE {W30}) x JOIN clients k ON k.id = x.client_id GROUP BY 1, 2""", "invoices clients")
def _(t):
    i = nano_invoices(t)
    return Q.field_confidence_by_client(i, t.clients, 30, as_of(i))


@query("ag_28_nine_decimals", f"""
SELECT client_id, field_key, count(*) AS sample_size, {half_up('sum(v)', '(1000000000 * count(*))', 4)} AS avg_confidence,
  {half_up('CAST(2 * quantile_cont(v, 0.5) AS BIGINT)', '2000000000', 4)} AS median_confidence
FROM (SELECT client_id, {FIELD} AS field_key, {NANO} AS v FROM invoices WHERE {W30}) GROUP BY 1, 2""", "invoices")
def _(t):
    i = nano_invoices(t)
    return Q.confidence_rollup(i, as_of(i))


@query("ag_36_nine_decimals", f"""
SELECT id, ((2 * (v * w + 500000000::BIGINT * (15 - w)) + 15 * 10000000) // (30 * 10000000)) / 100.0::DOUBLE AS confidence
FROM (SELECT id, {NANO} AS v, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS w FROM invoices)""", "invoices")
def _(t):
    from pyspark.sql import functions as F
    from ..functions import confidence
    return nano_invoices(t).select("id", confidence.overall(F.col("field_confidence")).cast("double").alias("confidence"))


CONF = f"(SELECT i.client_id, c.field_key, c.conf_c FROM confidences c JOIN invoices i ON i.id = c.invoice_id WHERE {W30})"


@query("ag_19_field_confidence_by_client", f"""
SELECT k.legal_name AS client_name, x.field_key AS field_name,
  {half_up('sum(x.conf_c)', '(100 * count(*))', 4)} AS avg_confidence
FROM {CONF} x JOIN clients k ON k.id = x.client_id GROUP BY 1, 2""", "confidences invoices clients")
def _(t):
    i = t.invoices_by_month("client_id", "field_confidence")
    return Q.field_confidence_by_client(i, t.clients, 30, as_of(i))


@query("jn_7_field_confidence_client_counts", f"""
SELECT k.legal_name AS client_name, count(*) AS n FROM {CONF} x JOIN clients k ON k.id = x.client_id GROUP BY 1""",
       "confidences invoices clients")
def _(t):
    from pyspark.sql import functions as F
    i = t.invoices_by_month("client_id", "field_confidence")
    per = Q.confidence_entries(i.where(Q.since("created_at", 30, as_of(i))), "client_id") \
        .groupBy("client_id").agg(F.count("*").alias("n"))
    return per.join(t.clients.select(F.col("id").alias("client_id"), "legal_name"), "client_id") \
        .groupBy(F.col("legal_name").alias("client_name")).agg(F.sum("n").alias("n"))


@query("ag_25_latency_percentiles", """
SELECT client_id, count(*) AS total_invoices, """ + ", ".join(
    f"quantile_cont(processing_time_ms, 0.{q}) AS p{q}_ms" for q in (50, 75, 90, 95, 99)) + """,
  max(processing_time_ms) AS max_ms, min(processing_time_ms) AS min_ms, avg(processing_time_ms) AS avg_ms
FROM invoices WHERE processing_time_ms IS NOT NULL GROUP BY 1""", "invoices")
def _(t):
    return Q.latency_percentiles(t.invoices)


@query("ag_26_extraction_rollup", f"""
SELECT client_id, {stamp("date_trunc('day', created_at)::TIMESTAMP")} AS day, count(*) AS total, {st('ok')} AS ok_count,
  {st('requires_review')} AS review_count, {st('error')} AS error_count, {pct(st('ok'))} AS ok_rate_pct
FROM invoices WHERE {W30} GROUP BY client_id, date_trunc('day', created_at)""", "invoices")
def _(t):
    i = t.invoices_by_month("client_id", "processing_status")
    return Q.extraction_rollup(i, as_of(i))


@query("ag_27_supplier_rollup", f"""
SELECT i.client_id, i.supplier_id, coalesce(s.commercial_name, s.legal_name, s.nif) AS supplier_name,
  count(*) AS total, {st('ok')} AS ok_count,
  {half_up('sum(i.processing_time_ms)', 'count(i.processing_time_ms)', 0)} AS avg_processing_ms
FROM invoices i LEFT JOIN suppliers s ON s.id = i.supplier_id
WHERE i.supplier_id IS NOT NULL AND i.{W30} GROUP BY ALL""", "invoices suppliers")
def _(t):
    i = t.invoices_by_month("client_id", "supplier_id", "processing_status", "processing_time_ms")
    return Q.supplier_rollup(i, t.suppliers, as_of(i))


@query("ag_28_confidence_rollup", f"""
SELECT client_id, field_key, count(*) AS sample_size, {half_up('sum(conf_c)', '(100 * count(*))', 4)} AS avg_confidence,
  {half_up('CAST(2 * quantile_cont(conf_c, 0.5) AS BIGINT)', '200', 4)} AS median_confidence
FROM {CONF} GROUP BY 1, 2""", "confidences invoices")
def _(t):
    i = t.invoices_by_month("client_id", "field_confidence")
    return Q.confidence_rollup(i, as_of(i))


# --- service levels -----------------------------------------------------------

TIMED = f"""(SELECT i.id, date_diff('second', i.created_at, a.decided_at) AS secs
FROM invoices i LEFT JOIN approvals a ON a.invoice_id = i.id WHERE i.{W7})"""
BACKLOG = "FROM queue WHERE status = 'pending' AND priority = 1"
CARD = f"""SELECT {half_up('sum(secs)', '(3600 * count(secs))', 1)} AS avg_approval_hours,
  {half_up('count(*)', '7', 1)} AS daily_throughput, {pct(n_if('secs <= 86400'), dp=1)} AS sla_24h_pct,
  count(*) AS total_processed, (SELECT count(*) {BACKLOG}) AS critical_backlog FROM {TIMED}"""


@query("jn_8_approval_hours", f"SELECT id AS invoice_id, secs / 3600.0::DOUBLE AS hours FROM {TIMED}", "invoices approvals")
def _(t):
    i = t.invoices_by_month("id")
    return S.approval_hours(i, t.approvals, 7, as_of(i))


@query("ag_20_sla_card", CARD, "invoices approvals queue")
def _(t):
    i = t.invoices_by_month("id")
    return S.sla_card(i, t.approvals, t.queue, 7, as_of(i))


FUNNEL = f"""SELECT count(*) AS uploaded, count(llm_confidence) AS extracted, {n_if('review_required')} AS review,
  """ + ", ".join(f"{n_if(f'approval_status = {chr(39)}{s}{chr(39)}')} AS {s}"
                  for s in ("approved", "edited", "rejected", "pending")) + f" FROM invoices WHERE {W7}"


@query("ag_21_stage_funnel", FUNNEL, "invoices")
def _(t):
    i = t.invoices_by_month("llm_confidence", "review_required", "approval_status")
    return S.funnel(i, 7, as_of(i))


@query("ag_22_daily_throughput", f"SELECT {day('created_at')} AS day, count(*) AS count FROM invoices WHERE {W7} GROUP BY 1",
       "invoices")
def _(t):
    i = t.invoices_by_month()
    return S.throughput(i, 7, as_of(i))


APPROVERS = f"""
SELECT s.id AS staff_id, s.full_name AS name, count(a.id) AS count,
  {half_up("sum(date_diff('second', i.created_at, a.decided_at))", '(3600 * count(*))', 1)} AS avg_hours
FROM approvals a JOIN invoices i ON i.id = a.invoice_id JOIN staff s ON s.id = a.decided_by
WHERE a.decided_at >= (SELECT max(created_at) FROM invoices) - INTERVAL {{d}} DAY GROUP BY 1, 2"""


@query("ag_23_approver_performance", APPROVERS.format(d=7), "invoices approvals staff")
def _(t):
    i = t.invoices_by_month("id")
    return S.approvers(t.approvals, i, t.staff, 7, as_of(i))


@query("jn_9_approver_joins", APPROVERS.format(d=365), "invoices approvals staff")
def _(t):
    i = t.invoices_by_month("id")
    return S.approvers(t.approvals, i, t.staff, 365, as_of(i))


@query("lim_3_critical_backlog", f"""
SELECT invoice_id, reason_code, {stamp('created_at')} AS created_at,
  {half_up("date_diff('second', created_at, (SELECT max(created_at) FROM queue))", '3600', 1)} AS hours_waiting
{BACKLOG}""", "queue")
def _(t):
    return S.critical_backlog(t.queue, as_of(t.queue))


@query("ag_24_sla_document", f"""
SELECT c.*, f.uploaded, f.approved, f.pending, (SELECT string_agg(day || ':' || count, ',' ORDER BY day) FROM (SELECT {day('created_at')} AS day, count(*) AS count FROM invoices WHERE {W7} GROUP BY 1)) AS days,
  (SELECT string_agg(staff_id || ':' || name || ':' || count || ':' || CAST(round(10 * avg_hours) AS BIGINT), ',' ORDER BY count DESC, staff_id) FROM ({APPROVERS.format(d=7)})) AS approvers
FROM ({CARD}) c, ({FUNNEL}) f""", "invoices approvals queue staff")
def _(t):
    from pyspark.sql import functions as F
    i = t.invoices_by_month("id", "llm_confidence", "review_required", "approval_status")
    doc = S.sla_document(i, t.approvals, t.queue, t.staff, 7, as_of(i))
    listed = lambda c, one: F.array_join(F.transform(c, one), ",")
    return doc.select("kpis.*", "funnel.uploaded", "funnel.approved", "funnel.pending",
                      listed("throughput_by_day", lambda x: F.concat_ws(":", x["day"].cast("string"), x["count"])).alias("days"),
                      listed("approvers", lambda x: F.concat_ws(":", x["staff_id"], x["name"], x["count"], F.round(10 * x["avg_hours"]).cast("long"))).alias("approvers"))


@query("ag_24_sla_bundle", f"""
SELECT section, count(*) AS entries FROM (
  SELECT 'kpis' AS section FROM ({CARD}) UNION ALL SELECT 'funnel' FROM ({FUNNEL})
  UNION ALL SELECT 'throughput_by_day' FROM (SELECT {day('created_at')} FROM invoices WHERE {W7} GROUP BY 1)
  UNION ALL SELECT 'approvers' FROM ({APPROVERS.format(d=7)})
  UNION ALL SELECT 'critical_backlog_items' {BACKLOG}) GROUP BY 1""", "invoices approvals queue staff")
def _(t):
    from pyspark.sql import functions as F
    i = t.invoices_by_month("id", "llm_confidence", "review_required", "approval_status")
    return (S.sla_bundle(i, t.approvals, t.queue, t.staff, 7, as_of(i))
            .groupBy("section").agg(F.count("body").alias("entries")))
