from ..bindings import as_of
from ..plans import accounting as A
from .base import cents, day, half_up, num, query

TOTALS = f"""
SELECT s.id AS supplier_id, s.nif, coalesce(s.commercial_name, s.legal_name, s.nif) AS supplier_name,
  c.name AS category, c.slug AS category_slug, s.subcategory, s.country,
  count(DISTINCT i.id) AS invoice_count,
  {num('coalesce(sum(i.total_without_vat), 0)')} AS total_net, {num('coalesce(sum(i.vat_total), 0)')} AS total_vat,
  {num('coalesce(sum(i.total_with_vat), 0)')} AS total_gross,
  {day('min(i.issue_date)')} AS first_invoice_date, {day('max(i.issue_date)')} AS last_invoice_date
FROM suppliers s LEFT JOIN categories c ON c.id = s.category_id
LEFT JOIN invoices i ON i.supplier_id = s.id AND i.processing_status = 'ok'
GROUP BY ALL"""


@query("ag_13_supplier_totals", TOTALS, "suppliers categories invoices")
def _(t):
    return A.supplier_totals(t.suppliers, t.categories, t.invoices)


@query("jn_1_supplier_totals", f"""
SELECT supplier_id, nif, country, invoice_count, total_gross FROM ({TOTALS})""", "suppliers categories invoices")
def _(t):
    return A.supplier_totals(t.suppliers, t.categories, t.invoices).select(
        "supplier_id", "nif", "country", "invoice_count", "total_gross")


BY_CATEGORY = f"""
SELECT c.slug AS category_slug, c.name AS category, s.nif AS supplier_nif, s.name AS supplier_name,
  d.description, d.vat_rate, count(*) AS occurrences, {num('sum(d.net_amount)')} AS total_net,
  {num('sum(d.vat_amount)')} AS total_vat, {num('sum(d.gross_amount)')} AS total_gross,
  {half_up(cents('sum(d.gross_amount)'), '(100 * count(*))', 2)} AS avg_gross_per_occurrence
FROM items d JOIN suppliers s ON s.id = d.supplier_id LEFT JOIN categories c ON c.id = s.category_id
GROUP BY c.slug, c.name, s.nif, s.name, d.description, d.vat_rate"""


@query("ag_14_items_by_category", BY_CATEGORY, "items suppliers categories")
def _(t):
    return A.items_by_category(t.items, t.suppliers, t.categories)


@query("lim_7_category_ranking", f"""
SELECT category_slug, supplier_nif, description, vat_rate::DOUBLE AS vat_rate, row_number() OVER (ORDER BY total_gross DESC NULLS LAST, category_slug NULLS FIRST, supplier_nif, description, vat_rate NULLS FIRST) AS place
FROM ({BY_CATEGORY})""", "items suppliers categories")
def _(t):
    from pyspark.sql import functions as F
    from ..operators.skew import position
    order = [F.desc_nulls_last("total_gross"), "category_slug", "supplier_nif", "description", "vat_rate"]
    ranked = position(A.items_by_category(t.items, t.suppliers, t.categories), [], [c if not isinstance(c, str) else F.col(c).asc() for c in order], "place")
    return ranked.select("category_slug", "supplier_nif", "description", "vat_rate", "place")


@query("jn_2_items_with_category", f"""
SELECT category_slug, supplier_nif, sum(occurrences)::BIGINT AS occurrences FROM ({BY_CATEGORY}) GROUP BY 1, 2""",
       "items suppliers categories")
def _(t):
    from pyspark.sql import functions as F
    return (A.items_by_category(t.items, t.suppliers, t.categories)
            .groupBy("category_slug", "supplier_nif").agg(F.sum("occurrences").alias("occurrences")))


def _ageing(col):
    return f"""
SELECT CASE WHEN d <= 30 THEN 'current' WHEN d <= 60 THEN 'overdue-30' WHEN d <= 90 THEN 'overdue-60'
  ELSE 'overdue-90' END AS bucket, count(*) AS invoice_count, {num('sum(amount_due)')} AS total_amount_due
FROM (SELECT amount_due, date_diff('day', {col}, CAST((SELECT max(created_at) FROM invoices) AS DATE)) AS d
  FROM invoices WHERE payment_status <> 'paid' AND processing_status = 'ok' AND {col} IS NOT NULL) GROUP BY 1"""


@query("ag_15_ageing_report", _ageing("due_date"), "invoices")
def _(t):
    return A.ageing_report(t.invoices, as_of(t.invoices).cast("date"))


@query("ag_15_ageing_by_issue_date", _ageing("issue_date"), "invoices")
def _(t):
    return A.ageing_report(t.invoices, as_of(t.invoices).cast("date"), "issue_date")


@query("ag_16_cash_flow", f"""
SELECT {day("date_trunc('month', issue_date)")} AS month, count(*) AS invoice_count,
  {num('coalesce(sum(total_with_vat), 0)')} AS total_outflow
FROM invoices WHERE processing_status = 'ok' GROUP BY 1""", "invoices")
def _(t):
    return A.cash_flow(t.invoices)
