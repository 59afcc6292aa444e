from pyspark.sql import functions as F

from ..plans import evaluation as E
from .base import num, query, day
from .text import lcs_ctes, norm

FIELDS = ["invoice_number", "issue_date", "due_date", "issuer_name", "issuer_nif", "receiver_name", "receiver_nif",
          "total_with_vat", "total_without_vat", "vat_total", "document_type"]
# What the extraction got wrong, per case number (id); the same text on both sides.
WRONG = {
    "invoice_number": "CASE WHEN id % 9 = 0 THEN lower(invoice_number) || '  ' WHEN id % 10 = 1 THEN 'X' ELSE invoice_number END",
    "issue_date": "CASE WHEN id % 8 = 1 THEN NULL ELSE issue_date END",
    "issuer_name": "CASE WHEN id % 7 = 1 THEN replace(issuer_name, 'Supp', 'Sup') WHEN id % 7 = 2 THEN 'Completely Different' WHEN id % 7 = 3 THEN upper(issuer_name) || ' Lda.' ELSE issuer_name END",
    "issuer_nif": "CASE WHEN id % 6 = 1 THEN 'PT ' || issuer_nif ELSE issuer_nif END",
    "total_with_vat": "CASE WHEN id % 5 = 1 THEN total_with_vat + 0.02 WHEN id % 5 = 2 THEN total_with_vat + 0.03 ELSE total_with_vat END",
    "document_type": "CASE WHEN id % 11 = 1 THEN 'recibo' ELSE document_type END",
}
PRESENT = "id % 29 <> 5"  # cases the extractor gave no answer for


def expected(t):
    return t.invoices.select(F.col("id").alias("case_id"), *FIELDS, F.expr(
        "CASE WHEN id % 12 = 0 THEN array('due_date') ELSE CAST(array() AS array<string>) END").alias("manual_review"))


def actual(t):
    cols = [F.expr(WRONG.get(f, f)).alias(f) for f in FIELDS]
    return t.invoices.where(PRESENT).select(F.col("id").alias("case_id"), *cols)


def scored(t):
    return E.case_scores(expected(t), actual(t))


def both(e, a, same):
    return f"CASE WHEN {e} IS NULL AND {a} IS NULL THEN true WHEN {e} IS NULL OR {a} IS NULL THEN false ELSE {same} END"


def scorer(f):
    e, a = f"e.{f}", f"a.{f}"
    if f == "invoice_number":
        same = f"lower(trim({e})) = lower(trim({a}))"
    elif f.endswith("_name"):
        x, y = norm(e), norm(a)
        same = f"contains({x}, {y}) OR contains({y}, {x}) OR levenshtein({x}, {y}) <= 3"
    elif f.endswith("_nif"):
        same = rf"regexp_replace({e}, '\D', '', 'g') = regexp_replace({a}, '\D', '', 'g')"
    elif "total" in f:
        same = f"abs({e} - {a}) <= 0.02"
    else:
        same = f"{e} = {a}"
    return both(e, a, same)


ACTUAL = "act AS (SELECT id, " + ", ".join(f"{WRONG.get(f, f)} AS {f}" for f in FIELDS) + f" FROM invoices WHERE {PRESENT})"
LONG = f"{ACTUAL}, scores AS (" + " UNION ALL ".join(
    f"SELECT e.id AS case_id, '{f}' AS field, {scorer(f)} AS correct, e.{f} IS NOT NULL AND a.{f} IS NULL AS null_error "
    f"FROM invoices e JOIN act a ON a.id = e.id" + (" WHERE e.id % 12 <> 0" if f == "due_date" else "") for f in FIELDS) + ")"


@query("sco_1_field_scores", f"WITH {LONG} SELECT * FROM scores", "invoices")
def _(t):
    return E.field_scores(scored(t))


@query("jn_21_cases_joined", f"SELECT id AS case_id, NOT ({PRESENT}) AS skipped, CASE WHEN {PRESENT} THEN 11 - (id % 12 = 0)::INT ELSE 11 - (id % 12 = 0)::INT END AS fields FROM invoices", "invoices")
def _(t):
    return scored(t).select("case_id", "skipped", F.size("scores").alias("fields"))


REQ = ", ".join(f"'{r}'" for r in E.REQUIRED)
BY_FIELD = f"""acc AS (SELECT field, count(*) FILTER (correct) * 100 / count(*)::DOUBLE AS accuracy,
  CASE WHEN field IN ({REQ}) THEN count(*) FILTER (null_error) * 100 / (SELECT count(*) FROM act)::DOUBLE END AS null_rate FROM scores GROUP BY 1)"""


@query("ag_33_field_accuracy", f"WITH {LONG}, {BY_FIELD} SELECT * FROM acc", "invoices")
def _(t):
    return E.field_accuracy(scored(t))


OVERALL = f"""summary AS (SELECT (SELECT count(*) FROM invoices) AS total_cases, (SELECT count(*) FROM act) AS evaluated,
  (SELECT count(*) FROM invoices) - (SELECT count(*) FROM act) AS skipped, p.n AS pass_count, p.n * 100 / (SELECT count(*) FROM act)::DOUBLE AS overall_accuracy,
  (SELECT count(*) FILTER (abs(total_without_vat + vat_total - total_with_vat) > 0.02) * 100 / count(total_with_vat)::DOUBLE FROM act) AS math_error_rate
  FROM (SELECT count(*) AS n FROM (SELECT case_id FROM scores GROUP BY 1 HAVING bool_and(correct))) p)"""


@query("ag_33_overall_accuracy", f"WITH {LONG}, {OVERALL} SELECT * FROM summary", "invoices")
def _(t):
    return E.overall_accuracy(scored(t))


@query("ag_35_gate_reasons", f"""WITH {LONG}, {BY_FIELD}, {OVERALL}
SELECT 'overall_accuracy' AS measure, NULL AS field, overall_accuracy AS value FROM summary WHERE overall_accuracy < 95
UNION ALL SELECT 'math_error_rate', NULL, math_error_rate FROM summary WHERE math_error_rate > 0
UNION ALL SELECT 'accuracy', field, accuracy FROM acc WHERE accuracy < 90 UNION ALL SELECT 'null_rate', field, null_rate FROM acc WHERE null_rate > 10""", "invoices")
def _(t):
    s = scored(t)
    return E.gate_reasons(E.overall_accuracy(s), E.field_accuracy(s))


@query("wn_4_accuracy_deltas", f"""
SELECT report_date, field, accuracy, round(accuracy - lag(accuracy) OVER (PARTITION BY field ORDER BY report_date), 6) AS delta FROM (
  SELECT {day("date_trunc('month', created_at)")} AS report_date, coalesce(document_type, 'none') AS field,
    count(*) FILTER (processing_status = 'ok') * 100 / count(*)::DOUBLE AS accuracy FROM invoices GROUP BY 1, 2)""", "invoices")
def _(t):
    history = t.invoices.groupBy(F.trunc("created_at", "MM").alias("report_date"), F.coalesce("document_type", F.lit("none")).alias("field")) \
        .agg((F.count_if(F.col("processing_status") == "ok") * 100 / F.count("*")).alias("accuracy"))
    return E.accuracy_deltas(history).withColumn("delta", F.round("delta", 6))


# --- nested comparisons ---------------------------------------------------------------

def nested(t):
    """Expected and actual bands and items, with errors by case number."""
    band = "named_struct('rate', {r}, 'base', total_without_vat, 'amount', {a})"
    item = lambda n, d="'consulting work'", q="1.000", g="vat_total": (
        f"named_struct('line_number', {n}, 'description', {d}, 'quantity', CAST({q} AS DECIMAL(12,4)), 'unit_price', vat_total, 'net_amount', vat_total, "
        f"'vat_rate', 23, 'vat_amount', vat_total, 'gross_amount', CAST({g} AS DECIMAL(14,2)))")
    e_band = f"array({band.format(r=23, a='vat_total')}, {band.format(r=6, a='vat_total')})"
    a_band = ("CASE id % 5 WHEN 0 THEN array({x}) WHEN 1 THEN array({y6}, {y23}) WHEN 2 THEN array({off}, {y6}) WHEN 3 THEN array({y23}, {y13}) ELSE array({y23}, {near}) END").format(
        x=band.format(r=23, a="vat_total"), y6=band.format(r=6, a="vat_total"), y23=band.format(r=23, a="vat_total"),
        off=band.format(r=23, a="CAST(vat_total + 1 AS DECIMAL(14,2))"), y13=band.format(r=13, a="vat_total"), near=band.format(r=6, a="CAST(vat_total + 0.02 AS DECIMAL(14,2))"))
    e_items = f"array({item('2')}, {item('CAST(NULL AS INT)')})"
    a_items = (f"CASE id % 5 WHEN 0 THEN array({item('0')}) WHEN 1 THEN array({item('0')}, {item('5')}) WHEN 2 THEN array({item('2', q='1.002')}, {item('1')}) "
               f"WHEN 3 THEN array({item('1', d=chr(39) + 'consulting wrk' + chr(39))}, {item('2')}) ELSE array({item('1')}, {item('2', g='vat_total + 0.03')}) END")
    e = t.invoices.select(F.col("id").alias("case_id"), F.expr(e_band).alias("vat_breakdown"), F.expr(e_items).alias("items"))
    a = t.invoices.select(F.col("id").alias("case_id"), F.expr(a_band).alias("vat_breakdown"), F.expr(a_items).alias("items"))
    return E.field_scores(E.case_scores(e, a))


@query("sco_2_band_scores", """SELECT id AS case_id, CASE WHEN vat_total IS NULL THEN id % 5 IN (1, 2, 4) ELSE id % 5 IN (1, 4) END AS correct FROM invoices""", "invoices")
def _(t):
    return nested(t).where("field = 'vat_breakdown'").select("case_id", "correct")


@query("sco_3_item_scores", """SELECT id AS case_id, CASE WHEN vat_total IS NULL THEN id % 5 IN (1, 3, 4) ELSE id % 5 IN (1, 3) END AS correct FROM invoices""", "invoices")
def _(t):
    return nested(t).where("field = 'items'").select("case_id", "correct")


@query("lim_6_items_in_order", """
SELECT invoice_id AS id, string_agg(CASE WHEN line_number % 3 = 0 THEN 0 ELSE line_number END || ':' || description, ','
    ORDER BY CASE WHEN line_number % 3 = 0 THEN 0 ELSE line_number END, description) AS lines FROM items GROUP BY 1""", "items")
def _(t):
    # Every third line has lost its number.
    item = F.struct(F.expr("CASE WHEN line_number % 3 <> 0 THEN line_number END").alias("line_number"), "description")
    items = t.items.groupBy(F.col("invoice_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # lines of one invoice
    shown = F.transform(E.in_line_order(F.col("items")), lambda x: F.concat(F.coalesce(x["line_number"], F.lit(0)).cast("string"), F.lit(":"), x["description"]))
    return items.select("id", F.array_join(shown, ",").alias("lines"))


# --- parity -----------------------------------------------------------------------------

def cases(t, wrong: bool):
    pick = (lambda e, bad: F.expr(bad) if wrong else F.expr(e))
    return t.invoices.select(
        F.col("id").alias("case_id"), pick("issuer_name", "CASE WHEN id % 7 = 1 THEN replace(issuer_name, 'Supp', 'Sup') ELSE issuer_name END").alias("supplier_name"),
        F.col("issuer_nif").alias("supplier_nif"), pick("invoice_number", "CASE WHEN id % 9 = 0 THEN 'X' ELSE invoice_number END").alias("invoice_number"),
        F.col("issue_date").cast("string").alias("invoice_date"), F.col("total_without_vat").cast("string").alias("subtotal"),
        pick("vat_total", "CASE WHEN id % 5 = 0 THEN vat_total + 1 ELSE vat_total END").cast("string").alias("vat_amount"),
        F.col("total_with_vat").cast("string").alias("total"), F.lit("23").alias("vat_rate"), "currency")


def _same(x, e):
    return f"CASE WHEN {x} IS NULL AND {e} IS NULL THEN 1.0::DOUBLE WHEN {x} IS NULL OR {e} IS NULL THEN 0.0::DOUBLE WHEN {x} = {e} THEN 1.0::DOUBLE"


PARITY = f"""
compared AS (SELECT id AS case_id, CASE WHEN id % 7 = 1 THEN replace(issuer_name, 'Supp', 'Sup') ELSE issuer_name END AS xs, issuer_name AS es,
  CASE WHEN id % 9 = 0 THEN 'X' ELSE invoice_number END AS xi, invoice_number AS ei, CASE WHEN id % 5 = 0 THEN vat_total + 1 ELSE vat_total END AS xv, vat_total AS ev FROM invoices),
unequal AS (SELECT xs AS a, es AS b FROM compared WHERE xs <> es UNION ALL SELECT xi, ei FROM compared WHERE xi <> ei),
{lcs_ctes('unequal')},
fields AS (SELECT case_id, {_same('xs', 'es')} ELSE s.ratio END AS supplier_name, {_same('xi', 'ei')} ELSE n.ratio END AS invoice_number,
  {_same('xv', 'ev')} ELSE 0.0::DOUBLE END AS vat_amount FROM compared LEFT JOIN indel s ON s.a = xs AND s.b = es LEFT JOIN indel n ON n.a = xi AND n.b = ei),
scores AS (SELECT *, 1.0::DOUBLE AS supplier_nif, 1.0::DOUBLE AS invoice_date, 1.0::DOUBLE AS subtotal, 1.0::DOUBLE AS total, 1.0::DOUBLE AS vat_rate, 1.0::DOUBLE AS currency,
  (supplier_name + 1 + invoice_number + 1 + 1 + vat_amount + 1 + 1 + 1) / 9 AS overall_score FROM fields)"""


@query("sco_4_parity_scores", f"WITH {PARITY} SELECT *, overall_score >= 0.98 AS passing FROM scores", "invoices")
def _(t):
    return E.parity(cases(t, True), cases(t, False))


@query("ag_34_parity_gate", f"""
WITH {PARITY} SELECT round(avg(overall_score), 9) AS mean_score, round(min(overall_score), 9) AS lowest, count(*) AS cases,
  avg(overall_score) >= 0.98 AND min(overall_score) >= 0.95 AS passed FROM scores""", "invoices")
def _(t):
    gate = E.parity_gate(E.parity(cases(t, True), cases(t, False)))
    return gate.withColumns({c: F.round(c, 9) for c in ("mean_score", "lowest")})


@query("ag_34_parity_of_equals", "SELECT id AS case_id, 1.0::DOUBLE AS overall_score, true AS passing FROM invoices", "invoices")
def _(t):
    return E.parity(cases(t, False), cases(t, False)).select("case_id", F.round("overall_score", 9).alias("overall_score"), "passing")
