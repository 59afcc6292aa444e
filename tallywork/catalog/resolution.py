from pyspark.sql import functions as F

from ..functions.names import match_name
from ..operators import fuzzy as Z, ledger as L, resolve as R
from .base import query, stamp
from .text import checksum, jw_ctes, look, norm

NAMES = f"(SELECT DISTINCT {norm('input_name')} AS a FROM requests WHERE input_name <> '')"


@query("jn_15_closest_names", f"""
WITH pairs AS (SELECT a, normalized_name AS b, min(id) AS id FROM {NAMES}, suppliers GROUP BY 1, 2), {jw_ctes('pairs')}
SELECT a AS name, arg_min(id, (-score, id)) AS id, max(score) AS score FROM pairs JOIN jw USING (a, b) WHERE score >= 0.82 GROUP BY 1""",
       "requests suppliers")
def _(t):
    names = t.requests.where("input_name <> ''").select(match_name(F.col("input_name")).alias("name"))
    return Z.closest_names(names, t.suppliers.select("id", F.col("normalized_name").alias("entry")))


RESOLVED = f"""
req AS (SELECT document_id, input_nif, input_name, {norm('input_name')} AS a FROM requests),
l1 AS (SELECT r.*, s.id AS s1, (SELECT min(x.supplier_id) FROM aliases x WHERE x.alias_type = 'nif' AND x.alias_text = r.input_nif) AS s2
  FROM req r LEFT JOIN suppliers s ON s.nif = r.input_nif),
al AS (SELECT {norm('alias_text')} AS a, min_by(supplier_id, (alias_type, supplier_id)) AS s3 FROM aliases
  WHERE alias_type IN ('name_exact', 'manual') GROUP BY 1),
l3 AS (SELECT l1.*, al.s3 FROM l1 LEFT JOIN al USING (a)),
pairs AS (SELECT DISTINCT l3.a, s.normalized_name AS b, s.id FROM l3, suppliers s WHERE coalesce(s1, s2, s3) IS NULL AND l3.a IS NOT NULL),
{jw_ctes('pairs')},
best AS (SELECT a, arg_min(id, (-score, id)) AS s4, max(score) AS score FROM pairs JOIN jw USING (a, b) WHERE score >= 0.82 GROUP BY 1),
resolved AS (SELECT document_id, input_nif, input_name, coalesce(s1, s2, s3, s4) AS supplier_id,
  CASE WHEN s1 IS NOT NULL THEN 'nif_exact' WHEN coalesce(s2, s3) IS NOT NULL THEN 'alias' WHEN score >= 0.95 THEN 'fuzzy'
    WHEN score IS NOT NULL THEN 'fuzzy_review' ELSE 'new_supplier' END AS method,
  CASE WHEN s1 IS NOT NULL THEN 1.0::DOUBLE WHEN s2 IS NOT NULL THEN 0.98::DOUBLE WHEN s3 IS NOT NULL THEN 0.95::DOUBLE ELSE coalesce(score, 0) END AS confidence
  FROM (SELECT l3.*, CASE WHEN coalesce(s1, s2, s3) IS NULL THEN b.s4 END AS s4, CASE WHEN coalesce(s1, s2, s3) IS NULL THEN b.score END AS score
    FROM l3 LEFT JOIN best b USING (a)))"""


@query("jn_14_resolution", f"WITH {RESOLVED} SELECT *, method IN ('fuzzy_review', 'new_supplier') AS needs_review FROM resolved",
       "requests suppliers aliases")
def _(t):
    return R.resolve(t.requests, t.suppliers, t.aliases)


@query("set_3_name_aliases", f"""
SELECT {norm('alias_text')} AS name, min_by(supplier_id, (alias_type <> 'name_exact', supplier_id)) AS supplier_id FROM aliases
WHERE alias_type IN ('name_exact', 'manual') GROUP BY 1""", "aliases")
def _(t):
    kind = F.when(F.col("alias_type") == "name_exact", 0).otherwise(1)
    return (t.aliases.where(F.col("alias_type").isin("name_exact", "manual")).groupBy(match_name(F.col("alias_text")).alias("name"))
            .agg(F.min_by("supplier_id", F.struct(kind, "supplier_id")).alias("supplier_id")))


@query("jn_17_new_suppliers", f"""
WITH {RESOLVED}, fresh AS (SELECT input_nif, coalesce(input_name, '{R.UNKNOWN_NAME}') AS name FROM resolved WHERE method = 'new_supplier')
SELECT coalesce(input_nif, 'UNKNOWN-' || upper(sha256(name))) AS nif, min(name) AS name, {norm('min(name)')} AS normalized_name
FROM fresh GROUP BY 1""", "requests suppliers aliases")
def _(t):
    return R.new_suppliers(R.resolve(t.requests, t.suppliers, t.aliases))


TOKENS = "[x for x in list_distinct(string_split({}, ' ')) if length(x) > 2]"


def by_name(names: str) -> str:
    """CTEs ending in ``named(raw_name, tax_id)`` over ``names(raw_name)``."""
    return f"""
home AS (SELECT id, nif, {look('coalesce(commercial_name, legal_name, nif)')} AS b FROM suppliers WHERE country = 'PT'),
asked AS (SELECT DISTINCT raw_name, {look('raw_name')} AS a FROM {names} WHERE trim(raw_name) <> ''),
scored AS (SELECT raw_name, id, nif, levenshtein(a, b) <= CASE WHEN length(a) <= 40 THEN 5 ELSE 8 END AS near,
  CASE WHEN least(len(ta), len(tb)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(ta, tb)) / least(len(ta), len(tb))::DOUBLE END AS overlap
  FROM (SELECT *, {TOKENS.format('a')} AS ta, {TOKENS.format('b')} AS tb FROM asked, home)),
winner AS (SELECT raw_name, arg_min(nif, (-overlap, id)) AS nif FROM scored WHERE near OR overlap >= 0.5 GROUP BY 1),
named AS (SELECT k.raw_name, CASE WHEN {checksum('w.nif')} THEN w.nif END AS tax_id FROM asked k LEFT JOIN winner w USING (raw_name))"""


@query("jn_16_tax_id_by_name", f"WITH {by_name('(SELECT input_name AS raw_name FROM requests)')} SELECT * FROM named", "requests suppliers")
def _(t):
    return R.tax_id_by_name(t.requests.select(F.col("input_name").alias("raw_name")), t.suppliers)


@query("enr_1_issuer", f"""
WITH {by_name('(SELECT issuer_name AS raw_name FROM invoices)')}
SELECT i.id, CASE WHEN i.issuer_nif IS NULL THEN CASE WHEN n.tax_id IS DISTINCT FROM i.receiver_nif THEN n.tax_id END
  WHEN NOT {checksum('i.issuer_nif')} THEN n.tax_id WHEN i.issuer_nif = i.receiver_nif THEN NULL ELSE i.issuer_nif END AS issuer_nif
FROM invoices i LEFT JOIN named n ON n.raw_name = i.issuer_name""", "invoices suppliers")
def _(t):
    return R.enrich_issuer(t.invoices, t.suppliers)


@query("jn_11_receiver_name", """
SELECT i.id, coalesce(c.legal_name, i.receiver_name) AS receiver_name FROM invoices i LEFT JOIN clients c ON c.nif = i.receiver_nif""",
       "invoices clients")
def _(t):
    return R.enrich_receiver(t.invoices, t.clients).select("id", "receiver_name")


@query("jn_10_client_mapping", """
SELECT i.id, c.id AS client_id FROM (SELECT id, CASE WHEN client_id % 5 = 0 THEN NULL ELSE 'folder-' || client_id END AS ref FROM invoices) i
LEFT JOIN clients c ON c.drive_folder_id = i.ref""", "invoices clients")
def _(t):
    sources = t.invoices.select("id", F.lit("drive").alias("source_type"), F.expr(
        "CASE WHEN client_id % 5 = 0 THEN NULL ELSE 'folder-' || CAST(client_id AS STRING) END").alias("source_ref"))
    mapping = t.clients.where("drive_folder_id IS NOT NULL").select(
        F.lit("drive").alias("source_type"), F.col("drive_folder_id").alias("source_ref"), F.col("id").alias("client_id"))
    return R.client_of_source(sources, mapping).select("id", "client_id")


def corrections(t):
    """The last decision on each invoice, as a correction."""
    last = t.approvals.groupBy("invoice_id").agg(F.max_by("decided_by", "id").alias("reviewer_id"))
    return last.select("invoice_id", F.expr("invoice_id % 13").alias("supplier_id"), "reviewer_id")


COR = "(SELECT i.*, a.invoice_id IS NOT NULL AS hit, i.id % 13 AS chosen, a.decided_by FROM invoices i LEFT JOIN (SELECT invoice_id, max_by(decided_by, id) AS decided_by FROM approvals GROUP BY 1) a ON a.invoice_id = i.id)"


@query("cor_1_corrected_invoices", f"""
SELECT id, CASE WHEN hit THEN chosen ELSE supplier_id END AS supplier_id, CASE WHEN hit THEN 'ok' ELSE processing_status END AS processing_status FROM {COR}""",
       "invoices approvals")
def _(t):
    return R.apply_corrections(corrections(t), t.invoices)["invoices"].select("id", "supplier_id", "processing_status")


@query("cor_1_learned_aliases", f"""
SELECT chosen AS supplier_id, coalesce(issuer_nif, issuer_name) AS alias_text, 'manual' AS alias_type, 1.0::DOUBLE AS confidence, decided_by AS created_by
FROM {COR} WHERE hit AND coalesce(issuer_nif, issuer_name) IS NOT NULL""", "invoices approvals")
def _(t):
    return R.apply_corrections(corrections(t), t.invoices)["aliases"]


# --- ledger ----------------------------------------------------------------------

def profiles(t):
    return (t.raw("lineitem").groupBy(F.col("l_suppkey").alias("supplier_id"), (F.col("l_partkey") % 23).alias("gl_account_id"))
            .agg(F.count("*").alias("match_count"), F.max(F.col("l_shipdate").cast("timestamp")).alias("last_seen_at"))
            .withColumn("category_id", F.expr("CASE WHEN gl_account_id % 2 = 0 THEN CAST(gl_account_id % 10 AS INT) END")))


def accounts(t):
    return t.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.expr("CAST(61 + n_nationkey AS STRING)").alias("code"))


PROFILES = """
prof AS (SELECT l_suppkey AS supplier_id, l_partkey % 23 AS gl_account_id, count(*) AS match_count, max(l_shipdate) AS last_seen_at FROM lineitem
  GROUP BY 1, 2),
top AS (SELECT supplier_id, arg_min(gl_account_id, (-match_count, gl_account_id)) AS gl FROM prof GROUP BY 1)"""


@query("lim_2_best_profile", f"WITH {PROFILES} SELECT supplier_id, gl AS gl_account_id FROM top")
def _(t):
    return L.best_profiles(profiles(t)).select("supplier_id", "gl_account_id")


@query("jn_18_classification", f"""
WITH {PROFILES}
SELECT i.id AS invoice_id, CASE WHEN gl IS NULL THEN '62' ELSE (61 + gl)::VARCHAR END AS gl_account_code, coalesce(gl, 1) AS gl_account_id,
  c.slug AS category_slug, c.id AS category_id, CASE WHEN gl IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, 'auto' AS classified_by
FROM invoices i LEFT JOIN top ON top.supplier_id = i.supplier_id LEFT JOIN categories c ON gl % 2 = 0 AND c.id = gl % 10""", "invoices categories")
def _(t):
    return L.classify(t.invoices, profiles(t), accounts(t), t.categories)


def classified(t):
    return t.invoices.where("supplier_id IS NOT NULL").select(
        "id", "supplier_id", F.expr("id % 5").alias("gl_account_id"), F.col("created_at").alias("classified_at"))


@query("ag_32_learned_profiles", f"""
WITH {PROFILES},
seen AS (SELECT supplier_id, id % 5 AS gl_account_id, count(*) AS n, max(created_at) AS at FROM invoices WHERE supplier_id IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(p.supplier_id, s.supplier_id) AS supplier_id, coalesce(p.gl_account_id, s.gl_account_id) AS gl_account_id,
  coalesce(p.match_count, 0) + coalesce(s.n, 0) AS match_count, {stamp('greatest(p.last_seen_at, s.at)')} AS last_seen_at
FROM prof p FULL JOIN seen s ON s.supplier_id = p.supplier_id AND s.gl_account_id = p.gl_account_id""", "invoices")
def _(t):
    return L.merge_profiles(profiles(t), L.learned_profiles(classified(t))).drop("category_id")


@query("wn_5_running_profile_count", """
SELECT id, row_number() OVER (PARTITION BY supplier_id, id % 5 ORDER BY created_at, id) AS uses FROM invoices WHERE supplier_id IS NOT NULL""", "invoices")
def _(t):
    return L.running_profile_count(classified(t)).select("id", "uses")


@query("jn_19_unmapped_items", "SELECT invoice_id, line_number, description, count(*) OVER (PARTITION BY description) AS occurrence_count FROM items "
       "WHERE product_catalog_id IS NULL", "items")
def _(t):
    return L.unmapped_items(t.items).select("invoice_id", "line_number", "description", "occurrence_count")
