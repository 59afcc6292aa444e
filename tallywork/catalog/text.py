from pyspark.sql import functions as F

from ..functions import confidence, masking, names, similarity, taxid, text, units
from .base import num, query


def norm(x):
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def look(x):
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[,.\-&]', ' ', 'g'), '\s+', ' ', 'g'))"


def wide(x):
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("str_1_match_name", f"SELECT document_id, {norm('input_name')} AS name FROM requests", "requests")
def _(t):
    return t.requests.select("document_id", names.match_name(F.col("input_name")).alias("name"))


@query("str_1_match_name_of_texts", f"SELECT doc_id, md5({norm('text')}) AS name FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(names.match_name(F.col("text"))).alias("name"))


@query("str_2_lookup_name", f"SELECT document_id, {look('input_name')} AS name FROM requests", "requests")
def _(t):
    return t.requests.select("document_id", names.lookup_name(F.col("input_name")).alias("name"))


@query("str_3_compare_name", f"SELECT conv_id, turn, {wide('text')} AS name FROM conversations")
def _(t):
    return t.raw("conversations").select("conv_id", "turn", names.compare_name(F.col("text")).alias("name"))




def pairs(t):
    """Requested name next to the name of the supplier it was made from."""
    s = t.suppliers.select("id", F.col("normalized_name").alias("b"))
    r = t.requests.where("input_name IS NOT NULL").select(
        "document_id", F.expr("document_id div 8").alias("id"), names.match_name(F.col("input_name")).alias("a"))
    return r.join(s, "id")


PAIR_SQL = f"""(SELECT r.document_id, {norm('r.input_name')} AS a, s.normalized_name AS b FROM requests r
  JOIN suppliers s ON s.id = r.document_id // 8 WHERE r.input_name IS NOT NULL)"""
PREFIX = " + ".join(f"(CASE WHEN left(a, {k}) = left(b, {k}) AND least(length(a), length(b)) >= {k} THEN 1 ELSE 0 END)"
                   for k in range(1, 5))


def jw_ctes(source: str) -> str:
    """CTEs ``jw_step`` and ``jw(a, b, score)`` over the distinct pairs of ``source``: one step per character of a."""
    return f"""
jw_step AS (
  SELECT a, b, 1 AS i, b AS mask, '' AS seen FROM (SELECT DISTINCT a, b FROM {source})
  UNION ALL
  SELECT a, b, i + 1, CASE WHEN pos > 0 THEN left(mask, lo + pos - 2) || chr(1) || substr(mask, lo + pos) ELSE mask END,
    CASE WHEN pos > 0 THEN seen || ch ELSE seen END
  FROM (SELECT *, instr(substr(mask, lo, greatest(0, hi - lo + 1)), ch) AS pos
    FROM (SELECT *, substr(a, i, 1) AS ch, greatest(1, i - w) AS lo, least(length(b), i + w) AS hi
      FROM (SELECT *, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS w FROM jw_step WHERE i <= length(a))))),
jw_end AS (
  SELECT a, b, seen, length(seen) AS m, array_to_string([substr(b, k, 1) for k in range(1, length(b) + 1)
    if substr(mask, k, 1) = chr(1)], '') AS other FROM jw_step WHERE i = length(a) + 1),
jw_base AS (
  SELECT a, b, CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0::DOUBLE WHEN m = 0 THEN 0.0::DOUBLE ELSE
    (m::DOUBLE / length(a) + m::DOUBLE / length(b) + (m - len([k for k in range(1, m + 1)
      if substr(seen, k, 1) <> substr(other, k, 1)]) / 2.0::DOUBLE) / m) / 3 END AS j FROM jw_end),
jw AS (SELECT a, b, round(j + ({PREFIX}) * 0.1::DOUBLE * (1 - j), 9) AS score FROM jw_base)"""


@query("str_5_jaro_winkler", f"""WITH pairs AS {PAIR_SQL}, {jw_ctes('pairs')}
SELECT p.document_id, jw.score FROM pairs p JOIN jw USING (a, b)""", "requests suppliers")
def _(t):
    return pairs(t).select("document_id", F.round(similarity.jaro_winkler("a", "b"), 9).alias("score"))


TOK = "[x for x in list_distinct(string_split({}, ' ')) if length(x) > 2]"


@query("str_6_token_overlap", f"""
SELECT document_id, CASE WHEN least(len(ta), len(tb)) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(ta, tb)) / least(len(ta), len(tb))::DOUBLE END AS overlap
FROM (SELECT document_id, {TOK.format('a')} AS ta, {TOK.format('b')} AS tb FROM {PAIR_SQL})""", "requests suppliers")
def _(t):
    return pairs(t).select("document_id", similarity.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


def lcs_ctes(source: str) -> str:
    """CTEs ``lcs_step`` and ``indel(a, b, ratio)`` over the distinct pairs of ``source``: a row of the common-subsequence table per character of a."""
    return f"""
lcs_step AS (
  SELECT a, b, 0 AS i, [0 for k in range(0, length(b) + 1)] AS row FROM (SELECT DISTINCT a, b FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL)
  UNION ALL
  SELECT a, b, i + 1, [greatest(row[j], coalesce(list_max([row[k - 1] + 1 for k in range(2, j + 1) if substr(b, k - 1, 1) = substr(a, i + 1, 1)]), 0))
    for j in range(1, length(b) + 2)] FROM lcs_step WHERE i < length(a)),
indel AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * row[length(b) + 1] / (length(a) + length(b)) END AS ratio
  FROM lcs_step WHERE i = length(a))"""


@query("str_7_indel_ratio", f"""WITH pairs AS {PAIR_SQL}, {lcs_ctes('pairs')}
SELECT p.document_id, round(ratio, 9) AS ratio FROM pairs p LEFT JOIN indel USING (a, b)""", "requests suppliers")
def _(t):
    return pairs(t).select("document_id", F.round(similarity.indel_ratio("a", "b"), 9).alias("ratio"))


UNIT_VALUES = ", ".join(f"('{s}', '{u}')" for u, words in units.SPELLINGS.items() for s in words)


@query("str_8_unit", f"""
SELECT i.unit_raw, u.unit, count(*) AS n FROM items i
LEFT JOIN (VALUES {UNIT_VALUES}) u(spelling, unit) ON u.spelling = lower(trim(i.unit_raw)) GROUP BY 1, 2""", "items")
def _(t):
    return (t.items.groupBy("unit_raw", units.normalize_unit(F.col("unit_raw")).alias("unit"))
            .agg(F.count("*").alias("n")))


RAW_IDS = "(SELECT id, CASE id % 4 WHEN 0 THEN 'PT ' || nif WHEN 1 THEN ' ' WHEN 2 THEN substr(nif, 1, 3) || '.' || substr(nif, 4, 3) || '-' || substr(nif, 7) ELSE 'DE' || nif END AS raw FROM clients)"


def raw_ids(t):
    return t.clients.select("id", F.expr("CASE id % 4 WHEN 0 THEN 'PT ' || nif WHEN 1 THEN ' ' WHEN 2 THEN "
                                         "substr(nif, 1, 3) || '.' || substr(nif, 4, 3) || '-' || substr(nif, 7) ELSE 'DE' || nif END").alias("raw"))


@query("str_9_tax_id", f"""
SELECT id, CASE WHEN bare = '' THEN NULL WHEN upper(substr(bare, 1, 2)) = 'PT' AND length(bare) = 11 THEN substr(bare, 3)
  ELSE bare END AS tax_id FROM (SELECT id, replace(replace(replace(raw, ' ', ''), '.', ''), '-', '') AS bare FROM {RAW_IDS})""", "clients")
def _(t):
    return raw_ids(t).select("id", taxid.normalize_tax_id(F.col("raw")).alias("tax_id"))


def checksum(x):
    s = " + ".join(f"CAST(substr({x}, {i + 1}, 1) AS INT) * {9 - i}" for i in range(8))
    return (f"coalesce(substr({x}, 1, 1) IN ('1','2','5','6','7','8','9') AND CAST(substr({x}, 9, 1) AS INT) = "
            f"CASE WHEN ({s}) % 11 < 2 THEN 0 ELSE 11 - ({s}) % 11 END, false)")


@query("str_10_tax_id_audit", f"""
SELECT country, count(*) AS suppliers, count(*) FILTER ({checksum('nif')}) AS valid FROM suppliers GROUP BY 1""", "suppliers")
def _(t):
    return t.suppliers.groupBy("country").agg(F.count("*").alias("suppliers"),
                                              F.count_if(taxid.valid_tax_id(F.col("nif"))).alias("valid"))


@query("str_11_masked_invoices", f"""
SELECT id, substr(issuer_nif, 1, 3) || '****' || substr(issuer_nif, 8) AS short_nif,
  coalesce(substr(issuer_nif, 1, 3) || '***' || substr(issuer_nif, 7), '***') AS long_nif,
  CASE WHEN total_with_vat IS NULL THEN '***' WHEN total_with_vat >= 10 THEN substr(total_with_vat::VARCHAR, 1, 1) || '***.' || right(total_with_vat::VARCHAR, 2) || '*'
    ELSE '***.' || right(total_with_vat::VARCHAR, 2) || '*' END AS amount FROM invoices""", "invoices")
def _(t):
    n = F.col("issuer_nif")
    return t.invoices.select("id", masking.mask_id(n).alias("short_nif"), masking.mask_id(n, "long").alias("long_nif"),
                             masking.mask_amount(F.col("total_with_vat"), "long").alias("amount"))


@query("str_12_text_columns", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug,
  CASE WHEN length(url) <= 20 THEN url ELSE left(url, 17) || '...' END AS short,
  CASE WHEN ms < 1000 THEN ms || 'ms' ELSE trim((CASE WHEN ms >= 3600000 THEN (ms // 3600000) || 'h ' ELSE '' END) ||
    (CASE WHEN ms // 60000 % 60 > 0 THEN (ms // 60000 % 60) || 'm ' ELSE '' END) ||
    (CASE WHEN ms // 1000 % 60 > 0 THEN (ms // 1000 % 60) || 's' ELSE '' END)) END AS took
FROM (SELECT page_id, url, page_id * 77777 AS ms FROM pages)""")
def _(t):
    return t.raw("pages").select("page_id", text.slugify(F.col("url")).alias("slug"), text.truncate(F.col("url"), 20).alias("short"),
                                 text.duration_text(F.col("page_id") * 77777).alias("took"))


@query("str_4_edit_distance", "SELECT id, levenshtein(issuer_name, receiver_name) AS edits FROM invoices", "invoices")
def _(t):
    return t.invoices.select("id", F.levenshtein("issuer_name", "receiver_name").cast("long").alias("edits"))


WEIGHT = "CASE WHEN field_key IN ('invoice_number','issue_date','issuer_name','issuer_nif','total_with_vat') THEN 2 ELSE 1 END"


@query("ag_36_weighted_confidence", f"""
SELECT i.id, coalesce(c.w, 0.5) AS confidence FROM invoices i LEFT JOIN (
  SELECT invoice_id, ((2 * sum(conf_c * {WEIGHT}) + 15) // 30) / 100.0::DOUBLE AS w FROM confidences GROUP BY 1) c ON c.invoice_id = i.id""",
       "invoices confidences")
def _(t):
    return t.invoices.select("id", confidence.overall(F.col("field_confidence")).cast("double").alias("confidence"))


@query("val_7_review_required", """
SELECT i.id, coalesce(c.low, false) AS review_required FROM invoices i LEFT JOIN (
  SELECT invoice_id, min(conf_c) < 70 AS low FROM confidences GROUP BY 1) c ON c.invoice_id = i.id""", "invoices confidences")
def _(t):
    return t.invoices.select("id", confidence.needs_review(F.col("field_confidence")).alias("review_required"))


@query("prj_6_confidence_band", """
SELECT CASE WHEN llm_confidence >= 0.85 THEN 'high' WHEN llm_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
FROM invoices GROUP BY 1""", "invoices")
def _(t):
    return t.invoices.groupBy(confidence.band(F.col("llm_confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("dt_1_date_buckets", f"""
SELECT i.id, strftime(date_trunc('day', i.created_at), '%Y-%m-%d') AS day, strftime(date_trunc('month', i.created_at), '%Y-%m-%d') AS month,
  {num("date_diff('second', i.created_at, a.decided_at)")} / 3600 AS hours
FROM invoices i JOIN approvals a ON a.invoice_id = i.id""", "invoices approvals")
def _(t):
    from ..operators.ratios import hours_between
    a = t.approvals.select(F.col("invoice_id").alias("id"), "decided_at")
    return t.invoices.select("id", "created_at").join(a, "id").select(
        "id", F.to_date("created_at").alias("day"), F.trunc("created_at", "MM").alias("month"),
        hours_between(F.col("decided_at"), F.col("created_at")).alias("hours"))
