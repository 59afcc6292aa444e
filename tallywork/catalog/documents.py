from pyspark.sql import functions as F

from ..operators import sections as S
from ..sources import collect as C, datasets as G, landing as A
from .base import num, query


@query("src_1_landing_paths", """
SELECT id, client_id::VARCHAR AS client_id, year(created_at)::VARCHAR AS year, lpad(month(created_at)::VARCHAR, 2, '0') AS month, file_name FROM invoices""", "invoices")
def _(t):
    paths = t.invoices.select("id", "storage_path").where(A.is_pdf_name(F.col("storage_path")))
    return A.with_path_parts(paths, "storage_path").select("id", "client_id", "year", "month", "file_name")


MANIFEST = """(SELECT l_orderkey * 10 + l_linenumber AS k, 'folder-' || (l_orderkey % 600) AS folder_ref, 'file-' || l_orderkey || '-' || l_linenumber AS id,
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 'scan ' || l_partkey END AS name,
  CASE l_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/plain' END AS mime_type
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))"""


def manifest(t):
    lines = t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return lines.selectExpr(
        "'folder-' || CAST(l_orderkey % 600 AS STRING) AS folder_ref",
        "'file-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id",
        "CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 'scan ' || CAST(l_partkey AS STRING) END AS name",
        "CASE l_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/plain' END AS mime_type")


PARTS = """(SELECT user_id AS message_id, event_id AS ordinal, CASE event_type WHEN 'click' THEN 'application/pdf' WHEN 'view' THEN 'application/pdf' ELSE 'text/html' END AS mime_type,
  CASE WHEN event_type = 'view' THEN '' ELSE 'att' || event_id || '.pdf' END AS file_name, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a' || event_id END AS attachment_id FROM events)"""


def parts(t):
    return t.raw("events").selectExpr(
        "user_id AS message_id", "event_id AS ordinal",
        "CASE event_type WHEN 'click' THEN 'application/pdf' WHEN 'view' THEN 'application/pdf' ELSE 'text/html' END AS mime_type",
        "CASE WHEN event_type = 'view' THEN '' ELSE 'att' || CAST(event_id AS STRING) || '.pdf' END AS file_name",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a' || CAST(event_id AS STRING) END AS attachment_id")


LISTED = f"(SELECT * FROM {MANIFEST} WHERE mime_type IN ('application/pdf', 'image/jpeg', 'image/png') AND name IS NOT NULL)"
MESSAGES = f"""(SELECT message_id, arg_min(attachment_id, ordinal) AS attachment_id, arg_min(file_name, ordinal) AS file_name FROM {PARTS}
  WHERE mime_type = 'application/pdf' AND file_name <> '' AND attachment_id <> '' GROUP BY 1)"""


@query("src_3_active_clients", "SELECT id, legal_name, drive_folder_id FROM clients WHERE status = 'active' AND drive_folder_id IS NOT NULL", "clients")
def _(t):
    return C.active_clients(t.clients)


@query("src_4_listed_files", f"SELECT folder_ref, id, name, mime_type FROM {LISTED}")
def _(t):
    return C.listed_files(manifest(t))


@query("src_5_first_pdf_attachment", f"SELECT * FROM {MESSAGES}")
def _(t):
    return C.first_pdf_attachments(parts(t))


@query("src_6_normalized_sources", f"""
SELECT 'drive' AS source_type, id AS source_ref, name AS file_name, mime_type AS detail FROM {LISTED}
UNION ALL SELECT 'gmail', 'm' || message_id, file_name, attachment_id FROM {MESSAGES}""")
def _(t):
    mail = C.first_pdf_attachments(parts(t)).withColumn("message_id", F.concat(F.lit("m"), F.col("message_id").cast("string")))
    return C.normalized_sources(C.listed_files(manifest(t)), mail).select(
        "source_type", "source_ref", "file_name", F.element_at(F.map_values("metadata"), 1).alias("detail"))


def collect_sql(cap=None, preview=False):
    rank = f"QUALIFY row_number() OVER (PARTITION BY folder_ref ORDER BY id) <= {cap}" if cap else ""
    mail = f"ORDER BY ref LIMIT {cap}" if cap else ""
    sql = f"""SELECT 'drive' AS source_type, f.id AS source_ref, f.name AS file_name, c.id AS client_id FROM (SELECT * FROM {LISTED} {rank}) f
JOIN clients c ON c.drive_folder_id = f.folder_ref AND c.status = 'active'"""
    if preview:
        sql += f" UNION ALL SELECT 'gmail', ref, file_name, NULL FROM (SELECT 'm' || message_id AS ref, file_name FROM {MESSAGES} {mail})"
    return sql


def collected(t, **options):
    mail = C.first_pdf_attachments(parts(t)).withColumn("message_id", F.concat(F.lit("m"), F.col("message_id").cast("string")))
    return C.collected(t.clients, manifest(t), mail, **options).select("source_type", "source_ref", "file_name", "client_id")


@query("src_2_collected", collect_sql(), "clients")
def _(t):
    return collected(t)


@query("src_2_collected_preview", collect_sql(preview=True), "clients")
def _(t):
    return collected(t, preview=True)


@query("wn_1_cap_per_folder", collect_sql(3, True), "clients")
def _(t):
    return collected(t, cap=3, preview=True)


@query("src_2_collected_allowlist", f"SELECT x.* FROM ({collect_sql()}) x WHERE source_ref IN (SELECT 'file-' || l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag = 'R')", "clients")
def _(t):
    allow = t.raw("lineitem").where("l_returnflag = 'R'").selectExpr(
        "'file-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS source_ref")
    return collected(t, allowlist=allow)


@query("set_2_source_union", f"SELECT source_type, count(*) AS n FROM ({collect_sql(preview=True)}) GROUP BY 1", "clients")
def _(t):
    return collected(t, preview=True).groupBy("source_type").agg(F.count("*").alias("n"))


KEYS = ["'docs/' || {id} || '.PDF'", "'docs/' || {id} || '.jpg'", "'docs/' || {id} || '.xml'", "'docs/' || {id}", "'docs/' || {id} || '.docx'", "'docs/' || {id} || '.png'"]


def keyed(text):
    return "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {k.format(id=text)}" for i, k in enumerate(KEYS)) + " END"


GIVEN = "CASE doc_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/plain' END"


def documents(t):
    return t.raw("documents").selectExpr("doc_id", f"{keyed('CAST(doc_id AS STRING)')} AS storage_key", f"{GIVEN} AS mime_type", "text")


DOCS = f"(SELECT doc_id, text, doc_id % 6 AS e, {keyed('doc_id::VARCHAR')} AS storage_key, {GIVEN} AS mime_type FROM documents)"


@query("src_7_document_format", f"""
SELECT doc_id, CASE WHEN err IS NULL THEN f END AS doc_format, CASE WHEN err IS NULL THEN coalesce(mime_type, m) END AS doc_mime, err AS format_error FROM (
  SELECT *, CASE WHEN e = 3 THEN 'no file extension' WHEN f IS NULL THEN 'unsupported extension' WHEN mime_type = 'text/plain' THEN 'unsupported MIME type'
    WHEN mime_type IS NOT NULL AND f <> CASE mime_type WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'image' ELSE 'xml' END THEN 'MIME type and extension disagree' END AS err
  FROM (SELECT *, CASE e WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'xml' WHEN 5 THEN 'image' END AS f,
    CASE e WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/xml' WHEN 5 THEN 'image/png' END AS m FROM {DOCS}))""")
def _(t):
    return A.with_format(documents(t)).select("doc_id", "doc_format", "doc_mime", "format_error")


@query("src_8_pdf_checks", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN mime_type <> 'application/pdf' THEN 'invalid_mime' END
  WHEN left(text, 4) = '%PDF' THEN CASE WHEN mime_type <> 'application/pdf' THEN 'invalid_mime' END ELSE 'invalid_magic_bytes' END AS error FROM {DOCS}""")
def _(t):
    content = F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")), "UTF-8")
    return documents(t).select("doc_id", A.pdf_error(content, F.col("mime_type")).alias("error"))


@query("src_9_content_hash", "SELECT doc_id, sha256(text) AS document_hash FROM documents UNION ALL SELECT 1000000000 + page_id, sha256(html) FROM pages")
def _(t):
    d = t.raw("documents").select("doc_id", A.content_hash(F.encode("text", "UTF-8")).alias("document_hash"))
    return d.unionByName(t.raw("pages").select((F.col("page_id") + 1_000_000_000).alias("doc_id"), A.content_hash(F.encode("html", "UTF-8")).alias("document_hash")))


@query("src_10_xml_text", """
SELECT storage_key, CASE WHEN broken THEN '' ELSE body END AS text, CASE WHEN broken THEN 0 ELSE length(body) END AS char_count, broken AS failed FROM (
  SELECT o_orderkey AS storage_key, o_orderkey % 9 = 0 AS broken,
    'Number: FT/' || o_orderkey || chr(10) || 'Party: ' || o_custkey || chr(10) || 'Note: ' || o_orderpriority AS body FROM orders)""")
def _(t):
    xml = ("'<?xml version=\"1.0\"?><i:Invoice xmlns:i=\"urn:example:invoice\"><i:Number> FT/' || CAST(o_orderkey AS STRING) || "
           "'</i:Number><i:Parties><Party>' || CAST(o_custkey AS STRING) || '</Party><Empty> </Empty></i:Parties><Note>' || o_orderpriority || "
           "'</Note>' || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '</i:Invoice>' END")
    docs = t.raw("orders").select(F.col("o_orderkey").alias("storage_key"), F.encode(F.expr(xml), "UTF-8").alias("content"))
    return A.xml_text(docs).select("storage_key", "text", "char_count", F.col("error").isNotNull().alias("failed"))


def answers(text):
    body = f"'{{\"id\": ' || {text} || ', \"ok\": true}}'"
    return (f"CASE o_orderkey % 5 WHEN 0 THEN ' ' || {body} || ' ' WHEN 1 THEN 'Here it is: ```json ' || {body} || ' ``` done' "
            f"WHEN 2 THEN 'The answer is ' || {body} || ', as asked.' WHEN 3 THEN 'no object here' ELSE '{{\"id\": ' || {text} || ', oops}}' END")


@query("src_11_recovered_json", """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'fenced' WHEN 2 THEN 'flat' END AS found_in,
  CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey END AS value FROM orders""")
def _(t):
    r = A.recovered_json(F.expr(answers("CAST(o_orderkey AS STRING)")))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), r["found_in"].alias("found_in"),
                                  F.get_json_object(r["body"], "$.id").cast("long").alias("value"))


@query("src_12_labelled_cases", """
SELECT 'invoice-' || id AS case_id, invoice_number, total_with_vat::VARCHAR AS total, id % 13 = 0 AS math_error FROM invoices""", "invoices")
def _(t):
    import uuid

    from ..session import shared_dir
    path = f"{shared_dir(t.spark)}/cases-{uuid.uuid4().hex}"
    text = lambda c: F.col(c).cast("string")
    cases = t.invoices.select(
        F.concat(F.lit("invoice-"), text("id")).alias("case_id"),
        F.struct(F.lit("derived").alias("description"), (F.col("id") % 13 == 0).alias("math_error")).alias("meta"),
        F.struct(text("id").alias("invoice_id"), F.coalesce("raw_ocr_text", F.lit("")).alias("raw_text")).alias("input"),
        F.struct("invoice_number", text("total_with_vat").alias("total"), "currency").alias("expected"))
    cases.write.json(path)
    return G.labelled_cases(t.spark, path, lines=True).select(
        "case_id", "expected.invoice_number", "expected.total", "meta.math_error")


EXTERNAL = """(SELECT o_orderkey AS document_id, CASE o_orderkey % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'credit_note' WHEN 3 THEN 'debit_note' WHEN 4 THEN 'other' END AS document_type,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS total, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE round(o_totalprice * 0.8, 2) END AS net_total,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.5 END AS tax_total, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'USD' END AS currency FROM orders)"""


@query("src_13_external_invoices", f"""
SELECT 'DOCILE-' || document_id AS invoice_number, {num('total')} AS total_with_vat, {num('net_total')} AS total_without_vat,
  {num('coalesce(CAST(tax_total AS DECIMAL(14,2)), CAST(total AS DECIMAL(14,2)) - CAST(net_total AS DECIMAL(14,2)))')} AS vat_total, coalesce(currency, 'EUR') AS currency,
  CASE document_type WHEN 'receipt' THEN 'fatura_recibo' WHEN 'credit_note' THEN 'nota_credito' WHEN 'debit_note' THEN 'nota_debito' ELSE 'fatura' END AS document_type
FROM {EXTERNAL} WHERE total IS NOT NULL AND net_total IS NOT NULL""")
def _(t):
    items = t.raw("orders").selectExpr(
        "o_orderkey AS document_id", "CASE o_orderkey % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'credit_note' WHEN 3 THEN 'debit_note' WHEN 4 THEN 'other' END AS document_type",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS total", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE round(o_totalprice * 0.8D, 2) END AS net_total",
        "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1.5D END AS tax_total", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'USD' END AS currency",
        "CAST(NULL AS STRING) AS vendor_name", "CAST(NULL AS STRING) AS customer_name", "CAST(NULL AS STRING) AS document_date")
    return G.external_invoices(items).select("invoice_number", "total_with_vat", "total_without_vat", "vat_total", "currency", "document_type")


@query("src_15_decoded_attachment", "SELECT page_id, sha256(html) AS digest FROM pages")
def _(t):
    data = F.translate(F.rtrim(F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"[\r\n]", "")), "+/=", "-_")
    return t.raw("pages").select("page_id", F.sha2(A.decode_attachment(data), 256).alias("digest"))


# --- sections -----------------------------------------------------------------------

def headers(t):
    return t.invoices.select(F.col("id").alias("document_id"), F.col("issuer_name").alias("supplier_name"), F.col("issuer_nif").alias("supplier_nif"),
                             "receiver_nif", "invoice_number", F.lit(None).cast("string").alias("invoice_series"), F.col("issue_date").cast("string").alias("invoice_date"),
                             F.expr("CASE WHEN id % 5 = 0 THEN array('header: failed') ELSE CAST(array() AS array<string>) END").alias("errors"))


def totals(t):
    return t.invoices.select(F.col("id").alias("document_id"), F.col("total_without_vat").cast("string").alias("subtotal"), F.col("vat_total").cast("string").alias("vat_amount"),
                             F.col("total_with_vat").cast("string").alias("total"), "currency", F.expr("CASE id % 4 WHEN 0 THEN 23 WHEN 1 THEN 6 WHEN 2 THEN 19 END").alias("vat_rate"),
                             F.expr("CASE WHEN id % 7 = 0 THEN array('totals: failed') ELSE CAST(array() AS array<string>) END").alias("errors"))


def lines(t):
    line = ("named_struct('description', CASE WHEN id % 6 = 0 THEN NULL ELSE 'work' END, 'quantity', CAST(id % 9 AS STRING), 'unit_price', CASE WHEN id % 4 = 0 THEN NULL ELSE '2.50' END, 'subtotal', {s})")
    arr = ("array(" + line.format(s="CAST(total_with_vat - 1 AS STRING)") + ", " + line.format(s="CASE WHEN id % 3 = 0 THEN '1.00' ELSE '2.00' END")
           + ", CASE WHEN id % 2 = 0 THEN NULL ELSE " + line.format(s="CAST(NULL AS STRING)") + " END)")
    return t.invoices.select(F.col("id").alias("document_id"), F.expr(arr).alias("line_items"),
                             F.expr("CASE WHEN id % 2 = 0 THEN array('lines: failed') ELSE CAST(array() AS array<string>) END").alias("errors"))


def _valid():
    from .text import checksum
    return checksum


OKNIF, OKREC = _valid()("issuer_nif"), _valid()("receiver_nif")


@query("val_5_header_guards", f"""
SELECT id AS document_id, CASE WHEN {OKNIF} THEN issuer_nif END AS supplier_nif, CASE WHEN {OKREC} THEN receiver_nif END AS receiver_nif,
  (CASE WHEN {OKNIF} THEN 0 ELSE 1 END) + (CASE WHEN {OKREC} THEN 0 ELSE 1 END) AS warnings FROM invoices""", "invoices")
def _(t):
    return S.header_guards(headers(t)).select("document_id", "supplier_nif", "receiver_nif", F.size("warnings").alias("warnings"))


@query("val_5_totals_guards", """
SELECT id AS document_id, CASE id % 4 WHEN 0 THEN 23 WHEN 1 THEN 6 END AS vat_rate, coalesce(currency, 'EUR') AS currency, (id % 4 = 2)::INT AS warnings FROM invoices""", "invoices")
def _(t):
    return S.totals_guards(totals(t)).select("document_id", "vat_rate", "currency", F.size("warnings").alias("warnings"))


@query("val_4_line_checks", """
SELECT id AS document_id, CASE WHEN id % 2 = 0 THEN 2 ELSE 3 END AS lines,
  (CASE WHEN id % 6 = 0 THEN 2 ELSE 0 END) + (CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END) + (CASE WHEN total_with_vat IS NULL THEN 1 ELSE 0 END) + 1 AS warnings FROM invoices""", "invoices")
def _(t):
    return S.line_checks(lines(t)).select("document_id", F.size("line_items").alias("lines"), F.size("warnings").alias("warnings"))


@query("val_4_line_amounts", """
SELECT id AS document_id, CASE WHEN id % 2 = 0 THEN '1.50|' || (id % 9)::VARCHAR ELSE '1.50' END AS amounts,
  CASE WHEN id % 2 = 0 THEN 'line 1 missing quantity|line 2 missing description|line 2 missing unit_price' ELSE 'line 1 missing quantity|line 2 not an object' END AS warnings FROM invoices""", "invoices")
def _(t):
    kind = "CAST(1.5 AS DECIMAL(6,2))"
    arr = (f"array(named_struct('description', 'work', 'quantity', CAST(NULL AS INT), 'unit_price', {kind}, 'subtotal', {kind}), CASE WHEN id % 2 = 0 THEN "
           f"named_struct('description', CAST(NULL AS STRING), 'quantity', 1, 'unit_price', CAST(NULL AS DECIMAL(6,2)), 'subtotal', CAST(id % 9 AS DECIMAL(6,2))) END)")
    checked = S.line_checks(t.invoices.select(F.col("id").alias("document_id"), F.expr(arr).alias("line_items")))
    return checked.select("document_id", F.array_join(F.transform("line_items", lambda x: F.regexp_replace(x["subtotal"], "[.]00$", "")), "|").alias("amounts"), F.array_join("warnings", "|").alias("warnings"))


def merged(t):
    return S.reconcile(S.header_guards(headers(t)), S.line_checks(lines(t)), S.totals_guards(totals(t)))


@query("val_3_reconciled", f"""
SELECT id AS document_id, CASE WHEN NOT dead AND {OKNIF} THEN issuer_nif END AS supplier_nif, CASE WHEN NOT dead THEN {num('total_with_vat')} END AS total,
  CASE WHEN NOT dead THEN coalesce(currency, 'EUR') END AS currency, CASE WHEN NOT dead THEN CASE id % 4 WHEN 0 THEN 23 WHEN 1 THEN 6 END END AS vat_rate,
  {num('coalesce(total_with_vat - 1, 0) + CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END')} AS line_sum,
  CASE WHEN NOT dead AND id % 3 <> 0 AND total_with_vat IS NOT NULL THEN 1 ELSE 0 END AS warnings, (id % 5 = 0)::INT + (id % 7 = 0)::INT + (id % 2 = 0)::INT AS errors
FROM (SELECT *, id % 70 = 0 AS dead FROM invoices)""", "invoices")
def _(t):
    return merged(t).select("document_id", "supplier_nif", "total", "currency", "vat_rate", "line_sum",
                            F.size("warnings").alias("warnings"), F.size("errors").alias("errors"))


@query("ag_37_section_counters", f"""
SELECT id AS document_id, 'header' AS agent, (issuer_name IS NOT NULL)::INT + (invoice_number IS NOT NULL)::INT + (issue_date IS NOT NULL)::INT + ({OKNIF})::INT + ({OKREC})::INT AS fields_extracted,
  2 - ({OKNIF})::INT - ({OKREC})::INT AS warnings_count, (id % 5 = 0)::INT AS errors_count FROM invoices
UNION ALL SELECT id, 'totals', 3 * (total_with_vat IS NOT NULL)::INT + 1 + (id % 4 < 2)::INT, (id % 4 = 2)::INT, (id % 7 = 0)::INT FROM invoices""", "invoices")
def _(t):
    h = S.section_counters(S.header_guards(headers(t)), "header", ["supplier_name", "invoice_number", "invoice_series", "invoice_date", "supplier_nif", "receiver_nif"])
    return h.unionByName(S.section_counters(S.totals_guards(totals(t)), "totals", ["subtotal", "vat_amount", "total", "currency", "vat_rate"]))


@query("ag_38_assembled_pages", """
SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS page_count, sum(length(text)) + count(*) - 1 AS char_count
FROM conversations GROUP BY 1""")
def _(t):
    return S.assembled_pages(t.raw("conversations"), "conv_id", "turn", "text").select(
        "conv_id", F.md5("raw_text").alias("digest"), "page_count", "char_count")


@query("set_4_appended_errors", """
SELECT id AS document_id, (id % 5 = 0)::INT + (id % 7 = 0)::INT AS n FROM invoices""", "invoices")
def _(t):
    both = headers(t).select("document_id", "errors").join(totals(t).select("document_id", F.col("errors").alias("more")), "document_id")
    return S.with_appended(both, "errors", "more").select("document_id", F.size("errors").alias("n"))
