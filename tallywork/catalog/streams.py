import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sinks.tables import read_version
from ..streaming import jobs as J
from .base import day, query, stamp


def thirds(source, order):
    """0, 1 or 2 by ``order``, about a third of the rows each."""
    low, high = source.agg(F.percentile_approx(order.cast("double"), [1 / 3, 2 / 3], 100)).first()[0] or (0, 0)
    return F.when(order.cast("double") <= low, 0).when(order.cast("double") <= high, 1).otherwise(2)


def arrive(t, source, part, job):
    """Run ``job`` on a folder that grows three times, by the rows with ``part`` 0, 1 and 2."""
    src = f"{shared_dir(t.spark)}/arrivals-{uuid.uuid4().hex}"
    for step in range(3):
        source.where(part == step).write.mode("append").parquet(src)
        job(t.spark.readStream.schema(source.schema).parquet(src))


def place(t, name):
    base = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


def headers(t):
    """Invoice header columns that need no aggregate, from the orders."""
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client_id"),
        F.expr("CASE WHEN o_orderkey % 17 = 0 THEN 'duplicado' WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'P' THEN 'requires_review' ELSE 'failed' END").alias("processing_status"),
        F.expr("timestampadd(SECOND, o_orderkey % 86400, CAST(o_orderdate AS TIMESTAMP))").alias("created_at"),
        F.expr("sha2('doc-' || CAST(o_orderkey - o_orderkey % 19 % 2 AS STRING), 256)").alias("document_hash"),
        F.concat(F.lit("5"), F.expr("lpad(CAST(o_custkey % 50 AS STRING), 8, '0')")).alias("issuer_nif"),
        F.expr("'FT ' || CAST(o_orderkey % 40 AS STRING)").alias("invoice_number"),
        F.to_date("o_orderdate").alias("issue_date"), F.expr("CAST(o_orderkey % 3 AS DECIMAL(14,2))").alias("total_with_vat"))


@query("st_1_ingested_documents", "SELECT 'docs/' || doc_id || '.xml' AS storage_key, 'xml' AS doc_format, sha256(text) AS document_hash FROM documents")
def _(t):
    out, check = place(t, "ingest")
    docs = t.raw("documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("storage_key"),
                                           F.lit(None).cast("string").alias("mime_type"), F.encode("text", "UTF-8").alias("content"))
    arrive(t, docs, thirds(docs, F.col("doc_id")), lambda s: J.ingest_documents(s.drop("doc_id"), out, check))
    return t.spark.read.parquet(out).select("storage_key", "doc_format", "document_hash")


@query("st_2_dispatched_once", f"""
WITH RECURSIVE e AS (SELECT user_id % 50 AS client_id, event_type AS batch_id, 'f' || event_id % 4 AS file_name, ts FROM events),
sent AS (SELECT client_id, batch_id, file_name, min(ts) AS ts FROM e GROUP BY 1, 2, 3
  UNION ALL SELECT e.client_id, e.batch_id, e.file_name, min(e.ts) FROM sent s JOIN e USING (client_id, batch_id, file_name)
  WHERE e.ts >= s.ts + INTERVAL 1 HOUR GROUP BY 1, 2, 3, s.ts)
SELECT client_id, batch_id, file_name, {stamp('ts')} AS ts FROM sent""")
def _(t):
    out, check = place(t, "dispatch")
    e = t.raw("events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("client_id"), F.col("event_type").alias("batch_id"),
                                     F.expr("'f' || CAST(event_id % 4 AS STRING)").alias("file_name"))
    arrive(t, e, thirds(e, F.col("ts")), lambda s: J.run_available(J.dispatched_once(s), check, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")))
    return t.spark.read.parquet(out).select("client_id", "batch_id", "file_name", "ts")


STREAM = """
WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'duplicado' END AS st, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
  o_orderkey - o_orderkey % 19 % 2 AS h, o_custkey % 50 AS n, o_orderkey % 40 AS num, o_orderdate AS d, o_orderkey % 3 AS total FROM orders),
k AS (SELECT n, num, d, total, min((created_at, id)) AS age, arg_min(id, (created_at, id)) AS first_id FROM f WHERE st IS NULL GROUP BY ALL),
g AS (SELECT h, arg_min(id, (created_at, id)) AS first_id FROM f GROUP BY 1)
SELECT f.id, coalesce(CASE WHEN g.first_id <> f.id THEN g.first_id END, CASE WHEN k.age < (f.created_at, f.id) THEN k.first_id END) AS duplicate_of
FROM f JOIN g USING (h) LEFT JOIN k USING (n, num, d, total)"""


@query("st_3_duplicates_on_arrival", STREAM)
def _(t):
    out, check = place(t, "arrivals")
    rows = headers(t)
    arrive(t, rows, thirds(rows, F.col("created_at")), lambda s: J.find_duplicates_as_they_arrive(s, out, check))
    return t.spark.read.parquet(f"{out}/found").select("id", "duplicate_of")


CREATED = "(o_orderdate + to_seconds(o_orderkey % 86400))"


@query("st_4_daily_throughput", f"SELECT {day(CREATED)} AS day, count(*) AS count FROM orders GROUP BY 1")
def _(t):
    out, check = place(t, "throughput")
    rows = headers(t).select("created_at")
    arrive(t, rows, thirds(rows, F.col("created_at")), lambda s: J.daily_throughput(s, out, check))
    return read_version(t.spark, out)


@query("st_5_rolling_quality", f"""
SELECT client_id, {stamp('(d + k * INTERVAL 1 DAY)::TIMESTAMP')} AS window_end, count(*) AS total, count(*) FILTER (st = 'ok') AS ok_count, count(*) FILTER (st = 'requires_review') AS review_count
FROM (SELECT o_custkey AS client_id, date_trunc('day', {CREATED}) AS d, unnest(range(1, 31)) AS k,
  CASE WHEN o_orderkey % 17 = 0 THEN 'duplicado' WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'P' THEN 'requires_review' END AS st FROM orders) GROUP BY 1, 2""")
def _(t):
    out, check = place(t, "rolling")
    rows = headers(t).select("client_id", "created_at", "processing_status")
    arrive(t, rows, thirds(rows, F.col("created_at")), lambda s: J.rolling_quality(s, out, check))
    return read_version(t.spark, out)


@query("st_6_supplier_profiles", f"""
SELECT o_custkey % 97 AS supplier_id, o_orderkey % 5 AS gl_account_id, count(*) AS match_count, {stamp(f'max({CREATED})')} AS last_seen_at FROM orders GROUP BY 1, 2""")
def _(t):
    out, check = place(t, "profiles")
    c = headers(t).select((F.col("client_id") % 97).alias("supplier_id"), (F.col("id") % 5).alias("gl_account_id"), F.col("created_at").alias("classified_at"))
    arrive(t, c, thirds(c, F.col("classified_at")), lambda s: J.supplier_profiles(s, out, check))
    return read_version(t.spark, out)


@query("st_7_audited_changes", f"""
WITH v AS (SELECT o_custkey AS id, o_orderstatus AS status, o_orderkey AS change, {CREATED} AS created_at, o_orderkey % 3 AS part FROM orders),
p AS (SELECT id, part, max_by(status, (created_at, change)) AS status, max_by(change, (created_at, change)) AS change FROM v GROUP BY 1, 2)
SELECT id AS row_id, CASE WHEN lag(id) OVER w IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS operation, status AS new_status, change AS new_change, lag(change) OVER w AS old_change
FROM p WINDOW w AS (PARTITION BY id ORDER BY part)""")
def _(t):
    out, check = place(t, "audit")
    v = t.raw("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("change"),
                               F.expr("timestampadd(SECOND, o_orderkey % 86400, CAST(o_orderdate AS TIMESTAMP))").alias("updated_at"))
    arrive(t, v, F.col("change") % 3, lambda s: J.audit_changes(s, out, f"{out}-log", check, order=F.struct("updated_at", "change")))
    data = lambda c, k: F.get_json_object(c, f"$.{k}")
    return t.spark.read.parquet(f"{out}-log").select("row_id", "operation", data("new_data", "status").alias("new_status"),
                                                     data("new_data", "change").cast("long").alias("new_change"), data("old_data", "change").cast("long").alias("old_change"))
