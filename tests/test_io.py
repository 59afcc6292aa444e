"""Sources, sinks and streams on files."""

import base64
import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallywork.operators.duplicates import LOOKUP_KEY, find_duplicates
from tallywork.session import shared_dir
from tallywork.sinks import buckets as B, invoices as S, tables as W
from tallywork.sources import collect as C, datasets as G, landing as A
from tallywork.streaming import jobs as J


def test_landing_scan(spark, tmp_path):
    for p in ("invoices/c1/2024/05/a.pdf", "invoices/c1/2024/b.PDF", "invoices/c2/c.pdf", "invoices/c2/2024/05/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"%PDF-1.4")
    got = {r.file_name: (r.client_id, r.year, r.month) for r in A.landed_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("c1", "2024", "05"), "b.PDF": ("c1", "2024", None), "c.pdf": ("c2", None, None)}
    with_bytes = A.landed_documents(spark, str(tmp_path), content=True).select(A.pdf_error(F.col("content")).alias("e"))
    assert {r.e for r in with_bytes.collect()} == {None}


def test_pdf_checks(rows):
    df = rows("c binary, m string", (bytearray(b"%PDF-1"), "application/pdf"), (bytearray(b"%PDF-1"), "text/plain"), (bytearray(b"%P"), None), (bytearray(b""), None))
    assert [r.e for r in df.select(A.pdf_error(F.col("c"), F.col("m")).alias("e")).collect()] == [None, "invalid_mime", "invalid_magic_bytes", "invalid_magic_bytes"]


def test_xml(rows):
    df = rows("storage_key string, content binary", ("a", bytearray("<x:R xmlns:x='u'><A> é </A><B/>tail</x:R>".encode())), ("b", bytearray(b"<R>")), ("c", None))
    got = {r.storage_key: (r.text, r.char_count, r.error is None) for r in A.xml_text(df).collect()}
    assert got == {"a": ("A: é", 4, True), "b": ("", 0, False), "c": ("", 0, False)}


def test_json_recovery(rows):
    df = rows("s string", ('{"a": {"b": 1}}',), ('x ```json\n{"a":\n 2}\n``` y',), ('so {bad} then',), ('pre {"a": 3} post {"a": 4}',), ("none",))
    got = [(r.r.found_in, r.r.body) if r.r else None for r in df.select(A.recovered_json(F.col("s")).alias("r")).collect()]
    assert got == [("whole", '{"a": {"b": 1}}'), ("fenced", '{"a":\n 2}'), None, ("flat", '{"a": 3}'), None]


@pytest.mark.parametrize("data", [b"", b"a", b"ab", b"\xfb\xff\xfe", bytes(range(256))])
def test_attachments(spark, data):
    for text in (base64.urlsafe_b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
        assert bytes(spark.range(1).select(A.decode_attachment(F.lit(text)).alias("b")).first().b) == data


def test_labelled_cases(spark, tmp_path):
    for name in ("synthetic-1", "invoice-2", "invoice-1"):
        case = {"meta": {"description": "d", "math_error": False}, "input": {"raw_text": "t"}, "expected": {"total": "1.00", "vat_rate": 23}}
        (tmp_path / f"{name}.json").write_text(json.dumps(case, indent=1))
    got = G.labelled_cases(spark, str(tmp_path)).select("case_id", "expected.vat_rate").collect()
    assert [tuple(r) for r in got] == [("invoice-1", "23"), ("invoice-2", "23"), ("synthetic-1", "23")]
    assert [r.case_id for r in G.labelled_cases(spark, str(tmp_path), real_only=True, first=1).collect()] == ["invoice-1"]


def test_collect_caps_each_folder_and_the_mailbox(rows):
    clients = rows("id long, legal_name string, status string, drive_folder_id string", (1, "a", "active", "f1"), (2, "b", "draft", "f2"), (3, "c", "active", None))
    files = rows("folder_ref string, id string, name string, mime_type string", *[("f1", f"x{i}", "n", "application/pdf") for i in range(5)],
                 ("f1", "x9", None, "application/pdf"), ("f2", "y", "n", "application/pdf"), ("f1", "a0", "n", "text/plain"))
    mail = rows("message_id string, file_name string, attachment_id string", *[(f"m{i}", "n", "a") for i in range(4)])
    assert [r.source_ref for r in C.collected(clients, files, mail, cap=2).orderBy("source_ref").collect()] == ["x0", "x1"]
    assert C.collected(clients, files, mail, cap=2, preview=True).count() == 4
    allow = rows("source_ref string", ("x3",), ("m1",))
    assert {r.source_ref for r in C.collected(clients, files, mail, allowlist=allow, preview=True).collect()} == {"x3", "m1"}


def test_upsert_keeps_other_columns(rows):
    old = rows("nif string, name string, category long", ("1", "a", 7), ("2", "b", None))
    new = rows("nif string, name string, at int", ("1", "late", 2), ("1", "early", 1), ("3", "c", 1))
    got = {r.nif: (r.name, r.category) for r in W.merge_latest(old, new, ["nif"], ["name"], order="at").collect()}
    assert got == {"1": ("late", 7), "2": ("b", None), "3": ("c", None)}


def test_replace_with_nothing_changes_nothing(rows):
    old = rows("k long, v long", (1, 1), (1, 2), (2, 3))
    assert W.replace_by_key(old, old.limit(0), "k").count() == 3
    assert sorted(tuple(r) for r in W.replace_by_key(old, rows("k long, v long", (1, 9)), "k").collect()) == [(1, 9), (2, 3)]


def test_versions_and_rollups(spark, tmp_path):
    base = str(tmp_path / "t")
    assert W.read_version(spark, base) is None
    W.write_version(spark.range(3), base, 1)
    spark.range(9).write.parquet(f"{base}/data/version=2")  # written but never committed
    assert W.read_version(spark, base).count() == 3
    W.write_version(spark.range(4), base, 2)
    assert W.read_version(spark, base).count() == 4

    def broken():
        raise RuntimeError("no")
    jobs = {"a": lambda: spark.range(2), "b": broken, "c": lambda: spark.range(1), "z": lambda: spark.range(1)}
    got = {r["view"]: r.refreshed for r in W.refresh_rollups(spark, jobs, str(tmp_path / "r"), allowed=["a", "b", "c"]).collect()}
    assert got == {"a": True, "b": False, "c": True, "z": False}


def test_purge(rows):
    df = rows("id long, client_id long, retention_until date", (1, 1, date(2020, 1, 1)), (2, 1, date(2024, 1, 1)), (3, 2, date(2019, 1, 1)), (4, 1, None))
    now = F.lit(datetime(2024, 1, 1))
    assert tuple(S.purge(df, now)["summary"].first()) == (True, 2, 0)
    out = S.purge(df, now, client_id=1, dry_run=False)
    assert tuple(out["summary"].first()) == (False, 1, 1)
    assert [r.row_id for r in out["audit"].collect()] == [1] and {r.id for r in out["kept"].collect()} == {2, 3, 4}


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


# --- streams in several steps -----------------------------------------------------

INV = ("id long, created_at timestamp, document_hash string, processing_status string, issuer_nif string, invoice_number string, "
       "issue_date date, total_with_vat decimal(14,2), client_id long")


def arrivals(spark, n):
    return spark.range(n).select(
        "id", F.expr("timestampadd(HOUR, CAST(id AS INT), TIMESTAMP '2024-01-01')").alias("created_at"), F.expr("CASE WHEN id % 3 = 0 THEN 'same' ELSE CAST(id AS STRING) END").alias("document_hash"),
        F.expr("CASE WHEN id % 10 = 1 THEN 'duplicado' ELSE 'ok' END").alias("processing_status"), F.lit("5").alias("issuer_nif"),
        F.expr("CAST(id % 20 AS STRING)").alias("invoice_number"), F.expr("DATE '2024-01-01'").alias("issue_date"),
        F.lit(1).cast("decimal(14,2)").alias("total_with_vat"), (F.col("id") % 4).alias("client_id"))


@pytest.fixture
def in_steps(spark, tmp_path):
    """Run a job on a folder that grows three times; gives the folder of its results and all rows."""
    def run(job, n=90):
        src, everything = str(tmp_path / "in"), arrivals(spark, n)
        for step in range(3):
            everything.where(f"id div {n // 3} = {step}").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(everything.schema).parquet(src)
            job(stream)
        return everything
    return run


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_duplicates_on_arrival(spark, tmp_path, in_steps):
    out = str(tmp_path / "out")
    everything = in_steps(lambda s: J.find_duplicates_as_they_arrive(s, out, str(tmp_path / "c")))
    got = spark.read.parquet(f"{out}/found").drop("batch")
    assert got.count() == 90 and same(got, find_duplicates(everything))


def test_arrival_history_keeps_what_it_looks_up(spark, tmp_path, in_steps):
    out = str(tmp_path / "out")
    with_gaps = lambda df: df.withColumns({"document_hash": F.expr("CASE WHEN id % 7 <> 0 THEN document_hash END"),
                                           "invoice_number": F.expr("CASE WHEN id % 5 <> 0 THEN invoice_number END")})
    everything = in_steps(lambda s: J.find_duplicates_as_they_arrive(with_gaps(s), out, str(tmp_path / "c")))
    by_hash, by_key = B.read_buckets(spark, f"{out}/by_hash"), B.read_buckets(spark, f"{out}/by_key")
    assert set(by_hash.columns) == {"id", "created_at", "document_hash"}
    assert set(by_key.columns) == {"id", "created_at", "processing_status", *LOOKUP_KEY}
    assert by_hash.count() == everything.where("id % 7 <> 0").count()
    got = spark.read.parquet(f"{out}/found").drop("batch")
    assert got.count() == 90 and same(got, find_duplicates(with_gaps(everything)))


def test_throughput_and_rolling_windows(spark, tmp_path, in_steps):
    out = str(tmp_path / "days")
    everything = in_steps(lambda s: J.daily_throughput(s, out, str(tmp_path / "c")))
    want = everything.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("count"))
    assert same(W.read_version(spark, out), want)


def test_rolling_quality(spark, tmp_path, in_steps):
    out = str(tmp_path / "roll")
    everything = in_steps(lambda s: J.rolling_quality(s, out, str(tmp_path / "c")))
    want = (everything.groupBy("client_id", F.window("created_at", "30 days", "1 day").alias("w")).agg(F.count("*").alias("total"))
            .select("client_id", F.col("w.end").alias("window_end"), "total"))
    assert same(W.read_version(spark, out).select("client_id", "window_end", "total"), want)


def test_profiles(spark, tmp_path, in_steps):
    out = str(tmp_path / "prof")
    cols = [F.col("client_id").alias("supplier_id"), (F.col("id") % 2).alias("gl_account_id"), F.col("created_at").alias("classified_at")]
    everything = in_steps(lambda s: J.supplier_profiles(s.select(*cols), out, str(tmp_path / "c")))
    want = everything.select(*cols).groupBy("supplier_id", "gl_account_id").agg(F.count("*").alias("match_count"), F.max("classified_at").alias("last_seen_at"))
    assert same(W.read_version(spark, out), want)


def test_audit_and_dispatch(spark, tmp_path, in_steps):
    base, log = str(tmp_path / "t"), str(tmp_path / "log")
    versions = lambda s: s.select((F.col("id") % 30).alias("id"), F.col("id").alias("v"), F.col("created_at").alias("updated_at"))
    in_steps(lambda s: J.audit_changes(versions(s), base, log, str(tmp_path / "c")))
    ops = {r.operation: r["count"] for r in spark.read.parquet(log).groupBy("operation").count().collect()}
    assert ops == {"INSERT": 30, "UPDATE": 60} and W.read_version(spark, base).where("v < 60").isEmpty()


def test_dispatch_once_and_ingest(spark, tmp_path, in_steps):
    out = str(tmp_path / "d")
    keyed = lambda s: s.select(F.col("created_at").alias("ts"), F.lit(1).alias("client_id"), F.lit(1).alias("batch_id"), F.col("issuer_nif").alias("file_name"))
    in_steps(lambda s: J.run_available(J.dispatched_once(keyed(s), keep="90 days"), str(tmp_path / "c"), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/b={i}")))
    assert spark.read.parquet(out).count() == 1


def test_ingest(spark, tmp_path, in_steps):
    out = str(tmp_path / "docs")
    doc = lambda s: s.select(F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("storage_key"), F.lit(None).cast("string").alias("mime_type"), F.encode("document_hash", "UTF-8").alias("content"))
    in_steps(lambda s: J.ingest_documents(doc(s), out, str(tmp_path / "c")))
    got = spark.read.parquet(out)
    assert got.count() == 90 and got.select("doc_format").distinct().count() == 1


def test_dispatch_agrees_however_batches_cut_and_spill(spark, tmp_path):
    """Rows unordered within a batch, one hot key; three small batches with spilled state equal one batch and a plain walk."""
    rng = random.Random(2)
    rows = sorted(((rng.randrange(40_000), rng.choice("hhhxyz")) for _ in range(3000)), key=lambda r: r[0])
    frames = [spark.createDataFrame([(t, 1, k) for t, k in rng.sample(rows[a:a + 1000], 1000)], "t long, batch_id long, file_name string")
              .select(F.timestamp_seconds("t").alias("ts"), F.lit(1).alias("client_id"), "batch_id", "file_name") for a in (0, 1000, 2000)]
    want = set()
    for k in "hxyz":
        last = None
        for t, kk in rows:
            if kk == k and (last is None or t >= last + 600):
                want.add((k, t))
                last = t
    for name, steps, in_memory in (("three", [[f] for f in frames], 50), ("one", [frames], 100_000)):
        src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
        for step in steps:
            for f in step:
                f.write.mode("append").parquet(src)
            stream = spark.readStream.schema(frames[0].schema).parquet(src)
            J.run_available(J.dispatched_once(stream, keep="10 minutes", in_memory=in_memory), str(tmp_path / f"{name}-c"), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/b={i}"))
        assert {(r.file_name, int(r.ts.timestamp())) for r in spark.read.parquet(out).collect()} == want


def test_late_days_correct_their_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "roll")
    rows = [[("2024-03-10", 1, "ok"), ("2024-03-11", 1, "x"), ("2024-03-10", 2, "ok")], [("2024-03-02", 1, "ok"), ("2024-04-20", 2, "requires_review")]]
    schema, everything = "d string, client_id long, processing_status string", []
    for step in rows:
        everything += step
        df = spark.createDataFrame(step, schema).select(F.to_timestamp("d").alias("created_at"), "client_id", "processing_status")
        df.write.mode("append").parquet(src)
        J.rolling_quality(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "c"), late="40 days")
    whole = spark.createDataFrame(everything, schema).select(F.to_timestamp("d").alias("created_at"), "client_id", "processing_status")
    status = lambda s: F.count_if(F.col("processing_status") == s)
    want = (whole.groupBy("client_id", F.window("created_at", "30 days", "1 day").alias("w")).agg(F.count("*").alias("total"), status("ok").alias("ok_count"), status("requires_review").alias("review_count"))
            .select("client_id", F.col("w.end").alias("window_end"), "total", "ok_count", "review_count"))
    assert same(W.read_version(spark, out), want)


def test_buckets_touch_what_changes(spark, tmp_path):
    base = str(tmp_path / "t")
    first = spark.range(500).select("id", F.lit(0).alias("v"))
    assert B.read_buckets(spark, base) is None
    assert sorted(B.upsert_buckets(first, base, 0, ["id"], buckets=16)) == list(range(16))
    some = spark.createDataFrame([(3, 7), (900, 8)], "id long, v int")
    touched = B.upsert_buckets(some, base, 1, ["id"], buckets=16)
    written = [p.name for p in (tmp_path / "t/data/version=1").iterdir() if p.name.startswith("_bucket=")]
    assert len(written) == len(touched) <= 2
    B.upsert_buckets(some, base, 1, ["id"], buckets=16)   # the same version again
    got = {r.id: r.v for r in W.read_version(spark, base).collect()}
    assert got == {**{i: 0 for i in range(500)}, 3: 7, 900: 8}
    assert B.read_buckets(spark, base, before=1).count() == 500
    assert {r.id for r in B.read_buckets(spark, base, touched).collect()} >= {3, 900} and B.read_buckets(spark, base, [77]).count() == 0
    assert B.expire_versions(spark, base, keep=1) == len(touched) and W.read_version(spark, base).count() == 501


def test_appended_buckets_are_compacted(spark, tmp_path):
    base = str(tmp_path / "t")
    for v in range(6):
        B.append_buckets(spark.range(v * 10, v * 10 + 10).select("id", (F.col("id") % 2).alias("k")), base, v, ["k"], "id", buckets=4, compact=3)
    pieces = B.manifest(spark, base)
    assert max(map(len, pieces.values())) <= 3
    assert sorted(r.id for r in B.read_buckets(spark, base).collect()) == list(range(60))


def test_invoices_make_only_the_columns_read(spark, tmp_path):
    from tallywork.bindings import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.invoices.groupBy("processing_status").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_orderkey" not in plan


def test_month_store_computes_columns_behind_the_move(spark, tmp_path):
    from tallywork.plans.quality import store_by_month
    df = spark.sql("SELECT id, timestampadd(DAY, id, TIMESTAMP '2024-01-20') AS at FROM range(40)")
    store_by_month(df, "at", f"{tmp_path}/m", {"id": "id", "wide": "repeat('x', int(id))"})
    got = spark.read.parquet(f"{tmp_path}/m")
    assert set(got.columns) == {"id", "at", "wide", "at_month"} and got.count() == 40
    assert got.where("length(wide) <> id OR date_trunc('month', at) <> at_month").isEmpty()
