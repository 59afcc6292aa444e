"""Tables in key buckets: a change writes the buckets it touches, and a manifest says which files make up a version.

    base/data/version=<v>/_bucket=<b>   the rows that version v wrote for bucket b
    base/manifests/version=<v>          (bucket, version): the folders that make up the table as of v
    base/commits                        versions that count

A version counts once its commit row is written, and a retried version overwrites its own folders.
Buckets and manifests are bounded by the number of buckets, so the driver may hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .tables import commit, latest_version, merge_latest

BUCKETS = 64
#: Appended pieces of a bucket from which the next append writes the bucket anew.
COMPACT = 16
MANIFEST = "bucket int, version long"


def bucket_of(by: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*by), buckets).cast("int")


def manifest(spark: SparkSession, base: str, before: int | None = None) -> dict[int, list[int]] | None:
    """Versions that hold rows of each bucket, as of the last commit (below ``before``); null without one."""
    version = latest_version(spark, base, before)
    if version is None:
        return None
    out: dict[int, list[int]] = {}
    for r in spark.read.schema(MANIFEST).parquet(f"{base}/manifests/version={version}").collect():  # one row per bucket and piece
        out.setdefault(r.bucket, []).append(r.version)
    return out


def touched_buckets(df: DataFrame, by: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    return [r[0] for r in df.select(bucket_of(by, buckets)).distinct().collect()]


def read_buckets(spark: SparkSession, base: str, only: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The committed table, or of it the buckets ``only``; null before the first commit.  Other buckets' files aren't listed."""
    known = manifest(spark, base, before)
    if not known:
        return None
    path = lambda b, v: f"{base}/data/version={v}/_bucket={b}"
    chosen = known.keys() if only is None else [b for b in only if b in known]
    paths = [path(b, v) for b in chosen for v in known[b]]
    if paths:
        return spark.read.parquet(*paths)
    b = next(iter(known))
    return spark.read.parquet(path(b, known[b][0])).limit(0)


def commit_buckets(df: DataFrame, base: str, version: int, by: Sequence[str], touched: Sequence[int], replace: Sequence[int],
                   buckets: int = BUCKETS, spread: str | None = None) -> None:
    """Write ``df``, whose rows lie in the buckets ``touched``; of these ``replace`` lose what they held, the others gain.

    ``spread`` names a column that deals a bucket's rows over several tasks and files.
    """
    spark = df.sparkSession
    known = manifest(spark, base, version) or {}
    if touched:
        parts = [F.col("_bucket"), *([F.pmod(F.xxhash64(spread), 8)] if spread else [])]
        (df.withColumn("_bucket", bucket_of(by, buckets)).repartition(*parts).write.mode("overwrite").partitionBy("_bucket")
         .parquet(f"{base}/data/version={version}"))
    gone, more = set(replace), set(touched)
    rows = [(b, v) for b, vs in known.items() if b not in gone for v in vs] + [(b, version) for b in sorted(more)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifests/version={version}")
    commit(spark, base, version)


def upsert_buckets(df: DataFrame, base: str, version: int, keys: Sequence[str], columns: Sequence[str] | None = None, order: str | Column | None = None,
                   by: Sequence[str] | None = None, buckets: int = BUCKETS) -> list[int]:
    """SNK-1 on storage: merge ``df`` into the table by ``keys``, rewriting the touched buckets only; gives those.

    Buckets go by the columns ``by`` (``keys`` if unset), which must be among ``keys``.
    """
    keys, by = list(keys), list(by or keys)
    touched = touched_buckets(df, by, buckets)
    old = read_buckets(df.sparkSession, base, touched, version)
    columns = [c for c in df.columns if c not in keys] if columns is None else columns
    merged = merge_latest(df.limit(0) if old is None else old, df, keys, columns, order)
    commit_buckets(merged, base, version, by, touched, touched, buckets)
    return touched


def append_buckets(df: DataFrame, base: str, version: int, by: Sequence[str], spread: str, buckets: int = BUCKETS, compact: int = COMPACT) -> None:
    """Add rows to their buckets; a bucket of ``compact`` pieces is written anew as one."""
    spark = df.sparkSession
    known = manifest(spark, base, version) or {}
    touched = touched_buckets(df, by, buckets)
    full = [b for b in touched if len(known.get(b, ())) >= compact]
    rows = df if not full else df.unionByName(read_buckets(spark, base, full, version).select(*df.columns))
    commit_buckets(rows, base, version, by, touched, full, buckets, spread)


def expire_versions(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Remove bucket folders that none of the last ``keep`` committed versions uses; gives their number."""
    schema = T.StructType([T.StructField("version", T.LongType())])
    versions = sorted({r.version for r in spark.read.schema(schema).parquet(f"{base}/commits").collect()})
    used: set[tuple[int, int]] = set()
    for v in versions[-keep:]:
        used |= {(r.version, r.bucket) for r in spark.read.schema(MANIFEST).parquet(f"{base}/manifests/version={v}").collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{base}/data")
    fs, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for folder in fs.listStatus(root):
        version = int(folder.getPath().getName().split("=")[1])
        for part in fs.listStatus(folder.getPath()):
            name = part.getPath().getName()
            if version in versions and name.startswith("_bucket=") and (version, int(name.split("=")[1])) not in used:
                fs.delete(part.getPath(), True)
                gone += 1
    return gone

