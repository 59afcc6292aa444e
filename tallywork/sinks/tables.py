"""Table updates over plain Parquet: upsert, replace by key, append, versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def merge_latest(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 order: str | Column | None = None) -> DataFrame:
    """SNK-1: ``target`` with ``columns`` taken from ``updates`` by ``keys``; unmatched updates become rows.

    Columns outside ``columns`` keep their old value.  Several updates of one
    key are reduced first: the highest ``order`` wins, else the greatest row.
    """
    keys, columns = list(keys), list(columns)
    rest = [c for c in updates.columns if c not in keys and c in target.columns]
    row = F.struct(*rest)
    last = F.max(row) if order is None else F.max_by(row, order)
    u = updates.groupBy(*keys).agg(last.alias("_u"))
    u = u.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_u")
    matched = F.col("_u").isNotNull()
    out = target.withColumn("_old", F.lit(True)).join(u, [F.col(k) == F.col(f"_k_{k}") for k in keys], "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"_k_{c}"))
        if c in columns:
            return F.when(matched, F.col(f"_u.{c}")).otherwise(F.col(c))
        if c in rest:
            return F.when(F.col("_old").isNull(), F.col(f"_u.{c}")).otherwise(F.col(c))
        return F.col(c)

    return out.select(*[value(c).alias(c) for c in target.columns])


def replace_by_key(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """SNK-2: all rows of the incoming keys are replaced; keys that bring nothing stay as they are."""
    return target.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def append(df: DataFrame, path: str) -> None:
    """SNK-3: append-only log."""
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, base: str, version: int) -> None:
    """New version of a table beside the old one; it counts once its commit row is written.

    Readers keep the previous version until then, so a lost executor or a
    stopped job never leaves a half-written table in view, and a retried
    version simply overwrites its own folder.
    """
    df.write.mode("overwrite").parquet(f"{base}/data/version={version}")
    commit(df.sparkSession, base, version)


def commit(spark: SparkSession, base: str, version: int) -> None:
    spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{base}/commits")


def latest_version(spark: SparkSession, base: str, before: int | None = None) -> int | None:
    """Last committed version, or the last one below ``before``."""
    schema = T.StructType([T.StructField("version", T.LongType())])
    try:
        versions = spark.read.schema(schema).parquet(f"{base}/commits")
        return (versions if before is None else versions.where(F.col("version") < before)).agg(F.max("version")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    """The committed table, or null before the first commit; a table in buckets is put together from its manifest."""
    version = latest_version(spark, base) if version is None else version
    if version is None:
        return None
    from .buckets import read_buckets

    try:
        return read_buckets(spark, base, before=version + 1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):   # no manifest
            return spark.read.parquet(f"{base}/data/version={version}")
        raise


def refresh_rollups(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], base: str,
                    allowed: Sequence[str] | None = None) -> DataFrame:
    """SNK-7: rewrite each rollup in order; one that fails is reported and the others go on."""
    done = []
    for name, job in jobs.items():
        try:
            if allowed is not None and name not in allowed:
                raise ValueError(f"{name} is not a known rollup")
            job().write.mode("overwrite").parquet(f"{base}/{name}")
            done.append((name, True, None))
        except Exception as e:  # the state of every rollup is the result
            done.append((name, False, str(e)))
    return spark.createDataFrame(done, "view string, refreshed boolean, error string")
