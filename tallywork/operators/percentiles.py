"""Exact continuous percentiles that keep no group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[float],
                      names: Sequence[str], scale: int = 1) -> DataFrame:
    """Interpolated percentiles of ``value`` per key, one row per key.

    Rows are first counted per (key, value), then per (key, bucket of values).
    The bucket width is the square root of the key's value range, so running
    counts over buckets, and over the values inside one bucket, both stay short
    however many rows a key has.  ``value * scale`` must be whole numbers.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, (F.col(value) * scale).cast("long").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                     F.sum("_n").alias("_total"))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_max") - F.col("_min") + 1)).cast("long"))
    c, s = counts.alias("c"), span.alias("s")
    bucketed = (c.join(s, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
                .select(*[F.col(f"c.{k}").alias(k) for k in keys], "_v", "_n", "_total",
                        F.floor((F.col("_v") - F.col("_min")) / width).alias("_b")))
    buckets = bucketed.groupBy(*keys, "_b", "_total").agg(F.sum("_n").alias("_bn"))
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_bn").over(running), F.lit(0)))

    # Each rank asks for the order statistics just below and just above it.
    rank = F.col("_p") * (F.col("_total") - 1)
    wanted = (buckets.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in ranks])))
              .withColumn("_pos", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
              .where((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_bn"))))
    touched = wanted.select(*keys, "_b", "_before").distinct()
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    t = touched.alias("t")
    values = (bucketed.alias("b").join(t, [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
                                       + [F.col("b._b") == F.col("t._b")])
              .select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b._b").alias("_b"), "_v", "_n", "_before")
              .withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_n").over(in_bucket), F.lit(0))))
    w, v = wanted.alias("w"), values.alias("v")
    hits = (w.join(v, [F.col(f"w.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
                   + [F.col("w._b") == F.col("v._b"), F.col("_pos") >= F.col("v._lo"),
                      F.col("_pos") < F.col("v._lo") + F.col("v._n")])
            .select(*[F.col(f"w.{k}").alias(k) for k in keys], "_p", "_total", "_v"))
    frac = F.col("_p") * (F.col("_total") - 1) % 1
    per_rank = hits.groupBy(*keys, "_p", "_total").agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    point = (F.col("_a") + (F.col("_z") - F.col("_a")) * frac) / scale
    return per_rank.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == float(p), point)).alias(n) for p, n in zip(ranks, names)])
