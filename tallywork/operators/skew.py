"""Joins and numbering that hold up when one key owns a large part of the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_dir

HOT_ROWS = 1_000_000
SPREAD = 4096


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(big: DataFrame, side: DataFrame, keys: Sequence[str], counts: DataFrame, spread: str,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join ``big`` to ``side``, whose ``keys`` are unique, with hot keys split.

    ``counts`` holds (keys, ``n``): how many rows of ``big`` use a key.  A key
    with more than ``hot_rows`` rows is dealt over ``n / hot_rows`` parts by a
    hash of ``spread``, and its one side row is repeated once per part.  There
    are at most (rows of ``big``) / ``hot_rows`` such keys, which bounds both
    the broadcast list of them and the repeated rows.  Rows with a null key are
    dealt out as well and match nothing.
    """
    keys = list(keys)
    payload = [c for c in side.columns if c not in keys]
    hot = F.broadcast(counts.where(F.col("n") > hot_rows).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("n") / hot_rows).cast("int").alias("_parts")))
    is_hot = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    parts = F.when(no_key, SPREAD).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = big.join(hot, is_hot, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts))
    repeated = side.join(hot, is_hot, "left").select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], *payload,
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1)).alias("_s_part"))
    same = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    return (dealt.join(repeated, [*same, F.col("_part") == F.col("_s_part")], "left")
            .select(*big.columns, *payload))


def position(df: DataFrame, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """Number the rows of each key 1..n by ``order`` (column names or sort columns), without one task per key.

    Rows are dealt into ranges of (keys, order) and written once, with their place
    in their range; counts per range and key then tell how many rows of a key came
    in earlier ranges.  Only these counts, one per key and range, meet by key.  With
    a unique ``order`` even rows that share all but the last of it are spread.
    """
    keys = list(keys)
    spark = df.sparkSession
    shown = [F.col(c).asc() if isinstance(c, str) else c for c in [*keys, *order]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*shown).sortWithinPartitions(*shown).select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
    path = f"{shared_dir(spark)}/position-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    totals = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
                           (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (ranged.join(before, [*same, F.col("_range") == F.col("_r")])
            .withColumn(name, F.col("_place") + F.col("_shift")).select(*df.columns, name))


def running_number(df: DataFrame, order: str, name: str) -> DataFrame:
    """Number all rows 1..n by a unique column; see :func:`position`."""
    return position(df, [], [order], name)
