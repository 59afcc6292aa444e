"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of a partition go to a shard is not left to the rows: the counts
are drawn first, exactly as a uniform permutation of the whole table would give
them (a multivariate hypergeometric matrix whose row sums are the partitions'
rows and whose column sums are the shards' sizes).  Then

1. each partition permutes its rows locally (a sort by a hash, no shuffle),
2. the first rows of the permuted partition go to shard 0, the next to shard 1 and
   so on, as the matrix says (the exchange),
3. each shard permutes what it received, in buckets of bounded size.

The result is a uniform permutation cut into shards whose sizes differ by one at
most.  The matrix is drawn down a tree over the partitions, so that no task sees
more than ``FAN`` counts per shard and the driver sees the number of rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import column, store

#: Children per node of the tree that the matrix is drawn down.
FAN = 8
#: Rows that are ordered together in the second permutation, about.
BUCKET_ROWS = 2048
#: A matrix of up to so many counts is sent to all executors; a larger one is joined by partition.
SENT_COUNTS = 4_000_000
PLACES = (1 << 33) - 1


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; a plain nested expression would be computed at each use."""
    return F.transform(F.array(value), use)[0]


def uniform(*keys: Column | int | str) -> Column:
    """A double strictly between 0 and 1 from a hash of ``keys``."""
    h = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows, taken from ``total`` without putting back, are among the ``good`` ones.

    Inversion outwards from the mode: weights follow from the ratio of neighbours,
    first all ways up, then all ways down, and ``u`` times their sum is used up in that
    order.  Ways end nine deviations (and 40) off the mode, where a double ``u`` can't reach.
    """
    one = F.lit(1.0)

    def walk(bounds):
        n, g, d, mode = (bounds[k] for k in ("n", "g", "d", "mode"))
        up = lambda k: (g - k) * (d - k) / ((k + 1.0) * (n - g - d + k + 1.0))
        down = lambda k: k * (n - g - d + k) / ((g - k + 1.0) * (d - k + 1.0))

        def total_of(steps, ratio, sign):
            start = F.struct(one.alias("w"), F.lit(0.0).alias("sum"))

            def add(s, i):
                w = s["w"] * ratio(mode + sign * (i - 1.0))
                return F.when(i == 0, s).otherwise(_let(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))))

            return F.aggregate(F.sequence(F.lit(0), steps), start, add, lambda s: s["sum"])

        def find(steps, ratio, sign, left):
            start = F.struct(one.alias("w"), left.alias("left"), F.lit(0).alias("at"))

            def use(s, i):
                w = s["w"] * ratio(mode + sign * (i - 1.0))
                taken = _let(w, lambda w: F.struct(w.alias("w"), (s["left"] - w).alias("left"), i.alias("at")))
                return F.when((i == 0) | (s["left"] <= 0), s).otherwise(taken)

            return F.aggregate(F.sequence(F.lit(0), steps), start, use)

        def search(sums):
            target = u * (one + sums["up"] + sums["down"])
            upward = find(bounds["ups"], up, 1.0, target - one)

            def then(s):
                downward = find(bounds["downs"], down, -1.0, s["left"])
                return F.when(s["left"] <= 0, mode + s["at"]).otherwise(_let(downward, lambda t: mode - t["at"]))

            return _let(upward, then)

        sums = F.struct(total_of(bounds["ups"], up, 1.0).alias("up"), total_of(bounds["downs"], down, -1.0).alias("down"))
        return _let(sums, search)

    n, g, d = (c.cast("double") for c in (total, good, draws))
    low, high = F.greatest(F.lit(0.0), d + g - n), F.least(d, g)
    mode = F.greatest(low, F.least(high, F.floor((d + 1) * (g + 1) / (n + 2)).cast("double")))
    spread = F.sqrt(d * (g / n) * ((n - g) / n) * ((n - d) / F.greatest(n - 1, one))) * 9 + 40
    steps = lambda room: F.least(F.ceil(spread).cast("double"), room).cast("int")
    bounds = _let(mode, lambda m: F.struct(n.alias("n"), g.alias("g"), d.alias("d"), m.alias("mode"), steps(high - m).alias("ups"), steps(m - low).alias("downs")))
    return F.when(n > 0, _let(bounds, walk)).otherwise(0.0).cast("long")


def _children(left: Column, kids: Column, level: int, seed: int) -> Column:
    """Rows per shard of each child of a node, drawn one child after the other from what the node has left."""
    none = F.array().cast("array<long>")

    def child(state, kid):
        def cell(s, at):
            x = hypergeometric(state["left"][at], s["pool"], s["rest"], uniform(seed, level, kid["child"], at))
            return _let(x, lambda x: F.struct(F.concat(s["got"], F.array(x)).alias("got"), (s["rest"] - x).alias("rest"), (s["pool"] - state["left"][at]).alias("pool")))

        begin = F.struct(none.alias("got"), kid["n"].alias("rest"), F.aggregate(state["left"], F.lit(0).cast("long"), lambda a, b: a + b).alias("pool"))
        got = F.aggregate(F.sequence(F.lit(0), F.size(state["left"]) - 1), begin, cell, lambda s: s["got"])
        return _let(got, lambda got: F.struct(
            F.zip_with(state["left"], got, lambda a, b: a - b).alias("left"),
            F.concat(state["out"], F.array(F.struct(kid["child"].alias("child"), got.alias("counts")))).alias("out")))

    start = F.struct(left.alias("left"), F.array().cast("array<struct<child:bigint,counts:array<bigint>>>").alias("out"))
    return F.aggregate(kids, start, child, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 42, fan: int = FAN) -> DataFrame:
    """(part, counts): how many rows of each partition go to each shard.

    ``sizes`` holds (part, n), parts counted from 0, n over 0.  Rows of the matrix sum to n,
    columns to the shards' sizes, which differ by one at most.
    """
    total, top = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("part")).first()
    depth = 0
    while top is not None and fan ** depth <= top:
        depth += 1
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    spark = sizes.sparkSession
    nodes = spark.range(1 if total else 0).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(g).cast("long") for g in goal]).alias("counts"))
    for level in range(1, depth + 1):
        width = fan ** (depth - level)
        kids = sizes.groupBy(F.floor(F.col("part") / width).alias("child")).agg(F.sum("n").alias("n"))
        by_node = kids.groupBy(F.floor(F.col("child") / fan).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("kids"))  # fan entries at most
        nodes = (nodes.join(by_node, "node")
                 .select(F.explode(_children(F.col("counts"), F.col("kids"), level, seed)).alias("c"))
                 .select(F.col("c.child").alias("node"), F.col("c.counts").alias("counts")))
    return nodes.select(F.col("node").alias("part"), "counts")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 42, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the columns shard (int from 0) and slot (long, gapless from 0 in each shard).

    Every row is dealt, whatever its columns hold: nulls, empty and very long texts and
    repeated rows are rows like others and take places of their own; equal rows are
    not kept together.  An empty table gives no rows.  Columns of ``df`` named shard or
    slot are replaced.  The result depends on ``seed``, on the rows and on how they lie in
    partitions: a table read from the same files with the same settings is dealt alike.

    The permuted partitions are written once before anything is counted, so a lost
    executor repeats reads of those files, never a draw.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    names = [f"c{i}" for i in range(len(kept))]
    spark = df.sparkSession
    whole = df.select(*[column(c).alias(n) for c, n in zip(kept, names)])
    scrambled = whole.withColumn("_id", F.monotonically_increasing_id()).withColumn("_u", F.xxhash64(F.lit(seed), F.lit(1), "_id"))
    at = F.monotonically_increasing_id()
    local = store(scrambled.sortWithinPartitions("_u", "_id").select(*names, F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit(PLACES)).alias("place")), "permuted")

    sizes = store(local.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    matrix = communication_matrix(sizes, shards, seed)
    # the places of a partition at which its next shard begins
    ends = F.aggregate("counts", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")))))
    matrix = store(matrix.select("part", ends.alias("ends")), "matrix")

    parts, rows = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-rows // (shards * bucket_rows)))
    if parts * shards <= SENT_COUNTS:
        matrix = F.broadcast(matrix)
    shard = F.aggregate("ends", F.lit(0), lambda s, e: s + F.when(F.col("place") >= e, 1).otherwise(0))
    key = uniform(seed, 2, F.col("part"), F.col("place"))
    dealt = (local.join(matrix, "part").withColumn("shard", shard).withColumn("_key", key)
             .withColumn("_bucket", F.floor(F.col("_key") * buckets).cast("int")))

    # a bucket's rows are counted from numbers alone; the texts move once
    counts = store(dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")), "buckets")
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_key", "part", "place"))
    numbered = dealt.withColumn("_at", inside).join(starts, ["shard", "_bucket"])
    return numbered.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], "shard", (F.col("_start") + F.col("_at") - 1).alias("slot"))


def write_shards(dealt: DataFrame, path: str, *, file_rows: int = 100_000) -> None:
    """Shards as folders ``shard=<n>`` of Parquet files, each holding the rows of a stretch of slots in order."""
    stretch = F.floor(F.col("slot") / file_rows)
    (dealt.withColumn("_stretch", stretch).repartition("shard", "_stretch").sortWithinPartitions("shard", "_stretch", "slot")
     .drop("_stretch").write.partitionBy("shard").parquet(path))


def shard_report(df: DataFrame, shards: int, seed: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of documents with their sizes: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size is the text's UTF-8 bytes plus 1; a null text counts as empty.  The law is
    ``rows``, so nothing is said of one more shard (grown_shard is null).
    """
    docs = df.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return shuffle_into_shards(docs, shards, seed).select(
        "doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
