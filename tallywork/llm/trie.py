"""Trie of conversation prefixes, with a count-min screen in front of the exact grouping.

A prefix of a conversation is known by a 128-bit digest: each turn is hashed with
its depth, and the hashes so far are combined by exclusive or, which is associative,
so that even one endless conversation is digested in blocks.  A count-min sketch of all
digests (three rows, counts up to 255, at most ``width`` cells a row) is built by
tasks, merged, and sent to every task.  Its estimate is never too small, so an estimate
of one proves that a prefix belongs to one conversation only: such nodes, the tails,
are emitted where they are.  Digests that the sketch can't clear are shuffled and
grouped exactly.  A sketch too small for its table clears less and changes no result.

Texts are read once, where they lie; what is shuffled are digests and sizes.

Every node belongs to the smallest conversation that passes it, and a conversation's own
nodes are the lower end of its path.  So sums over a subtree are sums over the subtree's
conversations of what they own further down: running sums along conversations, then
one aggregate by node; no walk from level to level.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import join_counted, position
from .common import column, shipped, store

#: Turns of a conversation that are added up in one task.
RUN = 4096
#: Cells in a row of the sketch, at most (a byte each, ROWS rows on the driver and on each executor).
WIDTH = 1 << 22
ROWS = 3
#: Cells that travel together when sketches are merged.
BLOCK = 1 << 16
#: Conversation ids in one piece of an end list.
PIECE = 8192
KEY_ROWS = 1_000_000


def turn_rows(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, key, size): turns numbered from 1 in each conversation, known by the MD5 of role and text.

    Turns are ordered by ``turn``, nulls first; turns that share a number by their MD5.  Null roles
    and texts count as empty.  Rows without a conversation are left out.  Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.where(column(conv_col).isNotNull()).select(
        column(conv_col).cast("long").alias("conv_id"), column(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.octet_length(text).cast("long").alias("size"))
    return position(rows, ["conv_id"], ["turn", "key"], "pos").select("conv_id", "pos", "key", "size")


def graft(rows: DataFrame, base: Column, keep: Column, most: int, hot_rows: int = KEY_ROWS) -> DataFrame:
    """Conversations that begin with turns of another one: (conv_id, length, depth, key, size).

    ``base`` and ``keep`` are expressions of conv_id: a conversation becomes the first ``keep`` (at most
    ``most``) turns of conversation ``base``, all if it has fewer and none if there is no such conversation, and
    then its own turns after its first ``keep``.  A conversation left without turns has one row with a null depth.
    """
    counts = store(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(F.col("keep"), F.coalesce("base_n", F.lit(0)))
    plan = (counts.withColumn("base", base).withColumn("keep", keep.cast("long")).join(bases, "base", "left").withColumn("taken", taken)
            .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("keep"), F.lit(0)))
            .select("conv_id", "base", "keep", "taken", "length"))
    plan = store(plan, "grafts")
    heads = (rows.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(plan, "base").where("pos <= taken")
             .select("conv_id", "length", F.col("pos").alias("depth"), "key", "size"))
    own = rows.where(F.col("pos") > keep)
    tails = (join_counted(own, plan.select("conv_id", "keep", "taken", "length"), ["conv_id"], counts, "key", hot_rows)
             .select("conv_id", "length", (F.col("pos") - F.col("keep") + F.col("taken")).alias("depth"), "key", "size"))
    bare = plan.where("length = 0").select("conv_id", "length", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("size"))
    return heads.unionByName(tails).unionByName(bare)


def _running(df: DataFrame, index: str, values: dict[str, tuple], run: int) -> DataFrame:
    """``df`` with running values along each conversation by ``index`` (whole numbers from 0), in blocks of ``run`` turns.

    ``values`` maps a name to (column, aggregate, function of two columns that joins an earlier value and a later one).
    """
    df = df.withColumn("_block", F.floor(F.col(index) / run))
    blocks = df.where(F.col("length") >= run).groupBy("conv_id", "_block").agg(*[agg(c).alias(f"_{n}") for n, (c, agg, _) in values.items()])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "_block", *[agg(f"_{n}").over(earlier).alias(f"_{n}") for n, (_, agg, _) in values.items()]).where("_block > 0")
    inside = Window.partitionBy("conv_id", "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[agg(c).over(inside).alias(n) for n, (c, agg, _) in values.items()])
    joined = local.join(before, ["conv_id", "_block"], "left")
    return joined.select(*df.drop("_block").columns, *[both(F.coalesce(f"_{n}", F.lit(0)), F.col(n)).alias(n) for n, (_, _, both) in values.items()])


def digests(turns: DataFrame, run: int = RUN) -> DataFrame:
    """``turns`` (conv_id, length, depth, key, size) with the digest (x1, x2) of the prefix that a turn ends, and (p1, p2) of the one before it."""
    hashed = turns.select("conv_id", "length", "depth", "size", *[F.xxhash64(F.lit(i), "depth", "key").alias(f"h{i}") for i in (1, 2)], (F.col("depth") - 1).alias("_at"))
    summed = _running(hashed, "_at", {f"x{i}": (F.col(f"h{i}"), F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for i in (1, 2)}, run)
    return summed.select("conv_id", "length", "depth", "size", "x1", "x2", *[F.col(f"x{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)])


def cells(x1: np.ndarray, x2: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of a sketch row for digests; ``width`` is a power of two."""
    with np.errstate(over="ignore"):
        return ((x1.view(np.uint64) + np.uint64(row) * x2.view(np.uint64)) & np.uint64(width - 1)).astype(np.int64)


def count_min(df: DataFrame, width: int, rows: int = ROWS) -> np.ndarray:
    """Count-min sketch of the digests (x1, x2): uint8 counts, stopping at 255, of shape (rows, width)."""

    def sketch(batches):
        table, waiting, n = np.zeros((rows, width), np.uint8), [], 0

        def settle():
            for r in range(rows):
                hits = np.bincount(np.concatenate([cells(a, b, r, width) for a, b in waiting]), minlength=width)
                table[r] = np.minimum(table[r] + hits, 255)

        for batch in batches:
            waiting.append([np.array(batch.column(i).to_numpy(), np.int64) for i in (0, 1)])
            n += batch.num_rows
            if n >= 1_000_000:
                settle()
                waiting, n = [], 0
        if n:
            settle()
        step = min(BLOCK, width)
        for i, part in enumerate(table.reshape(-1, step)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def merged(batches):
        rows_of = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for block, some in groupby(rows_of, key=lambda r: r[0]):
            total = None
            for _, packed in some:
                part = np.frombuffer(zlib.decompress(packed), np.uint8)
                total = part if total is None else np.minimum(total.astype(np.int64) + part, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    parts = df.select("x1", "x2").mapInArrow(sketch, schema).repartition("block").sortWithinPartitions("block").mapInArrow(merged, schema)
    whole = np.zeros((rows, width), np.uint8)
    flat = whole.reshape(-1, min(BLOCK, width))
    for r in parts.collect():  # rows x width bytes in all
        flat[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return whole


def screened(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """``df`` with ``alone`` and ``parent_alone``: the sketch proves that a prefix, or the one before it, has one conversation."""
    n = df.count()
    width = min(width, 1 << max(6, (4 * n).bit_length()))
    sketch = shipped(df.sparkSession, count_min(df, width))
    at = [df.columns.index(c) for c in ("x1", "x2", "p1", "p2", "depth")]

    def look(batches):
        table = sketch()
        rows, width = table.shape
        for batch in batches:
            x1, x2, p1, p2, depth = (np.array(batch.column(i).to_numpy(), np.int64) for i in at)
            least = lambda a, b: np.min([table[r][cells(a, b, r, width)] for r in range(rows)], axis=0) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least(x1, x2) == 1), pa.array((least(p1, p2) == 1) & (depth > 1))], names=[*batch.schema.names, "alone", "parent_alone"])

    return df.mapInArrow(look, df.select("*", F.lit(True).alias("alone"), F.lit(True).alias("parent_alone")).schema)


def end_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(x1, x2, ends_sha256): SHA-256 of a node's conv_ids, ascending, comma-joined.

    Lists are written out in pieces by ranges, in parallel; a node's pieces then stream through its hash one by one.
    """

    def pieces(batches):
        def flush():
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["x1", "x2", "first", "ids"])

        node, ids = None, []
        for batch in batches:
            for a, b, i in zip(*[c.to_pylist() for c in batch.columns]):
                if ids and (node != (a, b) or len(ids) >= piece):
                    yield flush()
                    ids = []
                node = a, b
                ids.append(i)
        if ids:
            yield flush()

    def hashed(batches):
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
        done = []
        for node, some in groupby(rows, key=lambda r: r[:2]):
            h = hashlib.sha256()
            for i, (_, _, _, ids) in enumerate(some):
                h.update(b"," + ids.encode() if i else ids.encode())
            done.append((*node, h.hexdigest()))
            if len(done) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["x1", "x2", "ends_sha256"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["x1", "x2", "ends_sha256"])

    order = ["x1", "x2", "conv_id"]
    written = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "x1 long, x2 long, first long, ids string")
    order = ["x1", "x2", "first"]
    return written.repartition("x1", "x2").sortWithinPartitions(*order).mapInArrow(hashed, "x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, width: int = WIDTH, run: int = RUN, hot_rows: int = KEY_ROWS) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, length, depth, key, size; see :func:`graft`), one row per node.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (members - 1) times the bytes of a node's last text) and ends_sha256
    (of the ids of conversations that end in the node).  Two conversations share a node if their
    turns are equal up to its depth.  A conversation without turns is a member of the root alone; without
    conversations there are no nodes, not even a root.
    """
    turns = store(turns, "turns")
    paths = store(digests(turns.where("depth IS NOT NULL"), run), "paths")
    marked = store(screened(paths, width), "screened")
    zero = F.lit(0).cast("long")
    convs = turns.where("depth = 1 OR depth IS NULL").select("conv_id", "length")
    roots = convs.select("conv_id", "length", zero.alias("depth"), zero.alias("size"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    shared = marked.where("NOT alone").drop("alone", "parent_alone").unionByName(roots)

    one = lambda c: F.max(c).alias(c)  # noqa: E731  equal in all rows of a node
    nodes = store(shared.groupBy("x1", "x2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), one("depth"), one("size"), one("p1"), one("p2")), "nodes")
    tops = marked.where("alone AND NOT parent_alone")
    kids = store(nodes.where("depth > 0").select("p1", "p2").unionByName(tops.select("p1", "p2")).groupBy("p1", "p2").agg(F.count("*").alias("n")), "kids")
    n_kids = kids.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("n").alias("n_children"))
    known = store(nodes.join(n_kids, ["x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "known")

    # what a conversation owns, summed from its end upwards, then over the conversations of a node
    owned = known.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = shared.join(owned, ["conv_id", "depth"], "left").select("conv_id", "length", "depth", "x1", "x2", F.coalesce("saves", zero).alias("saves"), F.coalesce("leaf", zero).alias("leaf"))
    tails = marked.where("alone AND depth = length").select("conv_id", "length", "depth", F.lit(None).cast("long").alias("x1"), F.lit(None).cast("long").alias("x2"), zero.alias("saves"), F.lit(1).cast("long").alias("leaf"))
    add = lambda a, b: a + b
    below = _running(path.unionByName(tails).withColumn("_up", F.col("length") - F.col("depth")), "_up",
                     {"saved_tokens": (F.col("saves"), F.sum, add), "n_leaves": (F.col("leaf"), F.sum, add)}, run)
    sums = below.where("x1 IS NOT NULL").groupBy("x1", "x2").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    # parents: most nodes have few children, the root and common first turns have very many
    wanted = nodes.where("depth > 0").select("x1", "x2", "p1", "p2", "conv_id").unionByName(tops.select("x1", "x2", "p1", "p2", "conv_id"))
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    found = store(join_counted(wanted, parents, ["p1", "p2"], kids, "x1", hot_rows).select("x1", "x2", F.coalesce("parent", "conv_id").alias("parent_conv_id")), "parents")

    nothing = F.sha2(F.lit(""), 256)
    whole = (known.join(sums, ["x1", "x2"]).join(found, ["x1", "x2"], "left").join(end_hashes(shared.where("depth = length")), ["x1", "x2"], "left")
             .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
    ended = F.col("depth") == F.col("length")
    lone = marked.where("alone AND parent_alone").withColumn("parent_conv_id", F.col("conv_id")).unionByName(tops.join(found, ["x1", "x2"]))
    return whole.unionByName(lone.select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (~ended).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(ended, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256")))
