"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a balanced hierarchical clustering of a bounded sample and sit
in memory as a neighbour graph.  Every vector goes to the list of its nearest
centroid, and vectors near a boundary to a few more.  A query walks the graph, or
looks at all centroids where that is less work, and reads the lists whose centroids
are not much farther than the nearest one.  Lists meet their queries in blocks of
many lists, so a query is sent to a block once however many lists it reads there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import pick, shipped, store

#: Rows of the clustering sample; rows per list aimed at and most lists; rows of lists, and queries, that meet in one task.
SAMPLE, LIST_ROWS, MAX_LISTS, BLOCK_ROWS, BLOCK_QUERIES = 20_000, 400, 4096, 32_768, 40_000
#: Centroids up to which looking at all is less work than a walk; rows of a batch; pairs scored exactly at a time, and held at most.
WALK, STEP, PAIRS, HELD = 12_000, 256, 1 << 16, 1 << 21
#: Most lists a boundary vector may go to and how much farther their centroids may be.
COPIES, CLOSURE = 3, 1.10
#: Share of the neighbours among the sample that the distance ratio of the searches must reach, and queries it is measured on.
AIM, TRIALS = 0.975, 300


def balanced_centroids(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of groups of at most ``leaf`` rows: k-means splits, repeated on what is still too large."""
    out, todo = [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part.mean(axis=0))
            continue
        k = min(8, -(-len(part) // leaf))
        centres = part[rng.choice(len(part), k, replace=False)].copy()
        for _ in range(8):
            nearest = ((centres ** 2).sum(1) - 2 * part @ centres.T).argmin(1)
            for c in range(k):
                if (own := nearest == c).any():
                    centres[c] = part[own].mean(0)
        sizes = np.bincount(nearest, minlength=k)
        if sizes.max() > 0.95 * len(part):   # equal or nearly equal rows: any cut is as good
            todo += np.array_split(part, k)
        else:
            todo += [part[nearest == c] for c in range(k) if sizes[c]]
    return out


class Graph:
    """Centroids with links to their nearest ones, walked for many vectors at once."""

    def __init__(self, centroids: np.ndarray, links: int = 16, entries: int = 32):
        self.centroids = centroids
        self.squares = (centroids ** 2).sum(1)
        n = len(centroids)
        self.links = np.empty((n, min(links, n)), np.int32)
        for a in range(0, n, 512):
            d = self.squares - 2 * centroids[a:a + 512] @ centroids.T
            self.links[a:a + 512] = np.argsort(d, axis=1, kind="stable")[:, :self.links.shape[1]]
        self.entries = np.linspace(0, n - 1, min(entries, n)).astype(np.int32)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of each row, found by a beam search among very many: ids and distances, nearest first; id -1 where there are fewer."""
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        own = (x ** 2).sum(1)[:, None]
        beam = min(beam, n)
        if n <= WALK:
            far = own + self.squares - 2 * x @ self.centroids.T
            ids = np.argpartition(far, beam - 1, axis=1)[:, :beam] if beam < n else np.broadcast_to(np.arange(n), far.shape)
            far = np.take_along_axis(far, ids, 1)
            order = np.lexsort((ids, far), axis=1)
            return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(np.take_along_axis(far, order, 1), 0))
        seen = np.zeros((len(x), n), bool)
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries))).copy()
        seen[:, self.entries] = True
        far = own + self.squares[ids] - 2 * x @ self.centroids[self.entries].T
        spent = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, spent = (np.take_along_axis(a, order, 1) for a in (ids, far, spent))
            open_far = np.where(spent, np.inf, far)
            at = open_far.argmin(1)[:, None]
            if not np.isfinite(np.take_along_axis(open_far, at, 1)).any():
                break
            live = np.isfinite(np.take_along_axis(open_far, at, 1))
            np.put_along_axis(spent, at, True, 1)
            near = self.links[np.take_along_axis(ids, at, 1)[:, 0]]
            new = ~seen[rows, near] & live
            seen[rows, near] |= live
            d = own + self.squares[near] - 2 * np.einsum("bd,bkd->bk", x, self.centroids[near])
            ids = np.concatenate([ids, near], 1)
            far = np.concatenate([far, np.where(new, d, np.inf)], 1)
            spent = np.concatenate([spent, ~new], 1)
        return np.where(np.isfinite(far), ids, -1), np.sqrt(np.maximum(far, 0))


class Index:
    """Graph of centroids in a space where the nearest row has the largest inner product: vectors get one
    more coordinate that makes them equally long, queries get 0."""

    def __init__(self, ids: list, sample: np.ndarray, longest: float, leaf: int, k: int, partly: bool):
        self.longest, self.ids, self.sample = longest, np.array(ids), sample
        lifted = self.lift(sample)
        centroids = np.array(balanced_centroids(lifted, leaf, np.random.default_rng(11)))
        centroids *= longest / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)   # as long as the vectors
        self.graph = Graph(centroids.astype(np.float32))

        self._calibrate(k, partly)

    def _calibrate(self, k: int, partly: bool) -> None:
        """Distance ratio at which ``AIM`` of the sample's own nearest rows would be read, and a beam wide enough for it.

        Where searches would read more rows than there are, as lists share rows, each row goes to one list and all lists are
        read: less work, and nothing is missed.  A table that is its own sample is small enough for either.
        """
        trial = self.sample[:TRIALS]
        self.copies = COPIES
        held = self.lists_of(self.sample)
        far = self._from_all(trial)
        near = far.min(1)[:, None]
        rough = trial @ self.sample.T
        np.fill_diagonal(rough, -np.inf)
        k = min(k, rough.shape[1] - 1)
        needed = [1.0]
        if k > 0:
            top = np.argpartition(-rough, k - 1, axis=1)[:, :k]
            to = np.where(held[top] >= 0, far[np.arange(len(trial))[:, None, None], held[top]], np.inf)
            needed += (to.min(axis=2) / np.maximum(near, 1e-9)).ravel().tolist()
        self.ratio = float(np.quantile(needed, AIM))
        read = far <= self.ratio * near
        self.beam = int(max(32, 1.25 * np.quantile(read.sum(1), 0.99)))
        if partly and (read @ np.bincount(held[held >= 0], minlength=far.shape[1])).mean() >= len(self.sample):
            self.copies, self.ratio = 1, float("inf")

    def _from_all(self, x: np.ndarray) -> np.ndarray:
        c = self.graph.centroids
        q = self.as_query(x)
        return np.sqrt(np.maximum((q ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * q @ c.T, 0))

    def as_query(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)

    def floor(self, ids: list, q: np.ndarray, k: int) -> list[float]:
        """A score that ``2 * k`` rows of the sample reach: twice as many as wanted, as a search may miss some;
        minus infinity if there are fewer."""
        rough = q @ self.sample.T
        rough[np.array(ids)[:, None] == self.ids] = -np.inf
        if rough.shape[1] <= 2 * k:
            return [-np.inf] * len(ids)
        cut = np.partition(rough, -2 * k, axis=1)[:, -2 * k]
        return (cut - 1e-9 * (1 + np.abs(cut))).tolist()

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x ** 2).sum(1), 0))
        return np.hstack([x, rest[:, None]]).astype(np.float32)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """Lists that hold each vector (a row; -1 where there are fewer): the nearest, and others within ``CLOSURE`` whose
        centroid is nearer to the vector than to a list already taken."""
        ids, far = self.graph.search(self.lift(x), 24 if self.copies > 1 else 1)
        c, rows = self.graph.centroids, np.arange(len(x))
        out, n = np.full((len(x), self.copies), -1, np.int64), np.ones(len(x), np.int64)
        out[:, 0], live = ids[:, 0], np.ones(len(x), bool)
        for j in range(1, ids.shape[1]):
            live &= (n < self.copies) & (ids[:, j] >= 0) & (far[:, j] <= CLOSURE * far[:, 0])
            if not live.any():
                break
            fits = live.copy()
            for t in range(self.copies - 1):
                apart = ((c[out[:, t]] - c[ids[:, j]]) ** 2).sum(1)
                fits &= (out[:, t] < 0) | (apart > far[:, j] ** 2)
            out[rows[fits], n[fits]] = ids[fits, j]
            n += fits
        return out

    def lists_for(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """Per query and list whether it reads it: those within the ratio of the nearest, and on until they hold ``wanted`` rows."""
        if self.ratio == float("inf"):
            return np.ones((len(q), len(sizes)), bool)
        ids, far = self.graph.search(self.as_query(q), self.beam)
        rows = np.where(ids >= 0, sizes[ids], 0)
        reads = (ids >= 0) & ((far <= self.ratio * far[:, :1]) | (np.cumsum(rows, axis=1) - rows < wanted))
        out = np.zeros((len(q), len(sizes)), bool)
        out[np.nonzero(reads)[0], ids[reads]] = True
        return out


class Blocks:
    """Which lists meet their queries together: runs of lists of about ``BLOCK_ROWS`` rows; a longer list has blocks of its own."""

    def __init__(self, sizes: np.ndarray):
        self.first, self.parts, self.lists = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), []   # lists: (from, to) by block
        held = 0
        for i, n in enumerate(sizes):
            if n > BLOCK_ROWS:
                self.parts[i] = -(-n // BLOCK_ROWS)
                self.first[i] = len(self.lists)
                self.lists += [(i, i + 1)] * int(self.parts[i])
                held = BLOCK_ROWS   # the next list begins a block
                continue
            if not self.lists or held + n > BLOCK_ROWS:
                self.lists.append((i, i))
                held = 0
            self.first[i], held = len(self.lists) - 1, held + n
            self.lists[-1] = self.lists[-1][0], i + 1

    def asked(self, reads: np.ndarray) -> list[list[dict]]:
        """Per query its blocks, each with the lists it reads there as bits."""
        out: list = [[] for _ in reads]
        for block, (a, b) in enumerate(self.lists):
            some = np.flatnonzero(reads[:, a:b].any(axis=1))
            for i, bits in zip(some, np.packbits(reads[some, a:b], axis=1)):
                out[i].append({"block": block, "lists": bits.tobytes()})
        return out


def vectors_of(column) -> np.ndarray:
    """An Arrow column of lists of one length, none null, as a matrix in double precision."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best pairs of each query, by score, then id; of an id's vectors the best counts."""
    order = np.lexsort((ids[row], -score, query))
    q, i = query[order], ids[row[order]]
    if len(np.unique(ids)) < len(ids):
        kept = np.sort(np.unique(q * len(ids) + np.unique(i, return_inverse=True)[1], return_index=True)[1])
        order, q = order[kept], q[kept]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[nth < k]


def search_block(v: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, qids: np.ndarray, floor: np.ndarray, reads: np.ndarray, k: int):
    """(query, row, score) of the ``k`` best rows for each query, by places, among the lists it reads (``reads[query, list]``).

    Single precision finds what may reach a query's floor, which rises to the score of the ``k``-th found; scores are in double precision.
    """
    with np.errstate(over="ignore"):
        long_v, long_q = np.linalg.norm(v, axis=1).max(initial=0), np.linalg.norm(q, axis=1)
        long_v, long_q = long_v or 1.0, np.where(long_q > 0, long_q, 1.0)   # squares of very small numbers are zero
        if not np.isfinite(long_v * long_q).all():   # beyond double precision: all are scored
            long_v, long_q, floor = np.inf, np.full(len(q), np.inf), np.full(len(q), -np.inf)
    v1, q1 = (v / long_v).astype(np.float32), (q / long_q[:, None]).astype(np.float32)
    slack = (q.shape[1] + 16) * 1.2e-7   # more than sums of single precision are off
    long_q = long_q * long_v if np.isfinite(long_v) else np.ones(len(q))
    low = (floor / long_q - slack).astype(np.float32)
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    new: list = []

    def merged():
        nonlocal found, new
        found = [np.concatenate([x, *[n[i] for n in new]]) for i, x in enumerate(found)]
        new = []
        best = best_of(*found, ids, k)
        found = [x[best] for x in found]
        first, n = np.unique(found[0], return_index=True, return_counts=True)[1:]
        full = first[n == k]
        at = found[0][full]
        if np.isfinite(long_v):
            low[at] = np.maximum(low[at], (found[2][full + k - 1] / long_q[at] - slack).astype(np.float32))

    order = np.argsort(lists, kind="stable")
    for one in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1) if len(order) else []:
        readers = np.flatnonzero(reads[:, lists[one[0]]])
        step = max(1, (1 << 19) // len(one))
        for some in (readers[i:i + step] for i in range(0, len(readers), step)):
            hit = np.flatnonzero(q1[some] @ v1[one].T >= low[some][:, None])
            for start in range(0, len(hit), PAIRS):
                a, b = np.divmod(hit[start:start + PAIRS], len(one))
                a, b = some[a], one[b]
                score = (v[b] * q[a]).sum(1)
                fine = (ids[b] != qids[a]) & np.isfinite(score)
                new.append((a[fine], b[fine], score[fine]))
            if sum(len(n[0]) for n in new) > HELD:
                merged()
    merged()
    return found


def matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64)


def nearest(df: DataFrame, query_rows, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product found for each query row.

    ``query_rows`` is a condition on ``vec_id`` that marks the queries, which search
    all other rows.  Ties go to the smaller id; with fewer rows, all are returned.
    Vectors that are null, zero, hold a null or non-finite component, or differ in
    length from the most frequent one (of those, the longest) take no part, nor do rows
    with a null id; of rows that share an id and a vector one counts, and of several
    vectors under one id, as query or as candidate, the pair that scores best.  Other columns are
    ignored; an empty table gives an empty result.  The index is fitted on at most
    ``SAMPLE`` rows and holds every row.  Lists are worked on in blocks of about ``BLOCK_ROWS``
    rows by ``BLOCK_QUERIES`` queries, so a list that holds most rows is spread over many tasks.
    """
    rows = pick(df, vec_id=id_col, v=vector_col).where("vec_id IS NOT NULL AND v IS NOT NULL")
    if rows.schema["v"].dataType.elementType.typeName() != "float":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    vector = rows.schema["v"].dataType.simpleString()
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = store(rows.where(F.coalesce(fine, F.lit(False))).distinct(), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), F.desc("d")).first()
    if shapes is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == shapes.d)
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"query_id {kind}, vec_id {kind}, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # at most SAMPLE rows
    lists = min(MAX_LISTS, -(-shapes.n // LIST_ROWS))
    made = Index([r.vec_id for r in sample], matrix([r.v for r in sample]), shapes.longest, -(-len(sample) // lists), k, len(sample) < shapes.n)
    index = shipped(df.sparkSession, made)   # the sample and at most MAX_LISTS and some centroids

    def fill(batches):
        import pyarrow as pa

        own = index()
        for batch in batches:
            for part in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                lists = own.lists_of(vectors_of(part.column(1)))
                row, at = np.nonzero(lists >= 0)
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists[row, at], pa.int32())], names=["vec_id", "v", "list"])
    filled = store(rows.select("vec_id", "v").mapInArrow(fill, f"vec_id {kind}, v {vector}, list int"), "lists")
    sizes = np.zeros(len(made.graph.centroids), np.int64)
    for r in filled.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most MAX_LISTS and some rows
        sizes[r.list] = r.n
    blocks = Blocks(sizes)
    reads_type = "array<struct<block: int, lists: binary>>"

    def probe(batches):
        import pyarrow as pa

        own = index()
        for batch in batches:
            for part in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                q = vectors_of(part.column(1))
                reads = blocks.asked(own.lists_for(q, sizes, 8 * k))
                kinds = pa.list_(pa.struct([pa.field("block", pa.int32()), pa.field("lists", pa.binary())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.floor(part.column(0).to_pylist(), q, k), pa.float64()), pa.array(reads, kinds)], names=["query_id", "q", "floor", "reads"])
    queries = rows.where(query_rows).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = store(queries.mapInArrow(probe, f"query_id {kind}, q {vector}, floor double, reads {reads_type}"), "probes")

    def best(held, queries):
        import pyarrow as pa

        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if held.num_rows and queries.num_rows:
            first, last = blocks.lists[held["block"][0].as_py()]
            bits = np.array([np.frombuffer(x, np.uint8) for x in queries["lists"].to_pylist()])
            reads = np.unpackbits(bits, axis=1, count=last - first).astype(bool)
            ids, qids = (np.array(x.to_pylist()) for x in (held["vec_id"], queries["query_id"]))
            found = search_block(vectors_of(held["v"]), ids, held["list"].to_numpy() - first, vectors_of(queries["q"]), qids, queries["floor"].to_numpy(), reads, k)
        return pa.table({"query_id": queries["query_id"].take(pa.array(found[0])), "vec_id": held["vec_id"].take(pa.array(found[1])), "score": pa.array(found[2], pa.float64())})

    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def searched(asked):
        """The ``k`` best of ``asked (query_id, q, floor, reads)``."""
        to = asked.select("*", F.explode("reads").alias("r")).select("query_id", "q", "floor", "r.block", "r.lists")
        counts = {r.block: r.n for r in to.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row per block at most
        shares = df.sparkSession.createDataFrame([(b, int(-(-n // BLOCK_QUERIES))) for b, n in counts.items()], "block int, qs int")
        places = df.sparkSession.createDataFrame([(i, int(blocks.first[i]), int(blocks.parts[i])) for i in np.flatnonzero(sizes).tolist()], "list int, first int, vs int")
        held = filled.join(F.broadcast(places), "list").withColumn("block", F.col("first") + hashed("vec_id", "vs"))
        left = held.join(F.broadcast(shares), "block").select("block", each("qs").alias("b"), "vec_id", "v", "list")
        right = to.join(F.broadcast(shares), "block").select("block", hashed("query_id", "qs").alias("b"), "query_id", "q", "floor", "lists")
        # blocks are heavy in work: their tasks are set here, not merged by size
        tasks = min(most, 2 * sum(-(-n // BLOCK_QUERIES) for n in counts.values()) or 1)
        left, right = left.repartition(tasks, "block", "b"), right.repartition(tasks, "block", "b")
        found = left.groupBy("block", "b").cogroup(right.groupBy("block", "b")).applyInArrow(best, out)
        single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = single.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")

    first = store(searched(asked), "found")
    whole = first.where(F.col("rank") == min(k, shapes.n - 1)).select("query_id")
    short = queries.join(whole, "query_id", "left_anti")
    short = store(short, "short")
    if short.isEmpty():
        return first
    # A query far from all lists may find too few: it reads them all.
    every = F.array(*[F.struct(F.lit(x["block"]).alias("block"), F.lit(x["lists"]).alias("lists")) for x in blocks.asked(np.ones((1, len(sizes)), bool))[0]])
    again = searched(short.select("query_id", "q", F.lit(float("-inf")).alias("floor"), every.alias("reads")))
    return first.join(short.select("query_id"), "query_id", "left_anti").unionByName(again).select("query_id", "rank", "vec_id", "score")
