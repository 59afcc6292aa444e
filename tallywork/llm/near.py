"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard.

All signature coordinates come from two permutations of the 32-bit numbers: the
first scatters the shingles, the second is applied to them shifted by 0, 1, 2, ...
around the circle.  Documents with equal shingle sets form a class and are
searched once.  Candidates share a band; every link is confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import per_batch, pick, store, words

#: Words of a shingle, bands and their rows.  Two sets with Jaccard 0.85 miss all
#: 16 bands of 4 rows with probability (1 - 0.85 ** 4) ** 16 < 0.00001.
WIDTH, BANDS, ROWS = 5, 16, 4

_U64, _U32 = np.uint64, np.uint32
_FACTORS = [_U64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 64)]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit numbers."""
    x = (x ^ (x >> _U32(16))) * _U32(0x85EBCA6B)
    x = (x ^ (x >> _U32(13))) * _U32(0xC2B2AE35)
    return x ^ (x >> _U32(16))


def _second(x: np.ndarray) -> np.ndarray:
    """Second permutation, in place."""
    x ^= x >> _U32(16)
    x *= _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    x ^= x >> _U32(16)
    return x


class Shingles:
    """Sets of hashed word shingles; word hashes are kept up to a bound."""

    def __init__(self, width: int = WIDTH, keep: int = 500_000):
        import xxhash

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= keep:
                    self.clear()
                h = self[word] = xxhash.xxh3_64_intdigest(word)
                return h
        self.width, self.words = width, Words()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer words than the width make one shingle, none make none."""
        found = words(text)
        n = len(found)
        if not n:
            return np.empty(0, _U64)
        h = np.fromiter(map(self.words.__getitem__, found), _U64, n)
        width = min(self.width, n)
        sums = np.full(n - width + 1, width, _U64)
        for k in range(width):
            sums += h[k:n - width + 1 + k] * _FACTORS[k]
        return np.unique(_mix64(sums))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash signatures (32 bit) of non-empty sets."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    scattered = _scatter((np.concatenate(sets) >> _U64(32)).astype(_U32))
    out = np.empty((len(sets), size), _U32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_second(scattered + _U32(k)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    cut = signature.astype(_U64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U64), cut.shape[:2]).copy()
    for k in range(rows):
        key = _mix64(key * _U64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _described(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, key, bands``: set size, 128-bit digest of the set and band keys; the last two null without shingles."""
    def make():
        shingles = Shingles()

        def work(ids, texts):
            sets = [shingles.of(t) for t in texts]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, bands * rows), bands, rows).tolist() if full else ())
            for i, s in zip(ids, sets):
                yield (i, len(s), set_key(s), next(keys)) if len(s) else (i, 0, None, None)
        return work
    return per_batch(df, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n bigint, key binary, bands array<bigint>", make)


def _sets(df: DataFrame) -> DataFrame:
    """``key, items``: the whole set of every row's text."""
    def make():
        shingles = Shingles()

        def work(ids, texts):
            for t in texts:
                s = shingles.of(t)
                yield set_key(s), s.view(np.int64).tolist()
        return work
    return per_batch(df, "key binary, items array<bigint>", make)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the connected components of ``edges (a, b)``; root: the least node.

    Large-star and small-star steps in turn, each stored, until nothing changes;
    edges of a hub are never gathered.  Isolated nodes don't appear.
    """
    flip = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        both = edges.unionByName(flip(edges))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = store(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now


def near_duplicates(df: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets
    of five-word shingles (all words, when there are fewer); ``component_id`` is the
    smallest id reachable, ``kept`` marks the row that has it.  Null and blank texts
    have an empty set and stand alone; a null id keeps its row, with a null
    component.  Repeated rows are copies of each other; of rows that share an id,
    all are kept if the id is.  Other columns are ignored, an empty table gives an
    empty result.

    Work per band bucket: two distinct sets are compared directly.  In larger
    buckets a set's shingles that no other searched set has bound every overlap
    from above; sets that can't reach the limit drop out, the rest are compared
    with the most central one, and only sets that this leaves apart, and that the
    bounds allow, are compared with each other.  No pair that could be a link is passed over.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    told = store(_described(docs, bands, rows), "signatures")
    classes = store(told.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min("bands").alias("bands")), "classes")
    members = classes.select("key", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).where("size > 1")
    sizes = store(sizes, "buckets")
    in_large = store(members.join(sizes.where("size > 2").select("bucket"), "bucket"), "members")
    twos = sizes.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()

    searched = twos.select(F.explode(F.array("a", "b")).alias("key")).unionByName(in_large.select("key")).distinct()
    wanted = classes.join(searched, "key", "left_semi").select(F.col("first_id").alias("doc_id"))
    sets = _sets(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")).dropDuplicates(["key"])
    sets = store(sets.join(searched, "key", "left_semi"), "sets")

    # Shingles that one set of the larger buckets has alone bound what it can share: at most n - alone.
    large = in_large.select("key").distinct()
    alone = (sets.join(large, "key", "left_semi").select("key", F.explode("items").alias("item"))
             .groupBy("item").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1")
             .groupBy("key").agg(F.count("*").alias("alone")))
    able = in_large.join(alone, "key", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    able = store(able.where(f"100 * most >= {percent} * n").select("bucket", "key", "n", "most"), "able")
    centre = able.groupBy("bucket").agg(F.max_by("key", F.struct(F.col("most") / F.col("n"), "key")).alias("centre"), F.count("*").alias("size")).where("size > 1")
    stars = able.join(centre, "bucket").where("key <> centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"))
    tested = store(twos.unionByName(stars).distinct(), "pairs")
    common = store(_overlaps(tested, sets), "overlaps")
    links = _reaching(common, percent)
    root = components(links)

    placed = able.join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    with_centre = F.struct(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"))
    placed = placed.join(centre.select("bucket", "centre"), "bucket").withColumn("pair", with_centre).select("bucket", "key", "n", "most", "root", "pair.*")
    placed = placed.join(common.select("a", "b", "common"), ["a", "b"], "left").withColumn("common", F.coalesce("common", "n")).drop("a", "b")
    placed = store(placed, "placed")   # common: shingles shared with the centre; most - common: those that others may share
    main = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    main = main.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    main = store(main.where("roots > 1"), "apart")
    # Of what a set shares with another one, no more can lie inside the centre than each shares with it, and no more
    # outside than each has there in company: |A and B| must reach percent / (100 + percent) of the summed sizes.
    need = f"{100 + percent} * most >= {percent} * (n + lo)"
    bands = classes.select("key", "bands")
    rest = (placed.join(main, "bucket").where("root <> main").where(need).where(f"100 * hi >= {percent} * n").join(bands, "key")
            .select(F.col("bucket").alias("meet"), F.col("key").alias("a"), F.col("n").alias("n1"), F.col("most").alias("m1"), F.col("common").alias("c1"), F.col("root").alias("r1"), F.col("bands").alias("bands1")))
    others = placed.join(main.select("bucket"), "bucket").join(bands, "key")
    first = F.get(F.filter(F.zip_with("bands1", "bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 0)   # a pair meets in its first shared bucket
    able_pair = F.expr(f"root <> r1 AND {100 + percent} * least(n, n1, least(common, c1) + least(most - common, m1 - c1)) >= {percent} * (n + n1)")
    pairs = rest.join(others, (F.col("meet") == F.col("bucket")) & able_pair & (first == F.col("meet")))
    pairs = pairs.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
    more = store(_reaching(_overlaps(pairs.join(tested, ["a", "b"], "left_anti"), sets), percent), "links")
    if not more.isEmpty():
        root = components(links.unionByName(more))

    rooted = classes.select("key", "first_id").join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told_of = rooted.join(least, "root").select("key", "component_id")
    out = told.join(told_of, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                      F.coalesce(F.when(F.col("key").isNull(), F.lit(True)).when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id")), F.lit(True)).alias("kept"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, sizes``: shingles that the whole sets of each pair share, and their summed sizes."""
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))


def _reaching(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(f"100 * common >= {percent} * (sizes - common)").select("a", "b")
