"""Resampling, the prefix trie and sharding against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallywork.llm import resample, shards, trie

EDGES = [(None, "one two three four five six"), (-7, None), (-8, ""), (-9, "?!.,"), (-10, "É" * 50 + " ÀB"), (-11, "word " * 4000)]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# --- resampling ------------------------------------------------------------------------

def features(text, buckets):
    found = WORD.findall((text or "").translate(LOWER))
    return len(found), [zlib.crc32(" ".join(found[i:i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def plain_resample(docs, target, percent, seed, buckets, least):
    s, t, own = Counter(), Counter(), [features(x, buckets) for _, x in docs]
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x, buckets)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -(1 << 63) if r[0] is None else r[0]))
    for rank, r in enumerate(drawn[:percent * len(drawn) // 100], 1):
        r[5] = rank
    return rows


def test_resampling_equals_a_plain_version(docs, rows):
    rnd = random.Random(31)
    text = lambda: " ".join(rnd.choice(["ba", "Do", "rI-ku", "ne7", "é.", "x" * 45]) for _ in range(rnd.randint(1, 60)))
    texts = [(i, text()) for i in range(120)] + EDGES
    target = ["ba ba do", None, "ne7 ku", ""]
    got = resample.importance_resample(docs(*texts), rows("item_id long, text string", *enumerate(target)), percent=30, seed=5, least_words=4, buckets=64, block=16, bits=3)
    want = plain_resample(texts, target, 30, 5, 64, 4)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want))
    found = resample.resampled(docs(*texts), got)
    assert {(r.doc_id, r.rank, r.text) for r in found.collect()} == {(r[0], r[5], dict(texts)[r[0]]) for r in want if r[5]}


def test_resampling_of_repeated_rows_and_nothing(docs, rows):
    target = rows("text string", ("a b",))
    got = resample.importance_resample(docs(*[(3, "a b c d")] * 5, (1, "a b c d")), target, percent=50, least_words=1).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and len(got) == 6
    assert resample.importance_resample(docs(*EDGES).limit(0), target).collect() == []
    assert len(resample.importance_resample(docs(*EDGES), target.limit(0)).collect()) == len(EDGES)


def test_buckets_of_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(resample, "STRETCH", 7)
    monkeypatch.setattr(resample, "KNOWN", 5)
    at = resample.Buckets(1000)
    texts = ["a b c d e f g h i j k l m n o p q r s", "x" * 50 + " " + "y" * 60 + " zz " + "é" * 45 + " ok", "", None, "Hello, World 12x"] * 3
    found = defaultdict(list)
    for some, doc in at.of([None if t is None else t.encode() for t in texts]):
        for b, d in zip(some.tolist(), doc.tolist()):
            found[d].append(b)
    for i, t in enumerate(texts):
        n, want = features(t, 1000)
        assert sorted(found[i]) == sorted(want) and at.n_words[i] == n


@pytest.mark.parametrize("block, bits", [(64, 5), (16, 11), (1 << 16, 9)])
def test_radix_ranks(spark, block, bits):
    rnd = random.Random(block)
    rows = [(rnd.randrange(-3, 3), rnd.choice([-5, 7, 10 ** 17, -10 ** 18, -(1 << 63), (1 << 63) - 1]), i) for i in range(500)]
    got = resample.radix_ranks(spark.createDataFrame(rows, "a long, b long, i long").repartition(7), ["a", "b"], block=block, bits=bits).collect()
    got.sort(key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(500)) and [(r.a, r.b) for r in got] == sorted(r[:2] for r in rows)
    assert Counter(r.i for r in got) == Counter(range(500))


def test_draw_with_ties_sorts_only_what_can_be_drawn(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 7).otherwise(F.col("id") % 5 - 100000).cast("long").alias("score"))
    got = {r.doc_id: r.rank for r in resample.draw(df, 60).where("rank IS NOT NULL").collect()}
    assert got == {10 * k: k + 1 for k in range(60)}
    assert resample.draw(df, 60).count() == 1000 and resample.draw(df, 0).where("rank IS NOT NULL").isEmpty()


# --- prefix trie -----------------------------------------------------------------------

def plain_trie(convs):
    """``convs``: id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[:len(path)] == path]
        parents = {q[:-1] for q in below if q}
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(q) == len(path) + 1 for q in below),
                    sum(q not in parents for q in below), sum((len(nodes[q]) - 1) * len((q[-1][1] or "").encode()) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), key, (role or "", text or "")))
    convs = {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


CONV = "conv_id long, turn long, role string, text string, key string, size int, depth string, `part` int"


def run_trie(df, **sizes):
    keep = F.crc32(F.col("conv_id").cast("string")) % 9
    return trie.prefix_trie(trie.graft(trie.turn_rows(df), F.col("conv_id") - F.col("conv_id") % 5, keep, most=8, hot_rows=3), **sizes).collect()


def conversations(seed):
    rnd = random.Random(seed)
    out = []
    for c in [*range(40), -3, -7, 905, 1001]:
        if c in (10, 20):
            continue   # absent bases
        for t in range(rnd.randint(1, 6)):
            out.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "", None, "é"])))
    out += [(5, t, "user", "long") for t in range(90)] + [(6, t, "user", "long") for t in range(80)]          # long ones that share
    out += [(None, 0, "user", "nobody's"), (7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "user", "tie"), (8, 1, "user", "tie 2")]
    out += [(3000 + c, t, "user", f"copy {t}") for c in range(0, 60, 5) for t in range(3)]                      # a group of copies
    return out


@pytest.mark.parametrize("width, run", [(1 << 12, 4096), (64, 16), (2, 7)])
def test_trie_equals_a_plain_version(rows, width, run):
    data = conversations(width)
    got = run_trie(rows(CONV, *[(*r, "k", 1, "d", 2) for r in data]).repartition(5), width=width, run=run)
    assert Counter(tuple(r) for r in got) == Counter(plain_trie(rebuilt(data)))


def test_trie_edges(rows):
    assert run_trie(rows(CONV, *[(None, 0, "user", "x", "k", 1, "d", 2)])) == []
    one = run_trie(rows(CONV, (1, 0, None, None, "k", 1, "d", 2)))   # keeps no turn of its own or of an absent base
    assert [tuple(r) for r in one] == plain_trie(rebuilt([(1, 0, None, None)]))


def test_count_min_never_estimates_too_low(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    seen = rnd.integers(-2 ** 63, 2 ** 63 - 1, (300, 2))
    times = rnd.integers(1, 400, 300)
    data = [(int(a), int(b)) for (a, b), n in zip(seen, times) for _ in range(n)]
    for width in (64, 1 << 14):
        table = trie.count_min(spark.createDataFrame(data, "x1 long, x2 long").repartition(6), width)
        least = np.min([table[r][trie.cells(seen[:, 0].copy(), seen[:, 1].copy(), r, width)] for r in range(trie.ROWS)], axis=0)
        assert (least >= np.minimum(times, 255)).all()
    assert (least == np.minimum(times, 255)).mean() > 0.9   # a wide one is right for most


@pytest.mark.parametrize("piece", [1, 3, 8192])
def test_end_hashes_in_pieces(spark, piece):
    ends = spark.range(100).select((F.col("id") % 3).alias("x1"), F.lit(0).cast("long").alias("x2"), (F.col("id") * 7 % 100 - 50).alias("conv_id"))
    got = {r.x1: r.ends_sha256 for r in trie.end_hashes(ends, piece).collect()}
    for x in range(3):
        ids = sorted(i * 7 % 100 - 50 for i in range(100) if i % 3 == x)
        assert got[x] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# --- sharding ---------------------------------------------------------------------------

def plain_draw(good, total, draws, u):
    low, high = max(0, draws + good - total), min(draws, good)
    mode = max(low, min(high, (draws + 1) * (good + 1) // (total + 2)))
    left = u
    for k in [*range(mode, high + 1), *range(mode - 1, low - 1, -1)]:
        left -= math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        if left <= 0:
            return k
    return low


def test_hypergeometric_draws_invert_the_exact_distribution(spark):
    cases = [(g, n, d) for n in (1, 2, 7, 30, 300) for g in {0, 1, n // 3, n} for d in {0, 1, n // 2, n} if g <= n]
    df = spark.createDataFrame([(*c, u) for c in cases for u in (0.001, 0.1, 0.31, 0.5, 0.77, 0.999)], "g long, n long, d long, u double")
    for r in df.withColumn("x", shards.hypergeometric(F.col("g"), F.col("n"), F.col("d"), F.col("u"))).collect():
        assert r.x == plain_draw(r.g, r.n, r.d, r.u), r
    large = df.limit(1).select(shards.hypergeometric(F.lit(62_500_000), F.lit(10 ** 9), F.lit(1_000_000), F.lit(0.3)).alias("x")).first().x
    assert abs(large - 62_500) < 2_000


def test_matrix_margins(rows):
    got = shards.communication_matrix(rows("part long, n long", *[(i, 3 + i % 5) for i in range(70) if i != 9]), 6, fan=3).collect()
    assert {r.part: sum(r.counts) for r in got} == {i: 3 + i % 5 for i in range(70) if i != 9}
    columns = [sum(r.counts[s] for r in got) for s in range(6)]
    assert max(columns) - min(columns) <= 1 and min(c for r in got for c in r.counts) >= 0


def test_shards_are_uniform_exact_and_gapless(spark, docs):
    texts = [(i % 50 if i < 300 else i, None if i % 9 == 0 else "same" if i < 100 else f"é{i}") for i in range(500)] + EDGES + [(9, "x" * 100_000)]
    df = docs(*texts).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1)).repartition(6)
    got = shards.shuffle_into_shards(df, 7, seed=3, bucket_rows=20).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(texts)
    assert set(got[0].asDict()) == {*df.columns}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shards.shuffle_into_shards(df, 7, seed=4, bucket_rows=20).collect()
    assert [tuple(r) for r in got] != [tuple(r) for r in again]
    report = shards.shard_report(docs(*texts), 7, 3).collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in report} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in texts}
    assert shards.shard_report(docs(*texts).limit(0), 7, 3).collect() == [] and len(shards.shard_report(docs(*texts).limit(1), 7, 3).collect()) == 1


def test_shuffle_treats_all_rows_alike(spark):
    """Each row lands in each shard, and in the first half of its shard, about as often over many seeds."""
    df = spark.range(24).repartition(3).cache()
    n = 10
    hits, early = Counter(), Counter()
    for seed in range(n):
        for r in shards.shuffle_into_shards(df, 4, seed).collect():
            hits[r.id, r.shard] += 1
            early[r.id] += r.slot < 3
    chi = sum((hits[i, s] - n / 4) ** 2 / (n / 4) for i in range(24) for s in range(4))
    assert chi < 72 + 4 * (2 * 72) ** 0.5          # 72 degrees of freedom
    assert all(abs(early[i] - n / 2) < 5 * (n / 4) ** 0.5 for i in range(24))


def test_written_shards_keep_their_order(spark, tmp_path):
    df = spark.range(100).select("id", F.lit("t").alias("text"))
    dealt = shards.shuffle_into_shards(df, 3)
    rows = {(r.shard, r.slot): r.id for r in dealt.collect()}
    shards.write_shards(spark.createDataFrame([(i, s, n) for (s, n), i in rows.items()], "id long, shard int, slot long"), str(tmp_path / "out"), file_rows=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r.slot): r.id for r in back.collect()} == rows
    files = list((tmp_path / "out").rglob("*.parquet"))
    for f in files:
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        for stretch in {s // 10 for s in slots}:
            some = [s for s in slots if s // 10 == stretch]
            assert some == sorted(some)
