"""Importance resampling towards a target corpus, ranked by a distributed LSD radix sort.

A document's features are its runs of one to three words, hashed into buckets by
CRC-32.  Bucket counts of the corpus and of the target give each bucket a gain; a
document's weight is the sum of the gains of its features, looked up as an array, and
Gumbel noise from its id turns weights into a draw without replacement: the highest
scores are drawn.

The CRC of "a b" follows from the CRC of "a" by a linear map that depends on
the length of " b" alone, so the features of a batch are hashed with a few table lookups
per word, and only distinct words are hashed byte by byte.

Scores are ranked by counting sorts over the digits of the composite key (score
descending, id ascending), least digit first.  A pass counts digits per block of rows, turns the
counts into the place at which each digit of each block begins (prefix sums per digit over the
blocks, and over the digits' totals), and a row's destination is that place plus its
rank among the rows of its block and digit, in their order so far: a stable move.  The
destination after the last pass is the final rank.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import column, per_batch, shipped, store

BUCKETS = 10_000
LONGEST = 3
#: Rows whose digits are counted together, and bits of a digit: a pass sees BLOCK rows and at most 2**BITS counts per block.
BLOCK = 1 << 16
BITS = 11
#: Words of up to so many bytes are hashed by tables; longer ones by themselves.
SHORT = 40
#: Words that are taken through the tables at a time, and words whose CRCs a task remembers (then it starts anew).
STRETCH = 1 << 18
KNOWN = 500_000

#: Words are runs of digits, letters and anything beyond ASCII; all else parts them. A-Z become a-z.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def feature_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _shifts() -> np.ndarray:
    """``table[n, k, byte]``: what byte ``k`` of a CRC becomes after ``n`` more bytes (without those bytes' own share)."""
    table = np.zeros((SHORT + 2, 4, 256), np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the register's own table
    for n in range(1, len(table)):
        before = table[n - 1]
        table[n] = (before >> np.uint32(8)) ^ step[before & np.uint32(255)]
    return table


class Buckets:
    """Buckets of the features of texts; one object per task, as it remembers the CRCs of words."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest, self.shift = buckets, longest, _shifts()
        self._forget()

    def _forget(self):
        self.known, self.crc, self.spaced, self.size = {}, np.zeros(1024, np.uint32), np.zeros(1024, np.uint32), np.zeros(1024, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of the tables of CRCs, of the word and of the word behind a space, in which the words stand."""
        if len(self.known) > KNOWN:
            self._forget()
        for word in set(words) - self.known.keys():
            at = self.known[word] = len(self.known)
            if at == len(self.crc):
                self.crc, self.spaced, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.crc, self.spaced, self.size))
            self.crc[at], self.spaced[at], self.size[at] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _joined(self, crc: np.ndarray, spaced: np.ndarray, size: np.ndarray) -> np.ndarray:
        s = self.shift
        byte = lambda k: ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.intp)
        return s[size, 0, byte(0)] ^ s[size, 1, byte(1)] ^ s[size, 2, byte(2)] ^ s[size, 3, byte(3)] ^ spaced

    def of(self, texts: list[bytes | None]):
        """Yield (buckets, document index) arrays, one entry per feature, and at last the words of each text."""
        n_words = np.zeros(len(texts), np.int64)
        words, owner = [], []

        def stretch():
            at = self._numbers(words)
            crc, spaced, size = self.crc[at], self.spaced[at], self.size[at]
            doc = np.repeat(np.array([d for d, _ in owner], np.int64), [n for _, n in owner])
            yield crc % np.uint32(self.buckets), doc
            run = crc
            for n in range(1, self.longest):
                if len(words) <= n:
                    return
                same = doc[n:] == doc[:-n]
                tail, length = spaced[n:], size[n:]
                wide = np.flatnonzero(same & (length > SHORT + 1))
                run = self._joined(run[:-1], tail, np.minimum(length, SHORT + 1))
                for i in wide:
                    run[i] = zlib.crc32(b" ".join(words[i:i + n + 1]))
                yield run[same] % np.uint32(self.buckets), doc[n:][same]

        for d, text in enumerate(texts):
            some = feature_words(text)
            n_words[d] = len(some)
            for at in range(0, len(some), STRETCH):  # longer texts go in parts that share the words between them
                part = some[at:at + STRETCH]
                if at:  # features that begin before the cut and end behind it
                    yield self._across(some, at, d)
                words.extend(part)
                owner.append((d, len(part)))
                if len(words) >= STRETCH or at + STRETCH < len(some):
                    yield from stretch()
                    words, owner = [], []
        if words:
            yield from stretch()
        self.n_words = n_words

    def _across(self, some: list[bytes], at: int, doc: int):
        hashes = [zlib.crc32(b" ".join(some[i:i + n])) % self.buckets for n in range(2, self.longest + 1) for i in range(max(0, at - n + 1), at) if i + n <= len(some)]
        return np.array(hashes, np.uint32), np.full(len(hashes), doc, np.int64)


def bucket_counts(df: DataFrame, text_col: str = "text", *, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def make():
        at, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)

        def take(texts):
            nonlocal total
            for found, _ in at.of(texts):
                total += np.bincount(found, minlength=buckets)
            return ()

        return take, lambda: ((int(b), int(total[b])) for b in np.flatnonzero(total))

    counted = per_batch(df.select(column(text_col).cast("binary").alias("text")), "bucket int, n long", make)
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the source."""
    n, all_s, all_t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(map(float, source), map(float, target))], np.int64)


def weighted(df: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each document; a document without words weighs 0."""
    sent = shipped(df.sparkSession, gain)

    def make():
        gain = sent()
        at = Buckets(len(gain), longest)

        def take(ids, texts):
            weight, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for found, doc in at.of(texts):
                weight += np.bincount(doc, gain[found], len(ids)).astype(np.int64)  # whole numbers, exact in doubles
                n += np.bincount(doc, minlength=len(ids))
            yield from zip(ids, at.n_words.tolist(), n.tolist(), weight.tolist())

        return take

    rows = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary").alias("text"))
    return per_batch(rows, "doc_id long, n_words long, n_features long, weight long", make)


def gumbel(seed: int, key: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digit(key: str, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def radix_pass(df: DataFrame, digit: Column, block: int = BLOCK) -> DataFrame:
    """One stable counting sort: ``df`` with ``pos`` (unique) replaced by each row's place from 0 by (digit, pos)."""
    dealt = df.withColumn("_block", F.floor(F.col("pos") / block)).withColumn("_digit", digit)
    counts = store(dealt.groupBy("_block", "_digit").agg(F.count("*").alias("_n")), "digits")
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_digit", F.coalesce(F.sum("_all").over(ahead.orderBy("_digit")), F.lit(0)).alias("_base"))  # a row per digit
    blocks = ahead.partitionBy("_digit").orderBy("_block")
    begins = (counts.select("_block", "_digit", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_before")).join(F.broadcast(bases), "_digit")
              .select("_block", "_digit", (F.col("_base") + F.col("_before")).alias("_begin")))
    rank = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("pos"))
    placed = dealt.withColumn("_rank", rank).join(begins, ["_block", "_digit"])
    return placed.withColumn("pos", F.col("_begin") + F.col("_rank") - 1).select(*df.columns)


def radix_ranks(df: DataFrame, keys: list[str], *, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """``df`` with ``pos``, each row's place from 0 by ``keys`` ascending (longs without nulls, most significant first).

    Rows with equal keys take places one after another.  Digits in which no two rows differ are passed over, so the
    number of passes follows from the span of the keys.  Each pass reads files that the one before wrote.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    signed = [F.col(k).bitwiseXOR(F.lit(-(1 << 63))).alias(n) for k, n in zip(keys, names)]  # unsigned order
    rows = store(df.select("*", *signed, F.monotonically_increasing_id().alias("pos")), "unsorted")
    differ = rows.agg(*[F.bit_or(n).bitwiseXOR(F.bit_and(n)).alias(n) for n in names]).first()
    digits = []
    for name in reversed(names):
        span = ((differ[name] or 0) & ((1 << 64) - 1)).bit_length()
        digits += [(name, shift) for shift in range(0, span, bits) if (differ[name] >> shift) & ((1 << min(bits, span - shift)) - 1)]
    for name, shift in digits or [(names[0], 0)]:   # equal rows are numbered by one pass
        rows = store(radix_pass(rows, _digit(name, shift, bits), block), "sorted")
    return rows.drop(*names)


def draw(df: DataFrame, n: int, *, score: str = "score", key: str = "doc_id", block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """``df`` with the column rank: 1 to ``n`` for the rows with the highest scores, ties to the smaller key (null first), else null.

    Scores count into at most 2**16 steps first; rows under the step that holds the last drawn one can't be
    drawn and are not sorted.
    """
    df = store(df, "scores")
    low, high = df.agg(F.min(score), F.max(score)).first()
    if low is None or n <= 0:
        return df.withColumn("rank", F.lit(None).cast("long"))
    step = F.shiftright((F.lit(high) - F.col(score)).cast("long"), max(0, (high - low).bit_length() - 16))
    counts = dict(df.where(F.col(score).isNotNull()).groupBy(step.alias("step")).count().collect())  # 65,536 rows at most
    last, seen = 0, 0
    for last in sorted(counts):
        seen += counts[last]
        if seen >= n:
            break
    sorted_ = radix_ranks(df.where(step <= last).select("*", (F.lit(high) - F.col(score)).alias("_score"), F.coalesce(key, F.lit(-(1 << 63))).alias("_key")), ["_score", "_key"], block=block, bits=bits)
    ranked = sorted_.select(*df.columns, F.when(F.col("pos") < n, F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(df.where((step > last) | F.col(score).isNull()).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, seed: int = 42, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text",
                        target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every document; rank tells the drawn ones in order.

    Drawn are ``percent`` of the documents with at least ``least_words`` words, rounded down.  Null and empty texts
    have no features, weight 0 and are not drawn; other columns are not looked at.  A null id is hashed as an empty
    string and counts as the smallest.  Repeated rows are documents of their own; with equal ids they have
    equal noise and take ranks next to each other if their texts weigh the same.  Empty tables give no rows, or, as a target,
    gains that favour rare buckets.
    """
    source = bucket_counts(docs, text_col, buckets=buckets, longest=longest)
    wanted = bucket_counts(target, target_col, buckets=buckets, longest=longest)
    weights = weighted(docs, gains(source, wanted), id_col=id_col, text_col=text_col, longest=longest)
    scored = store(weights.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "weights")
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count() * percent // 100
    drawn = draw(scored.where(enough), n, block=block, bits=bits)
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, ranks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents themselves, whole rows, with their ``rank``; ids must be unique in ``docs``."""
    drawn = ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), "rank")
    return docs.drop("rank").join(drawn, column(id_col).eqNullSafe(F.col("_drawn"))).drop("_drawn")
