"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of lower-cased words.  Equal lines are found by a digest.  Two
lines that differ in one word (put in, left out or replaced) agree in all words
but one, so each line emits its variants with one word deleted as hashed keys and
equal variants meet; the edit distance is then verified on the words.  Deleting more at once comes first and
leaves few lines to ask: an edit leaves the front or the back half untouched, and
of eight blocks it touches one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import column, per_batch, per_row, pick, store, words

#: Lines with fewer words are compared for equality only.
LEAST_WORDS = 8

_U64 = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TAGS = {"replaced": 0x1F, "whole": 0x2E}


def _mix(x):
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def variants(line: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit keys (as rows of two) of the whole line, of each one-word deletion, and of each deletion with its place."""
    import xxhash

    n = len(line)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, line), _U64, n)
    whole, deleted, placed = [], [], []
    for odd in _ODD:
        power = np.cumprod(np.full(n, odd, _U64))
        sums = np.append(_U64(0), np.cumsum(_mix(h ^ _U64(odd)) * power))
        rest = sums[:-1] + (sums[-1] - sums[1:]) * _U64(pow(odd, -1, 1 << 64))
        whole.append(_mix(sums[-1:] + _U64(n)))
        deleted.append(_mix(rest + _U64(n - 1)))
        placed.append(_mix(rest * _U64(3) + np.arange(n, dtype=_U64) * _U64(_ODD[0]) + _U64(_TAGS["replaced"])))
    return np.stack(whole, 1).view(np.int64), np.stack(deleted, 1).view(np.int64), np.stack(placed, 1).view(np.int64)


def blocks(line: list[bytes], parts: int = 8) -> list[int]:
    """Keys of the line without one of ``parts`` blocks of words, in two roles: against lines of
    as many words or one more (``n``), and as the longer line against one word less (``n - 1``)."""
    import xxhash

    n = len(line)
    h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, line), _U64, n))
    power = np.cumprod(np.full(n + 1, _ODD[0], _U64))
    sums = np.append(_U64(0), np.cumsum(h * power[:n]))
    inverse = _U64(pow(_ODD[0], -1, 1 << 64))
    out = []
    for longer in (0, 1):
        size = n - longer
        step = -(-size // parts)
        for j, at in enumerate(range(0, size, step)):
            end = min(at + step, size) + longer
            tail = sums[n:] - sums[end:end + 1]
            for _ in range(longer):   # the words behind stand where those of the shorter line stand
                tail = tail * inverse
            out.append((sums[at:at + 1] * _U64(5) + tail * _U64(3) + power[j:j + 1] * _U64(7) + _U64(size << 1))[0])
    return _mix(np.array(out, _U64)).view(np.int64).tolist()


def within_one(a: list, b: list) -> bool:
    """Whether at most one word was put in, left out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _halves(line: list[bytes], least: int) -> list[int]:
    """Keys of the first and last ``p`` words; ``p``: half the power of two at or below the number of words.
    A power of two itself also emits those of the class below, which one word less would have."""
    import xxhash

    n = len(line)
    if n < least:
        return []
    p = 1 << (n.bit_length() - 2)
    out = []
    for p in (p, p // 2) if n == 2 * p and n > least else (p,):
        for side, part in enumerate((line[:p], line[-p:])):
            key = xxhash.xxh3_64_intdigest(b" ".join(part), seed=2 * p + side)
            out.append(key - (1 << 64) if key >> 63 else key)
    return out


def _described(docs: DataFrame, least: int) -> DataFrame:
    """A row per line with a word: ``doc_id, line, key, halves``."""
    def make():
        import xxhash

        def work(ids, texts):
            for i, text in zip(ids, texts):
                if i is None or not text:
                    continue
                for k, line in enumerate(text.split("\n")):
                    if found := words(line):
                        yield i, k, xxhash.xxh3_128_digest(b" ".join(found)), _halves(found, least)
        return work
    return per_batch(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line bigint, key binary, halves array<bigint>", make)


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, words`` for the lines ``wanted (doc_id, lines)``; a text's lines are looked up in its own document."""
    def make():
        import xxhash

        def work(ids, texts, lines):
            for text, some in zip(texts, lines):
                own = (text or "").split("\n")
                for k in some:
                    found = words(own[k]) if k < len(own) else []
                    yield xxhash.xxh3_128_digest(b" ".join(found)), found
        return work
    return per_batch(docs.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "lines"), "key binary, words array<binary>", make)


def _neighbours(lines: DataFrame) -> DataFrame:
    """Variants of ``lines (first, words)``: ``hi, lo, kind, first``; kind 0: the line as it is, 1: one word
    deleted, 2: one word deleted at a place that is part of the key."""
    place = lines.schema["first"].dataType.simpleString()

    def make():
        def work(firsts, all_words):
            for first, line in zip(firsts, all_words):
                for kind, keys in enumerate(variants(line)):
                    for hi, lo in np.unique(keys, axis=0).tolist():
                        yield hi, lo, kind, first
        return work
    return per_batch(lines.select("first", "words"), f"hi bigint, lo bigint, kind int, first {place}", make, 100)


def _in_blocks(lines: DataFrame) -> DataFrame:
    """``block, first`` for the block keys of ``lines (first, words)``."""
    place = lines.schema["first"].dataType.simpleString()

    def make():
        return lambda firsts, all_words: ((key, first) for first, line in zip(firsts, all_words) for key in set(blocks(line)))
    return per_batch(lines.select("first", "words"), f"block bigint, first {place}", make)


def duplicate_lines(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to remove: ``doc_id, line, first`` (``first``: document and line of the earliest equal or near line).

    A line (between ``\\n``, counted from 0) is removed when an earlier line, by
    ``doc_id`` and line, has the same words, or, with at least ``least_words`` words
    in both, all but one word put in, left out or replaced.  Words are compared with
    A-Z in lower case.  Lines without a word stay.  Null texts and rows with a null
    id have no lines here.  Rows that share an id share their line numbers: an equal
    line at the same place counts as the same line.  Other columns are ignored; an
    empty table gives an empty result.  Groups of equal keys are only aggregated and
    joined with their earliest line, never paired.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    lines = store(_described(docs, least_words), "lines")
    distinct = store(lines.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.min("halves").alias("halves"), F.count("*").alias("n")), "distinct")

    halves = distinct.select("key", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    near = halves.join(shared, "half").select("key").distinct()
    near = store(distinct.select("key", "first").join(near, "key"), "candidates")
    wanted = near.groupBy("first.doc_id").agg(F.collect_set("first.line").alias("lines"))  # lines of one document
    texts = _fetched(docs, wanted).dropDuplicates(["key"])
    near = store(near.join(texts, "key"), "words")
    keyed = store(_in_blocks(near), "blocks")
    shared = keyed.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select("block")
    close = keyed.join(shared, "block").select("first").distinct()
    near = store(near.join(close, "first"), "close")

    emitted = store(_neighbours(near), "variants")
    met = emitted.groupBy("hi", "lo").agg(
        F.count("*").alias("c"), F.min("first").alias("least"), F.min(F.when(F.col("kind") == 0, F.col("first"))).alias("spelt")).where("c > 1").drop("c")
    # Deletions at one place agree with each other; deletions wherever only with the whole line they spell.
    found = emitted.join(met, ["hi", "lo"]).withColumn("earlier", F.when(F.col("kind") == 1, F.col("spelt")).otherwise(F.col("least")))
    found = found.where("earlier < first").select("first", "earlier").distinct()
    other = near.select(F.col("first").alias("earlier"), F.col("words").alias("other"))
    place = near.schema["first"].dataType.simpleString()
    pairs = found.join(near, "first").join(other, "earlier").select("key", "earlier", "words", "other")
    verified = per_row(pairs, f"key binary, earlier {place}, near boolean", lambda: lambda key, earlier, a, b: (key, earlier, within_one(a, b)))
    earliest = verified.where("near").groupBy("key").agg(F.min("earlier").alias("earlier"))

    told = store(distinct.join(earliest, "key", "left").where("n > 1 OR earlier IS NOT NULL").select("key", "first", "earlier"), "verdicts")
    at = F.struct("doc_id", "line")
    out = lines.join(told, "key").where(F.col("earlier").isNotNull() | (at != F.col("first")))
    return out.select("doc_id", "line", F.coalesce("earlier", "first").alias("first"))


def without_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the ``removed`` lines (``doc_id, line``) cut from its texts; other columns stay as they are.

    Rows whose text had words and has none left are left out; null and blank texts stay.
    """
    lists = removed.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))  # lines of one document
    rows = df.select(F.struct(*[column(c) for c in df.columns]).alias("row"), column(id_col).alias("doc_id"), column(text_col).alias("text"))
    own = F.split("text", "\n")
    cut = F.transform(F.array(own), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1).cast("array<bigint>"), F.col("gone")), lambda k: F.get(x, k.cast("int"))), "\n"))[0]
    marked = rows.join(lists.hint("shuffle_hash"), "doc_id", "left").withColumn("cut", F.when(F.col("gone").isNotNull(), cut))
    left = marked.where(F.col("cut").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.coalesce("cut", "text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
