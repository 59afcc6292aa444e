"""Best approximate match of many names against a dictionary of names, without comparing all with all.

Two searches, each exact:

* :func:`closest_names` (Jaro-Winkler) has no lossless equality key, so it goes by bounds.
  The dictionary is sorted by first letter, length and letter counts and cut into cells of
  like entries; a directory keeps bounds on lengths, letter counts and the places of letters for parts of
  each cell.  A name visits the cell with the best bound first, and afterwards only those that can still beat
  what it found there.
* :func:`names_by_tokens` (token overlap, else edit distance) joins by equality: tokens, of which
  frequent ones are compared as sets of frequent tokens, not entry by entry; and, for names that no
  token answers, pieces of entries of which at least one must occur unchanged.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import code_points, jaro_winkler_rows, name_tokens
from .skew import HOT_ROWS, join_counted, kept, position

REVIEW_SCORE = 0.82
#: Rows of a cell of the index, cells of the directory at most (beyond, cells grow), names that meet a cell at a time.
CELL_ROWS = 512
MAX_CELLS = 65_536
BUCKET_ROWS = 5_000
CHUNK = 512
#: Classes of characters, places that a word of bits tells apart, pairs of names and cells or entries in an array.
CLASSES = 39
WORD = 64
PAIRS = 1 << 15
#: Names, or visits of names to cells, that are worth a task.
TASK_ROWS = 4_000
#: Parts of a cell with bounds of their own, letters that sort the dictionary.
CELL_PARTS = 32
SORT_LETTERS = 8
#: Entries that a token may have before it is treated as frequent.
TOKEN_ROWS = 1_000
#: Edits that still match, and the length of a name up to which the smaller number holds.
EDITS, MANY_EDITS, SHORT_NAME = 5, 8, 40
#: Letters by which texts are told apart before they are compared; digits count as one.
LETTERS = [*string.ascii_lowercase, string.digits, " "]
#: Entries that every name tries first, by lowest id; how blocks of further ones grow; pairs to a row of a hot key.
BRIEF_FIRST = 500
BLOCK_GROWTH = 4
PAIRS_A_ROW = 10


# --- closest name by Jaro-Winkler ------------------------------------------------------

def _classes(codes: np.ndarray) -> np.ndarray:
    """Characters hashed to classes; ASCII letters and digits have one each.  Shared classes can only raise a bound."""
    return codes % CLASSES


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """Characters of each class per row."""
    out = np.zeros((codes.shape[0], CLASSES), dtype=np.int32)
    for j in range(codes.shape[1]):
        used = np.flatnonzero(codes[:, j] >= 0)
        out[used, _classes(codes[used, j])] += 1
    return out


def _places(codes: np.ndarray) -> np.ndarray:
    """Per row and class a word with a bit for each place that holds the class; the last bit stands for all places from there on."""
    out = np.zeros((codes.shape[0], CLASSES), dtype=np.uint64)
    for j in range(codes.shape[1]):
        used = np.flatnonzero(codes[:, j] >= 0)
        out[used, _classes(codes[used, j])] |= np.uint64(1 << min(j, WORD - 1))
    return out


def _windows(la: int, lengths: np.ndarray) -> list[np.ndarray]:
    """Per place (of the first ``WORD``) of a text of ``la`` characters the places of texts of ``lengths`` that it can match, as bits."""
    reach, which = np.unique(np.maximum(np.maximum(la, lengths) // 2 - 1, 0), return_inverse=True)
    bits = lambda i, w: ((2 << min(WORD - 1, i + w)) - 1) & ~((1 << max(0, i - w)) - 1)
    table = [np.array([bits(i, int(w)) for w in reach], np.uint64) for i in range(min(la, WORD))]
    return table if len(reach) == 1 else [row[which] for row in table]


def score_bound(common, la, lb, prefix):
    """Most that Jaro-Winkler can be with so many letters in common, these lengths and this common prefix."""
    jaro = (common / la + common / np.maximum(lb, 1) + 1) / 3
    return np.where(common > 0, jaro + 0.1 * prefix * (1 - jaro), 0.0) + 1e-9


class Directory:
    """What the entries of a part of a cell, and of a whole cell, have at most: characters of each class, places that hold one, and lengths.

    Characters match only where they stand near one another, so a name has at most as many matches in a class as it has characters
    with a place of that class near them, nor more than any entry has.
    """

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["cell"])
        self.cell, self.start = np.unique(np.array([r["cell"] for r in rows], np.int64), return_index=True)
        self.end = np.append(self.start[1:], len(rows))
        table = lambda k, kind: np.ascontiguousarray(np.frombuffer(b"".join(bytes(r[k]) for r in rows), kind).reshape(-1, CLASSES).T)
        self.most, self.places = table("most", "<i4"), table("places", "<u8")
        self.windows: tuple = (None, [])
        self.few = np.minimum(self.most, 255).astype(np.uint8)
        self.low, self.high = (np.array([r[k] for r in rows], np.int64) for k in ("low", "high"))
        if len(rows):
            self.cell_most, self.cell_places = np.maximum.reduceat(self.most, self.start, axis=1), np.bitwise_or.reduceat(self.places, self.start, axis=1)
            self.cell_low, self.cell_high = np.minimum.reduceat(self.low, self.start), np.maximum.reduceat(self.high, self.start)

    @staticmethod
    def _bound(common, size, low, high, prefix):
        length = np.minimum(np.maximum(common, low), high)   # the length in the range that favours the name most
        return score_bound(np.minimum(common, np.minimum(length, size)), size, length, prefix)

    def cell_bounds(self, names: np.ndarray) -> np.ndarray:
        """Per name (a row of classes, all of one length) and cell."""
        size = names.shape[1]
        near, prefix = np.zeros((len(names), len(self.cell)), np.int32), np.zeros((len(names), len(self.cell)), np.int8)
        run = np.ones(near.shape, bool)
        for i, window in enumerate(_windows(size, self.cell_high)):
            held = self.cell_places[names[:, i]]
            if i < 4:
                run &= (held & np.uint64(1 << i)) != 0
                prefix += run
            held &= window
            near += held != 0
        near += max(0, size - WORD)
        counts, fit = _letter_counts(names), np.zeros(near.shape, np.int32)
        for c in np.flatnonzero(counts.any(axis=0)):
            fit += np.minimum(counts[:, c, None], self.cell_most[c])
        return self._bound(np.minimum(near, fit), size, self.cell_low, self.cell_high, prefix)

    def part_bounds(self, name: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of some cells, in order, and the bound of each for a name (its classes)."""
        if len(cells) == len(self.cell):
            some, own = np.arange(len(self.low)), slice(None)
        else:
            some = own = np.concatenate([np.arange(a, b) for a, b in zip(self.start[cells], self.end[cells])])
        size, high = len(name), self.high[own]
        if size != self.windows[0]:   # names come by their size
            self.windows = size, _windows(size, self.high)
        windows, held = [w if len(w) == 1 else w[own] for w in self.windows[1]], {}
        kind = np.uint8 if size <= WORD else np.int32   # of numbers of characters, none above the size
        common, later = np.zeros(len(some), kind), np.bincount(name[WORD:], minlength=CLASSES).astype(kind)
        for c in np.unique(name):
            row = held[c] = self.places[c][own]
            near = np.full(len(some), later[c])
            for i in np.flatnonzero(name[:WORD] == c):
                near += ((row & windows[i]) != 0).view(np.uint8)
            common += np.minimum(near, (self.few if kind is np.uint8 else self.most)[c][own])
        run, prefix = np.ones(len(some), bool), np.zeros(len(some), np.uint8)
        for i, c in enumerate(name[:4]):
            run &= (held[c] & np.uint64(1 << i)) != 0
            prefix += run.view(np.uint8)
        return some, self._bound(common, size, self.low[own], high, prefix)

    def likeliest(self, name: np.ndarray, parts: np.ndarray, bound: np.ndarray) -> int:
        """Of the parts with the best bound the one that holds most characters of the name at their own place."""
        best = parts[bound == bound.max()]
        at = name[:WORD]
        alike = (self.places[at[:, None], best] >> np.arange(len(at), dtype=np.uint64)[:, None]) & np.uint64(1)
        return int(best[np.argmax(alike.sum(axis=0))])


class Matcher:
    """Texts of at most ``WORD`` characters, met by many names at once: a word per text and character tells the places that hold it."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes[:, :WORD], lengths
        self.alphabet, at = np.unique(self.codes, return_inverse=True)
        at, n = at.reshape(self.codes.shape), np.arange(len(lengths))
        self.held = np.zeros((len(self.alphabet) + 1, len(lengths)), np.uint64)   # the last row: characters of no text
        for j in range(self.codes.shape[1]):
            self.held[at[:, j], n] |= np.uint64(1 << j)
        if self.alphabet[0] == -1:
            self.held[0] = 0

    def _letters(self, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, names), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == names, at, len(self.alphabet))

    def bounds(self, names: np.ndarray) -> np.ndarray:
        """Per name (a row of code points, all of one length) and text the score they would have if no matches were swapped."""
        letters, size = self._letters(names), names.shape[1]
        used, matches, low = np.zeros((len(names), len(self.lengths)), np.uint64), np.zeros((len(names), len(self.lengths)), np.uint8), None
        for i, window in enumerate(_windows(size, self.lengths)):
            low = self.held[letters[:, i]]
            low &= window
            low &= ~used
            low &= -low   # the first place that is near and free
            used |= low
            matches += low != 0
        run, prefix = np.ones(used.shape, bool), np.zeros(used.shape, np.int8)
        for i in range(min(4, size, self.codes.shape[1])):
            run &= self.codes[:, i] == names[:, i:i + 1]
            prefix += run
        return score_bound(matches, size, self.lengths, prefix)

    def scores(self, names: np.ndarray, row: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Jaro-Winkler of pairs, as :func:`jaro_winkler_rows` has it, to nine digits."""
        letters, size, lengths = self._letters(names)[row], names.shape[1], self.lengths[text]
        used, hits = np.zeros(len(row), np.uint64), []
        for i, window in enumerate(_windows(size, lengths)):
            low = self.held[letters[:, i], text] & window & ~used
            low &= -low
            used |= low
            hits.append(low != 0)
        matches, swapped = np.sum(hits, axis=0), np.zeros(len(row), np.int64)
        for i, hit in enumerate(hits):
            low = np.where(hit, used & -used, np.uint64(0))
            used ^= low
            swapped += hit & ((self.held[letters[:, i], text] & low) == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(matches > 0, (matches / size + matches / lengths + (matches - swapped / 2) / matches) / 3, 0.0)
        width = min(4, size, self.codes.shape[1])
        prefix = np.cumprod(self.codes[text, :width] == names[row, :width], axis=1).sum(axis=1)
        return np.round(jaro + prefix * 0.1 * (1 - jaro), 9)

    def best(self, names: np.ndarray, least: np.ndarray):
        """(row of the name, row of the text, score) of the best text per name, the first on ties, where it reaches ``least``."""
        step = max(1, PAIRS // max(1, len(self.lengths)))
        for start in range(0, len(names), step):
            some = names[start:start + step]
            bound, every = self.bounds(some), np.arange(len(some))
            wanted = np.maximum(least[start:start + step], self.scores(some, every, bound.argmax(axis=1)))
            row, text = np.nonzero(bound >= wanted[:, None])
            score = np.concatenate([self.scores(some, row[i:i + PAIRS], text[i:i + PAIRS]) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
            order = np.lexsort((text, -score, row))
            row, text, score = row[order], text[order], score[order]
            first = np.unique(row, return_index=True)[1]
            yield from ((start + int(row[i]), int(text[i]), float(score[i])) for i in first if score[i] >= wanted[row[i]])


def _best_of_long(a: np.ndarray, least: float, codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray, same: np.ndarray) -> tuple[float, int]:
    """Best score and its row (the first on ties; -1 if none) of one text among others, for texts of any length."""
    la = len(a)
    common = np.minimum(counts, np.bincount(_classes(a), minlength=CLASSES)).sum(axis=1)[same]
    width = min(4, la, codes.shape[1])
    prefix = np.cumprod(codes[:, :width] == a[:width], axis=1).sum(axis=1)
    bound = score_bound(common, la, lengths, prefix)
    live = np.flatnonzero(bound >= least)
    live = live[np.argsort(-bound[live], kind="stable")]
    best, best_row = 0.0, -1
    for start in range(0, len(live), CHUNK):
        part = live[start:start + CHUNK]
        if bound[part[0]] < best:
            break
        tiled = np.repeat(a[None, :], len(part), axis=0)
        score = np.round(jaro_winkler_rows(tiled, np.full(len(part), la), codes[part], lengths[part]), 9)
        top = score.max()
        row = int(part[score == top].min())
        if top > best or (top == best and row < best_row):
            best, best_row = float(top), row
    return best, best_row


def _closest(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Per name the entry of highest Jaro-Winkler score (lowest id on ties), if at least ``score``, what the name has so far."""
    found: dict = {}

    def offer(i: int, score: float, row: int) -> None:
        if (score, -row) > found.get(i, (0.0, 0)):
            found[i] = score, -row

    names, least = asked["name"].tolist(), asked["score"].to_numpy()
    if names and len(entries):
        entries = entries.sort_values("id", ignore_index=True)
        texts = entries["entry"].tolist()
        sizes, name_sizes = np.array([len(t) for t in texts]), np.array([len(n) for n in names])
        brief, wide = np.flatnonzero(sizes <= WORD), np.flatnonzero(sizes > WORD)
        if len(brief):
            matcher = Matcher(*code_points([texts[i] for i in brief]))
            for size in np.unique(name_sizes[name_sizes <= WORD]):
                at = np.flatnonzero(name_sizes == size)
                for i, row, score in matcher.best(code_points([names[i] for i in at])[0], least[at]):
                    offer(int(at[i]), score, int(brief[row]))
        for rows, met in ((wide, np.arange(len(names))), (brief, np.flatnonzero(name_sizes > WORD))):
            if len(rows) and len(met):
                codes, lengths = code_points([texts[i] for i in rows])
                counts, same = np.unique(_letter_counts(codes), axis=0, return_inverse=True)
                for i in met:
                    score, row = _best_of_long(np.frombuffer(names[i].encode("utf-32-le"), "<i4"), least[i], codes, lengths, counts, same)
                    if score >= least[i]:
                        offer(int(i), score, int(rows[row]))
    return pd.DataFrame([(names[i], entries["id"].iat[-row], score) for i, (score, row) in found.items()], columns=["name", "id", "score"])


def name_index(entries: DataFrame, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> tuple[DataFrame, Directory]:
    """Entries (unique id, distinct entry) with their cell, stored, and the directory of cells (at most ``max_cells``)."""
    # Neighbours in this order have first letter, length and most letters alike; the letters whose counts differ most come first.
    count = lambda x: F.length("entry") - F.length(F.translate("entry", x, ""))
    letters = string.ascii_lowercase + string.digits

    def sums(parts):
        for part in parts:
            texts = part["entry"].tolist()
            each = np.array([[t.count(x) for t in texts] for x in letters], np.int64)
            yield pd.DataFrame({"x": list(letters), "n": each.shape[1], "s": each.sum(axis=1), "q": (each ** 2).sum(axis=1)})

    sums_ = entries.select("entry").mapInPandas(sums, "x string, n long, s long, q long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = {x: 0.0 for x in letters} | {r["x"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in sums_.collect()}
    used = sorted(letters, key=lambda x: (-round(spread[x], 6), x))[:SORT_LETTERS]
    like = [F.ascii("entry"), F.floor(4 * F.log2(F.length("entry"))), *[count(x) for x in used]]
    sorted_ = position(entries.withColumns({f"_l{i}": c for i, c in enumerate(like)}), [], [*[f"_l{i}" for i in range(len(like))], "id"], "_n")
    n = sorted_.count()
    rows = max(cell_rows, -(-n // max_cells))
    part_rows = max(-(-rows // CELL_PARTS), -(-n // max_cells))
    at = F.col("_n") - 1
    cells = kept(sorted_.select("id", "entry", F.floor(at / rows).alias("cell"), F.floor(at % rows / part_rows).alias("part")), "cells")

    def bounds(part: pd.DataFrame) -> pd.DataFrame:
        codes, lengths = code_points(part["entry"].tolist())
        most, places = _letter_counts(codes), _places(codes)
        of = [np.flatnonzero(part["part"] == p) for p in np.unique(part["part"])]
        return pd.DataFrame({"cell": part["cell"].iloc[0], "most": [most[p].max(axis=0).astype("<i4").tobytes() for p in of],
                             "places": [np.bitwise_or.reduce(places[p], axis=0).astype("<u8").tobytes() for p in of],
                             "low": [lengths[p].min() for p in of], "high": [lengths[p].max() for p in of]})

    dealt = cells.repartition(_tasks(cells, n), "cell")
    return cells.drop("part"), Directory(dealt.groupBy("cell").applyInPandas(bounds, "cell long, most binary, places binary, low long, high long").collect())


def _tasks(df: DataFrame, n: int | None = None) -> int:
    """Tasks for rows that are few in bytes and heavy in work; not so many for ``n`` rows that starting them takes longer."""
    most, cores = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism
    return most if n is None else min(most, max(2 * cores, -(-n // TASK_ROWS)))


def visits(names: DataFrame, directory: Directory, best: bool) -> DataFrame:
    """(name, cell, score) to look at: the cell of the best bound, or all cells that can beat or equal the ``score`` given with a name, but for
    the ``cell`` given with it, if any.  ``score`` is the least that counts."""
    from pyspark import cloudpickle

    sent = names.sparkSession.sparkContext.broadcast(cloudpickle.dumps(directory))   # with its class

    def run(parts):
        d = cloudpickle.loads(sent.value)
        for part in parts:
            texts, out = part["name"].tolist(), []
            n = len(texts)
            least = np.full(n, REVIEW_SCORE) if best else np.maximum(part["score"].to_numpy(), REVIEW_SCORE)
            but = part["cell"].to_numpy() if "cell" in part else np.full(n, -1)
            sizes = np.array([len(t) for t in texts], np.int64)
            step = max(1, PAIRS // max(1, len(d.cell)))
            for size in np.unique(sizes) if len(d.cell) else []:
                own = np.flatnonzero(sizes == size)
                for some in (own[i:i + step] for i in range(0, len(own), step)):
                    classes = _classes(code_points([texts[i] for i in some])[0])
                    for i, name, bound in zip(some, classes, d.cell_bounds(classes)):
                        near = np.flatnonzero((bound >= least[i]) & (d.cell != but[i]))
                        if not len(near):
                            continue
                        at, bound = d.part_bounds(name, near)
                        at, bound = at[bound >= least[i]], bound[bound >= least[i]]
                        at = np.array([d.likeliest(name, at, bound)]) if best and len(at) else at
                        hit = np.unique(np.searchsorted(d.start, at, "right") - 1)
                        out += [(texts[i], int(d.cell[h]), float(least[i])) for h in hit]
            yield pd.DataFrame(out, columns=["name", "cell", "score"])

    return names.repartition(_tasks(names, names.count()), "name").mapInPandas(run, "name string, cell long, score double")


def _scored(asked: DataFrame, cells: DataFrame, id_type: str, tasks: int | None, bucket_rows: int) -> DataFrame:
    """(name, id, score) for (name, cell, score) rows.  A cell asked by many names is met by buckets of them, each with the cell's rows."""
    per_cell = asked.groupBy("cell").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("_parts"))
    right = cells.join(per_cell, "cell").withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    left = asked.join(per_cell, "cell").withColumn("_bucket", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int")).drop("_parts")
    tasks = tasks or _tasks(asked, asked.count())
    keys = ["cell", "_bucket"]
    # Cells are small in bytes and heavy in work: their tasks are set here, not merged by size.
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _closest(a, b), f"name string, id {id_type}, score double")


def closest_names(names: DataFrame, entries: DataFrame, id_type: str = "long", shard_rows: int = CELL_ROWS,
                  cells: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """JN-15: (name, id, score) for every name with a match of at least the review score; lowest id on equal scores.

    Equal names score 1 and are found by an equality join; only the others are searched.
    ``shard_rows`` is the size of a cell of the index, ``cells`` the number of scoring tasks.
    """
    names = names.where(F.col("name") != "").distinct()
    entries = entries.where(F.col("entry") != "")
    by_entry = entries.groupBy(F.col("entry").alias("name")).agg(F.min("id").alias("id"))
    by_entry = kept(by_entry.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name"), "entries")
    equal = names.join(by_entry, "name").withColumn("score", F.lit(1.0))
    rest = kept(names.join(by_entry.select("name"), "name", "left_anti"), "names")
    index, directory = name_index(by_entry.select("id", F.col("name").alias("entry")), shard_rows)
    merged = lambda df: df.groupBy("name").agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"))
    asked = kept(visits(rest, directory, True), "visits")
    first = kept(_scored(asked, index, id_type, cells, bucket_rows), "first")
    # a name without a first visit has no cell that reaches the review score
    open_names = asked.select("name", "cell").join(first.select("name", "score"), "name", "left").select("name", "cell", F.coalesce("score", F.lit(0.0)).alias("score"))
    later = _scored(kept(visits(open_names, directory, False), "visits"), index, id_type, cells, bucket_rows)
    return equal.unionByName(merged(first.unionByName(later)))


# --- tokens, else edits --------------------------------------------------------------------

def _token_sets(df: DataFrame, text: str, *more: Column) -> DataFrame:
    """Distinct token sets (``key``, sorted ``tokens``, size ``n``) of a column, with aggregates ``more``; texts without tokens have none."""
    tokens = F.array_sort(name_tokens(F.col(text)))
    sets = df.withColumn("tokens", tokens).where(F.size("tokens") > 0).withColumn("key", F.md5(F.array_join("tokens", " ")))
    return sets.groupBy("key").agg(F.first("tokens").alias("tokens"), *more).withColumn("n", F.size("tokens"))


def _ordered(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """A row per token of each set: ``at``, its place from 1 with rare tokens first, and ``rows``, its entries if it is frequent (else 0).

    A set of n tokens that shares at least half of them shares one of its first n - ceil(n / 2) + 1.
    """
    each = sets.select("key", "n", F.explode("tokens").alias("token")).join(F.broadcast(frequent), "token", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    lists = each.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("rows", "token"))).alias("l"))
    return lists.select("key", "n", F.posexplode("l").alias("at", "t")).select("key", "n", (F.col("at") + 1).alias("at"), "t.*")


def _leading(n: Column) -> Column:
    return n - F.ceil(n / 2) + 1


def _half(pairs: DataFrame, a: str, b: str, na: str, nb: str) -> DataFrame:
    overlap = F.size(F.array_intersect(a, b)) / F.least(na, nb)
    return pairs.withColumn("overlap", overlap).where("overlap >= 0.5")


def token_candidates(asked: DataFrame, given: DataFrame, hot_rows: int) -> DataFrame:
    """(name, entry) keys of sets that may share half of the smaller one, by rare tokens; see :func:`_ordered`."""
    rare = lambda df, kind: df.where("rows = 0").select("token", F.col("key").alias(kind), F.col("n").alias(f"{kind}_n"), (F.col("at") <= _leading(F.col("n"))).alias(f"{kind}_leads"))
    left, right = rare(asked, "name"), rare(given, "entry")
    counts = left.groupBy("token").agg(F.count("*").alias("n"))
    met = join_counted(left, right, ["token"], counts, "name", hot_rows)   # a rare token has few entries, but any number of names
    smaller = F.when(F.col("name_n") <= F.col("entry_n"), F.col("name_leads")).otherwise(F.col("entry_leads"))
    return met.where(F.col("entry").isNotNull() & smaller).select("name", "entry").distinct()


def _by_frequent(asked: DataFrame, given: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, overlap, id) over pairs that share frequent tokens only.

    Such a pair's overlap depends on the frequent tokens and the sizes, so both sides are reduced to those first; the lowest
    id stands for all entries alike.  Pairs that share rare tokens too are rated too low here and rightly elsewhere.
    """
    def reduced(df):
        own = df.where("rows > 0").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("rows", "token"))).alias("l"))
        return own.withColumn("hot", F.col("l.token")).withColumn("group", F.md5(F.concat_ws(" ", "n", F.array_join("hot", " "))))

    names, entries = reduced(asked), reduced(given).join(ids, "key")
    name_groups = names.groupBy("group").agg(F.first("hot").alias("hot"), F.first("n").alias("n"))
    entry_groups = entries.groupBy("group").agg(F.first("hot").alias("hot"), F.first("n").alias("n"), F.min("id").alias("id"))
    leads = F.size("hot") - F.ceil(F.col("n") / 2) + 1   # of the frequent ones, which come last in the order
    tokens = lambda df, kind, *more: df.select(F.col("group").alias(kind), F.col("hot").alias(f"{kind}_hot"), F.col("n").alias(f"{kind}_n"), *more,
                                               leads.alias("_leads"), F.posexplode("hot").alias("_at", "token")).withColumn(f"{kind}_leads", F.col("_at") < F.col("_leads")).drop("_at", "_leads")
    smaller = F.when(F.col("name_n") <= F.col("entry_n"), F.col("name_leads")).otherwise(F.col("entry_leads"))
    pairs = tokens(name_groups, "name").join(tokens(entry_groups, "entry", "id"), "token").where(smaller)
    best = _best(_half(pairs, "name_hot", "entry_hot", "name_n", "entry_n").withColumnRenamed("name", "group"), "group")
    return names.select("key", "group").join(best, "group").select("key", "overlap", "id")


def _best(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.max("overlap").alias("overlap"), F.min_by("id", F.struct(-F.col("overlap"), "id")).alias("id"))


def by_overlap(names: DataFrame, entries: DataFrame, token_rows: int = TOKEN_ROWS, tasks: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(name, id, overlap) for names that share at least half of the smaller token set with an entry: highest overlap, lowest id."""
    asked, given = kept(_token_sets(names, "name"), "asked"), kept(_token_sets(entries, "entry", F.min("id").alias("id")), "given")
    # frequent: met by many pairs; at most (tokens of names and dictionary) / token_rows rows
    uses = lambda df, c: df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias(c))
    both = uses(given, "rows").join(uses(asked, "asked"), "token", "left")
    frequent = both.where((F.col("rows") > token_rows) | (F.col("rows") * F.col("asked") > token_rows ** 2)).select("token", "rows")
    frequent = kept(frequent, "frequent")
    asked_tokens, given_tokens = kept(_ordered(asked, frequent), "asked_tokens"), kept(_ordered(given, frequent), "given_tokens")
    pairs = kept(token_candidates(asked_tokens, given_tokens, hot_rows), "pairs")
    pairs = pairs.repartition(tasks, "name") if tasks else pairs
    left = pairs.join(asked.select(F.col("key").alias("name"), F.col("tokens").alias("a"), F.col("n").alias("na")), "name")
    right = given.select(F.col("key").alias("entry"), F.col("tokens").alias("b"), F.col("n").alias("nb"), "id")
    both = join_counted(left, right, ["entry"], pairs.groupBy("entry").agg(F.count("*").alias("n")), "name", hot_rows)
    rare = _half(both, "a", "b", "na", "nb").select(F.col("name").alias("key"), "overlap", "id")
    best = _best(rare.unionByName(_by_frequent(asked_tokens, given_tokens, given.select("key", "id"))), "key")
    keyed = names.withColumn("key", F.md5(F.array_join(F.array_sort(name_tokens(F.col("name"))), " ")))
    return keyed.join(best, "key").select("name", "id", "overlap")


def _letters(c: str) -> Column:
    """How often each of ``LETTERS`` is in a text, and how many other characters; beyond 127 counts as 127, which brings texts closer at most."""
    n = [F.length(c) - F.length(F.translate(c, x, "")) for x in LETTERS]
    return F.array(*[F.least(x, F.lit(127)).cast("byte") for x in [*n, F.length(c) - sum(n, F.lit(0))]])


def _pieces(df: DataFrame, edits: int, length: Column, *more: str) -> DataFrame:
    """A row per piece (``i``, start ``at`` from 0, ``size``) of texts of ``length``, cut evenly into ``edits`` + 1 pieces, the longer ones last."""
    k = edits + 1
    cut = df.withColumn("_l", length.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    base, wide = F.floor(F.col("_l") / k).cast("int"), F.lit(k) - F.col("_l") % k
    return cut.withColumn("at", F.col("i") * base + F.greatest(F.lit(0), F.col("i") - wide)).withColumn("size", base + (F.col("i") >= wide).cast("int"))


def _edit_groups(names: DataFrame, entries: DataFrame, edits: int, hot_rows: int, key) -> tuple[DataFrame, DataFrame]:
    """Names and entries, as their ``key``, by what they can meet at: (piece, b, name) and (piece, b, entry), ``b`` being the entry's letters.

    A pair within ``edits`` shares such a row: one of the entry's ``edits`` + 1 pieces occurs in the name.
    A piece is looked for only where it can stand: not shifted by more than the edits before it and behind it
    allow.  Entries of ``edits`` characters or fewer have no pieces; they are met by single characters.
    Texts with the same piece and letters first stand for one another, so that pieces which many texts share
    meet once, and only where the letters differ by so few edits.
    """
    names = names.select("name", _letters("name").alias("letters"))
    entries = entries.select("entry", _letters("entry").alias("letters"))
    lengths = F.broadcast(entries.select(F.length("entry").alias("_len")).distinct())   # few: texts are short or of like length
    long_ = entries.where(F.length("entry") > edits)
    given = _pieces(long_, edits, F.length("entry")).select(key("entry").alias("entry"), "letters", F.xxhash64("_l", "i", F.expr("substring(entry, at + 1, size)")).alias("piece"))
    m = F.length("name")
    ranged = names.withColumn("_len", F.explode(F.sequence(F.greatest(m - edits, F.lit(edits + 1)), m + edits))).where(m > 0) if edits else names.withColumn("_len", m)
    cut = _pieces(ranged.where(F.col("_len") <= m + edits).join(lengths, "_len", "left_semi"), edits, F.col("_len"))
    shift = m - F.col("_len")
    low = F.greatest(F.col("at") - F.col("i"), F.col("at") + shift - (F.lit(edits) - F.col("i")), F.lit(0))
    high = F.least(F.col("at") + F.col("i"), F.col("at") + shift + (F.lit(edits) - F.col("i")), m - F.col("size"))
    cut = cut.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_at", F.explode(F.sequence("_low", "_high")))
    asked = cut.select(key("name").alias("name"), "letters", F.xxhash64("_l", "i", F.expr("substring(name, _at + 1, size)")).alias("piece"))
    brief = entries.where(F.length("entry").between(1, edits))
    single = lambda c: F.array_distinct(F.split(c, ""))
    given = given.unionByName(brief.select(key("entry").alias("entry"), "letters", F.explode(single("entry")).alias("c"), F.length("entry").alias("l")).select("entry", "letters", F.xxhash64("l", "c").alias("piece")))
    near = names.where((m > edits) & (m <= 2 * edits)).withColumn("l", F.explode(F.sequence(m - edits, F.lit(edits))))
    asked = asked.unionByName(near.select(key("name").alias("name"), "letters", "l", F.explode(single("name")).alias("c")).select("name", "letters", F.xxhash64("l", "c").alias("piece")))
    given = kept(given.distinct(), "given_pieces")
    # most pieces of most names are in no entry
    asked = kept(asked.join(given.select("piece").distinct(), "piece", "left_semi").select("name", "letters", "piece").distinct(), "asked_pieces")
    kinds = lambda df, c: df.select("piece", F.col("letters").alias(c)).distinct()
    left, right = kinds(asked, "a"), kinds(given, "b")
    met = join_counted(left, right, ["piece"], left.groupBy("piece").agg(F.count("*").alias("n")), "a", hot_rows)
    more = lambda x, y: sum(F.greatest(F.get(x, F.lit(i)) - F.get(y, F.lit(i)), F.lit(0)) for i in range(len(LETTERS) + 1))
    few = F.greatest(more("a", "b"), more("b", "a")) <= edits   # each edit takes one letter away, adds one, or both
    met = kept(met.where(F.col("b").isNotNull() & few), "pieces")
    some = asked.withColumnRenamed("letters", "a")
    counts = some.groupBy("piece", "a").agg(F.count("*").alias("n"))
    found = join_counted(some, met, ["piece", "a"], counts, "name", hot_rows).where(F.col("b").isNotNull()).select("piece", "b", "name")
    return kept(found, "found"), given.withColumnRenamed("letters", "b")


def edit_candidates(names: DataFrame, entries: DataFrame, edits: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(name, entry) pairs, as their MD5, that can be within ``edits``; see :func:`_edit_groups`."""
    found, given = _edit_groups(names, entries, edits, hot_rows, F.md5)
    counts = found.groupBy("piece", "b").agg(F.count("*").alias("n"))
    pairs = join_counted(found, given, ["piece", "b"], counts, "name", hot_rows)
    return pairs.where(F.col("entry").isNotNull()).select("name", "entry").distinct()


def _first_within(names: DataFrame, entries: DataFrame, n: int, edits: int, first: int, hot_rows: int) -> DataFrame:
    """(name, at) for ``names`` within ``edits`` of one of the ``n`` entries (numbered ``at``) but the first ``first``: the lowest of these.

    Entries come in blocks that grow by ``BLOCK_GROWTH``, in order, and a name that found one asks no further.  So names that
    are near to many entries try few, and for the others there are few pairs.  Pairs are verified where they meet: none are
    moved or written.
    """
    found, given = _edit_groups(names, entries.where(F.col("at") > first), edits, hot_rows, F.xxhash64)
    keyed = lambda df, c, *more: df.select(F.xxhash64(c).alias("_k"), F.col(c).alias(f"_{c}"), *more)
    asked = kept(found.join(keyed(names, "name"), found.name == F.col("_k")).select("piece", "b", "_name"), "asked_groups")
    answers, low = [], first
    while low < n and asked.take(1):
        high = max(low, 1) * BLOCK_GROWTH
        block = keyed(entries.where((F.col("at") > low) & (F.col("at") <= high)), "entry", "at")
        block = given.join(block, given.entry == F.col("_k")).select("piece", "b", "_entry", "at")
        # a key is hot by its pairs, of which a task takes PAIRS_A_ROW for each of the hot rows
        many = block.groupBy("piece", "b").agg(F.ceil(F.count("*") / PAIRS_A_ROW).alias("_m"))
        counts = asked.groupBy("piece", "b").agg(F.count("*").alias("n")).join(many, ["piece", "b"]).select("piece", "b", (F.col("n") * F.col("_m")).alias("n"))
        met = join_counted(asked, block, ["piece", "b"], counts, "_name", hot_rows)
        hit = F.col("_entry").isNotNull() & (F.levenshtein("_name", "_entry", edits) >= 0)
        answers.append(kept(met.where(hit).groupBy(F.col("_name").alias("name")).agg(F.min("at").alias("at")), "answers"))
        low = high
        if low < n:
            asked = kept(asked.join(answers[-1].select(F.col("name").alias("_name")), "_name", "left_anti").select("piece", "b", "_name"), "asked_groups")
    return reduce(DataFrame.unionByName, answers) if answers else names.select("name", F.lit(0).cast("long").alias("at")).limit(0)


def _sharing(names: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names and entries that share a token but less than half of the smaller set: three tokens or more, one of them known to the other side."""
    each = lambda df, c: df.select("*", F.explode(name_tokens(F.col(c))).alias("_t")).where(F.size(name_tokens(F.col(c))) >= 3)
    asked, given = each(names, "name"), each(entries, "entry")
    both = kept(asked.select("_t").distinct().join(given.select("_t").distinct(), "_t"), "shared_tokens")
    known = lambda df: df.join(both, "_t", "left_semi").drop("_t").distinct()
    return known(asked), known(given)


def within_edits(names: DataFrame, entries: DataFrame, brief_first: int = BRIEF_FIRST, hot_rows: int = HOT_ROWS, tasks: int | None = None) -> DataFrame:
    """(name, id, overlap) for names within the edit limit of an entry (5, or 8 for names over 40 characters): highest overlap, lowest id.

    ``names`` are those that :func:`by_overlap` left open, so nearly all pairs share no token and the lowest id decides.  Names may be close
    to very many entries: they try the entries with the lowest ids first, and only names that find none go on, see :func:`_first_within`.
    Pairs that share a token, less than half of three or more, win over those and are all compared.
    """
    m = F.length("name")
    limits = [(m <= SHORT_NAME, EDITS), (m > SHORT_NAME, MANY_EDITS)]
    numbered = kept(position(entries.select("id", "entry"), [], ["id", "entry"], "at"), "numbered")
    n = numbered.count()
    first = numbered.where(F.col("at") <= brief_first).agg(F.array_sort(F.collect_list(F.struct("at", "entry"))).alias("l")).scalar()
    near = lambda e: F.when(m <= SHORT_NAME, F.levenshtein(F.col("name"), e["entry"], EDITS)).otherwise(F.levenshtein(F.col("name"), e["entry"], MANY_EDITS)) >= 0
    spread = names.repartition(tasks or _tasks(names), "name")   # names are few in bytes and heavy in work
    tried = kept(spread.withColumn("_first", first).withColumn("at", F.get(F.filter("_first", near), F.lit(0))["at"]).drop("_first"), "tried")
    answers = [tried.where("at IS NOT NULL").select("name", "at")]
    # a name of at most EDITS characters is near every entry of at most EDITS, which needs no pairs
    tiny = numbered.where(F.length("entry") <= EDITS).agg(F.min("at")).scalar()
    answers.append(names.where(m <= EDITS).select("name", tiny.alias("at")).where("at IS NOT NULL"))
    open_names = tried.where("at IS NULL").select("name")
    answers += [_first_within(open_names.where(size), numbered, n, edits, brief_first, hot_rows) for size, edits in limits]
    lowest = reduce(DataFrame.unionByName, answers).groupBy("name").agg(F.min("at").alias("at"))
    hits = lowest.join(numbered.select("at", "id"), "at").select("name", "id", F.lit(0.0).alias("overlap"))

    asked, given = _sharing(names, entries.select("id", "entry"))
    asked, given = kept(asked, "sharing_names"), kept(given, "sharing_entries")
    if not asked.take(1):
        return hits.select("name", "id", "overlap")
    pairs = [edit_candidates(asked.where(size), given, edits, hot_rows) for size, edits in limits]
    pairs = kept(pairs[0].unionByName(pairs[1]), "edit_pairs")
    text = lambda df, c, *more: df.select(F.md5(c).alias("_k"), F.col(c).alias(f"_{c}"), *more)
    left = pairs.join(text(asked, "name").withColumnRenamed("_k", "name"), "name")
    both = join_counted(left, text(given, "entry", "id").withColumnRenamed("_k", "entry"), ["entry"], pairs.groupBy("entry").agg(F.count("*").alias("n")), "name", hot_rows)
    close = F.when(F.length("_name") <= SHORT_NAME, F.levenshtein("_name", "_entry", EDITS)).otherwise(F.levenshtein("_name", "_entry", MANY_EDITS)) >= 0
    x, y = name_tokens(F.col("_name")), name_tokens(F.col("_entry"))
    small = F.least(F.size(x), F.size(y))
    overlap = F.when(small > 0, F.size(F.array_intersect(x, y)) / small).otherwise(0.0)
    verified = both.where(close).select(F.col("_name").alias("name"), "id", overlap.alias("overlap"))
    return _best(hits.unionByName(verified), "name").select("name", "id", "overlap")


def names_by_tokens(names: DataFrame, entries: DataFrame, id_type: str = "long", shard_rows: int = TOKEN_ROWS, cells: int | None = None) -> DataFrame:
    """JN-16 search: (name, id, overlap), highest overlap, then lowest id.

    An entry matches if it shares half of the smaller token set or is within the edit limit.  An overlap
    of a half beats any edit match, so only names without one are compared by edits.  ``shard_rows``: entries from which a
    token counts as frequent; ``cells``: tasks that verify pairs.
    """
    names = kept(names.where(F.col("name").isNotNull()).distinct(), "names")
    entries = kept(entries.where(F.col("entry").isNotNull()).groupBy("entry").agg(F.min("id").alias("id")), "entries")
    shared = kept(by_overlap(names, entries, shard_rows, cells), "shared")
    rest = kept(names.join(shared.select("name"), "name", "left_anti"), "rest")
    return shared.unionByName(within_edits(rest, entries, tasks=cells))
