"""Quality rules: fixed rules on counts, then robust multivariate outliers.

Everything here is DataFrame functions.  Per language and source a
minimum-covariance-determinant estimate (centre and covariance of the most
concentrated three quarters, found by concentration steps) tells how far a
document's transformed statistics lie from the bulk, as a Mahalanobis distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, pick, store

WINDOW = 8
#: Share of a group's rows that its estimate rests on, concentration steps, rows that a group needs for an estimate of its own.
SHARE, STEPS, LEAST_ROWS = 0.75, 3, 200
#: Squared distance beyond which a document is rejected: a chi-squared value with four degrees of freedom exceeds it about once in 10 million.
LIMIT = 38.0
#: Least standard deviation of each transformed statistic, so that a statistic that hardly varies can't reject alone over trifles.
FLOORS = (0.5, 0.08, 0.6, 0.12)
DIM = len(FLOORS)
#: The covariance of the inner three quarters of a normal sample in four dimensions, times this, is that of the whole.
SPREAD = 1.5
#: Distances and statistics are ranked by bins, so that quantiles are sums of counts; bins per unit.
BINS = 32


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of eight that occurs twice or more."""
    def found(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        at = let(placed, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])), lambda x: x["i"])))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(
            i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), found(g)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    blanks = F.lit(BLANKS)
    trimmed = F.trim(text, blanks)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, blanks) != "")
    per_word = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    per_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols")
    return F.struct(per_word.alias("w"), per_line.alias("l"), symbols)


def transformed() -> list[Column]:
    """Log length; log mean word length, drawn to 5 for short texts; log share of symbols; root of the repeated share.
    In thousandths, as integers: their sums don't depend on the order of the rows."""
    n, chars = F.col("n_words"), F.col("word_chars")
    raw = [F.log1p(n), F.log((chars + 500) / (n + 100)), F.log1p(1000 * F.col("n_symbols") / (chars + 200)),
           F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / (n + 20))]
    return [F.round(1000 * x).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


#: Groups whose estimates are sent to all executors (some 20 numbers each).
SENT_GROUPS = 100_000
X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _levels(stats: DataFrame) -> DataFrame:
    """Each row under its own group, its language and all, by ``g``."""
    part = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    keys = [F.concat_ws("\x1f", F.lit("0"), part("lang"), part("source")), F.concat_ws("\x1f", F.lit("1"), part("lang")), F.lit("2")]
    return stats.withColumns({f"g{i}": k for i, k in enumerate(keys)})


def _quantile_bins(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Per ``keys`` the smallest ``bin`` up to which each share of the rows lies: columns q0, q1, ...

    Counts per bin are written first: what then meets by ``keys`` is a row per bin, however many tasks counted."""
    from pyspark.sql import Window

    counted = store(rows.groupBy(*keys, "bin").agg(F.count("*").alias("c")), "bins")
    by = Window.partitionBy(*keys)
    run = counted.select(*keys, "bin", F.sum("c").over(by.orderBy("bin")).alias("run"), F.sum("c").over(by).alias("all"))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("run") >= F.ceil(s * F.col("all")), F.col("bin"))).alias(f"q{i}") for i, s in enumerate(shares)])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor ``l_ij`` and centre ``m_i``."""
    z: list[Column] = []
    for i in range(DIM):
        value = F.col(X[i]) / 1000 - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * z[j]
        z.append(value / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _bin(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-6) * BINS)


def _estimate(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the covariance per ``g``; variances get their floors added."""
    sums = rows.groupBy("g").agg(F.count("*").alias("c"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)],
                                 *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS])
    out = sums.select("g", "c", *[(F.col(f"s{i}") / F.col("c") / 1000).alias(f"m{i}") for i in range(DIM)],
                      *[(F.col(f"s{i}{j}") / F.col("c") / 1e6).alias(f"e{i}{j}") for i, j in PAIRS])
    for i, j in PAIRS:
        value = F.col(f"e{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        if i == j:
            value = F.greatest(value, F.lit(0.0)) * SPREAD + FLOORS[i] ** 2
        else:
            value = value * SPREAD
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))) if i == j else value / F.col(f"l{j}{j}"))
    return out.select("g", "c", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i, j in PAIRS])


def _sent(df: DataFrame) -> DataFrame:
    """A stored table of a row per group, sent to all executors if it has at most ``SENT_GROUPS`` rows, so that no row moves to
    its group; with more groups the join is left to Spark, and none of them holds most rows."""
    return F.broadcast(df) if df.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS else df


def robust_estimates(stats: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per group ``g`` with its row count ``rows``.

    Starts from medians and quartiles, then repeats: take the nearest three
    quarters of each group, estimate again.  A group is never gathered: counts
    per bin and sums are all that is shuffled.
    """
    rows = store(_levels(stats).select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *X), "levels")
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.floor(F.col(x) / 10).alias("bin")) for i, x in enumerate(X)])).alias("e")).select("g", "e.*")
    spots = _quantile_bins(long, ["g", "d"], [0.25, 0.5, 0.75]).groupBy("g").agg(
        *[F.max(F.when(F.col("d") == i, F.col("q1") / 100)).alias(f"m{i}") for i in range(DIM)],
        *[F.max(F.when(F.col("d") == i, F.greatest((F.col("q2") - F.col("q0")) / 134.9, F.lit(FLOORS[i])))).alias(f"l{i}{i}") for i in range(DIM)])
    now = store(spots.select("*", *[F.lit(0.0).alias(f"l{i}{j}") for i, j in PAIRS if i != j]), "start")
    for _ in range(STEPS):
        ranked = rows.join(_sent(now), "g").select("g", *X, _bin(_distance()).alias("bin"))
        cut = store(_quantile_bins(ranked, ["g"], [SHARE]), "cut")
        now = store(_estimate(ranked.join(_sent(cut), "g").where("bin <= q0")), "estimate")
    sizes = rows.groupBy("g").agg(F.count("*").alias("rows"))
    return now.join(sizes, "g")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  limit: float = LIMIT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept`` for every row.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated
    eight-word windows.  Other rows are kept unless their squared distance exceeds
    ``limit``.  A group of fewer than ``least_rows`` rows uses its language's estimate,
    a small language the whole table's; null languages and sources are groups of
    their own.  Estimates rest on the rows that pass the base rules; a table
    without such rows gives null distances and keeps nothing.  Null text counts as
    empty; repeated rows and null ids are rows like others; an empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), counts(F.col("text")).alias("s"))
    stats = rows.select("doc_id", "lang", "source", "s.w.*", "s.l.*", "s.n_symbols").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    stats = store(stats.select("*", *transformed()), "statistics")
    found = store(robust_estimates(stats.where("NOT base_failed")), "estimates")
    rows = _levels(stats)
    small = _sent(found.select("g", "rows"))
    for i in (0, 1):
        rows = rows.join(small.select(F.col("g").alias(f"g{i}"), F.col("rows").alias(f"rows{i}")), f"g{i}", "left")
    rows = rows.withColumn("g", F.when(F.col("rows0") >= least_rows, F.col("g0")).when(F.col("rows1") >= least_rows, F.col("g1")).otherwise(F.col("g2")))
    judged = rows.join(_sent(found), "g", "left").withColumn("distance", _distance())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
                         (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))).alias("kept"))
