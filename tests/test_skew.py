"""Hot keys, distributed numbering, percentiles and the name grid against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_functions import plain_jaro_winkler

from tallywork.operators import fuzzy, resolve
from tallywork.operators.duplicates import find_duplicates
from tallywork.operators.percentiles import exact_percentiles
from tallywork.operators.skew import join_counted, position, running_number


@pytest.mark.parametrize("hot_rows", [1, 7, 10 ** 6])
@pytest.mark.parametrize("parts", [1, 16])
def test_join_counted(spark, hot_rows, parts):
    big = spark.range(3000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id % 40 END").alias("k")).repartition(parts)
    side = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    got = join_counted(big, side, ["k"], counts, "id", hot_rows=hot_rows)
    want = big.join(side, "k", "left").select("id", "k", "v")
    assert got.count() == 3000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("parts", [1, 16])
def test_position(spark, parts):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 100).alias("o")).repartition(parts)
    got = position(df, ["k"], ["o", "id"], "n").toPandas().sort_values(["k", "o", "id"])
    assert (got.groupby("k").cumcount() + 1 == got["n"]).all()
    numbered = running_number(df, "id", "n")
    assert numbered.where("n <> id + 1").isEmpty()


def test_position_spreads_one_timestamp_and_null_keys(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).alias("k"), F.lit(5).alias("o")).repartition(4)
    numbered = position(df, ["k"], ["o", "id"], "n")
    got = numbered.toPandas().sort_values(["k", "id"])
    assert (got.groupby("k", dropna=False).cumcount() + 1 == got["n"]).all() and len(got) == 4000
    sizes = df.repartitionByRange("k", "o", "id").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 2 * 4000 / len(sizes)


def test_percentiles_of_hot_and_tiny_groups(spark):
    random.seed(5)
    data = [("hot", random.randrange(10 ** 6)) for _ in range(4000)] + [("one", 7), ("two", 1), ("two", 4), ("same", 5), ("same", 5)]
    data += [(None, 3), (None, 9), ("gap", None), ("gap", 2)]
    ranks = [0, .25, .5, .9, .99, 1]
    df = spark.createDataFrame(data, "k string, v long")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", ranks, [f"p{i}" for i in range(6)]).collect()}
    for k in {d[0] for d in data}:
        values = [v for kk, v in data if kk == k and v is not None]
        assert [got[k][f"p{i}"] for i in range(6)] == pytest.approx(list(np.quantile(values, ranks)))


def misspelt(rng, name):
    i = rng.randrange(len(name))
    return rng.choice([name[:i] + name[i + 1:], name[:i] + "x" + name[i:], name[:i][::-1] + name[i:], name])


def test_name_grid_equals_all_pairs(spark):
    rng = random.Random(3)
    words = ["silva", "porto", "norte", "lda", "comercio", "azul", "padaria", "obras", "sol", "mar"]
    dictionary = [(i, " ".join(rng.sample(words, rng.randint(1, 3)))) for i in range(120)]
    wanted = sorted({misspelt(rng, rng.choice(dictionary)[1]) for _ in range(150)} | {"zzz", "q"})
    entries = spark.createDataFrame(dictionary, "id long, entry string")
    names = spark.createDataFrame([(n,) for n in wanted], "name string")
    got = {r["name"]: (r["id"], r["score"]) for r in fuzzy.closest_names(names, entries, shard_rows=17, cells=24).collect()}
    for n in wanted:
        best = max(((round(plain_jaro_winkler(n, e), 9), -i) for i, e in dictionary))
        assert got.get(n) == ((-best[1], best[0]) if best[0] >= 0.82 else None), n


def test_token_grid_equals_all_pairs(spark):
    def edits(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    rng = random.Random(4)
    words = ["silva", "porto", "norte", "lda", "sa", "comercio", "azul", "padaria", "obras"]
    dictionary = [(i, " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(80)]
    wanted = sorted({misspelt(rng, rng.choice(dictionary)[1]) for _ in range(80)} | {"ab", "x" * 60})
    got = {r["name"]: (r["id"], r["overlap"]) for r in fuzzy.names_by_tokens(
        spark.createDataFrame([(n,) for n in wanted], "name string"),
        spark.createDataFrame(dictionary, "id long, entry string"), shard_rows=11, cells=16).collect()}
    for n in wanted:
        ok = []
        for i, e in dictionary:
            a, b = ({t for t in s.split(" ") if len(t) > 2} for s in (n, e))
            o = len(a & b) / min(len(a), len(b)) if a and b else 0.0
            if o >= 0.5 or edits(n, e) <= (5 if len(n) <= 40 else 8):
                ok.append((o, -i))
        assert got.get(n) == ((-max(ok)[1], pytest.approx(max(ok)[0])) if ok else None), n


@pytest.mark.parametrize("parts", [1, 16])
def test_duplicates_do_not_depend_on_layout(spark, parts):
    df = spark.range(600).select(
        "id", F.expr("timestampadd(SECOND, CAST(id % 7 AS INT), TIMESTAMP '2024-01-01')").alias("created_at"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'same' ELSE CAST(id AS STRING) END").alias("document_hash"),
        F.expr("CASE WHEN id % 10 = 1 THEN 'duplicado' ELSE 'ok' END").alias("processing_status"),
        F.expr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '' ELSE '5' END").alias("issuer_nif"),
        F.expr("CAST(id % 5 AS STRING)").alias("invoice_number"), F.expr("DATE '2024-01-01'").alias("issue_date"),
        F.lit(1).cast("decimal(14,2)").alias("total_with_vat"))
    got = find_duplicates(df.repartition(parts)).toPandas().set_index("id")["duplicate_of"]
    rows = df.toPandas().sort_values(["created_at", "id"])
    by_hash, by_key, want = {}, {}, {}
    for r in rows.itertuples():
        key = (r.issuer_nif, r.invoice_number) if r.issuer_nif else None
        want[r.id] = by_hash.get(r.document_hash, by_key.get(key))
        by_hash.setdefault(r.document_hash, r.id)
        if key and r.processing_status != "duplicado":
            by_key.setdefault(key, r.id)
    for k, v in want.items():
        assert (pd.isna(got[k]) and v is None) or got[k] == v


def plain_edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("edits", [5, 8])
def test_edit_candidates_lose_no_pair(spark, edits):
    rng = random.Random(edits)

    def spoilt(text, n):
        for _ in range(n):
            i = rng.randrange(len(text) + 1)
            text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("abxé ") + text[i:], text[:i] + rng.choice("abxé ") + text[i + 1:]])
        return text

    entries = sorted({"".join(rng.choice("abcdé ") for _ in range(n)) for n in [1, 2, 4, 5, 6, 7, 9, 11, 12, 16, 17, 18, 30, 41, 44, 60] for _ in range(3)})
    names = sorted({spoilt(rng.choice(entries), rng.randint(0, edits + 2)) for _ in range(120)} | {"", "zzzzzz"})
    a, b = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(e,) for e in entries], "entry string")
    pairs = fuzzy.edit_candidates(a, b, edits, hot_rows=5)
    got = {(r["_n"], r["_e"]) for r in pairs.join(a.select(F.md5("name").alias("name"), F.col("name").alias("_n")), "name")
           .join(b.select(F.md5("entry").alias("entry"), F.col("entry").alias("_e")), "entry").collect()}
    for n in names:
        for e in entries:
            if plain_edits(n, e) <= edits and not (len(n) <= edits and len(e) <= edits):   # those need no pair, see within_edits
                assert (n, e) in got, (n, e)


@pytest.mark.parametrize("token_rows", [1, 6, 1000])
def test_token_search_with_frequent_tokens(spark, token_rows):
    rng = random.Random(token_rows)
    words = ["lda", "comercio", "silva"] * 4 + ["porto", "norte", "azul", "obras", "sol", "mar", "rio"] + [f"w{i}" for i in range(10, 40)]
    entries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    names = sorted({" ".join(rng.choice([*words, "unseen", "other"]) for _ in range(rng.randint(1, 7))) for _ in range(150)} | {"x " * 10000 + "lda"})
    got = {r["name"]: (r["id"], r["overlap"]) for r in fuzzy.by_overlap(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(entries, "id long, entry string"), token_rows, hot_rows=7).collect()}
    for n in names:
        ok = []
        for i, e in entries:
            a, b = ({t for t in s.split(" ") if len(t) > 2} for s in (n, e))
            if a and b and len(a & b) / min(len(a), len(b)) >= 0.5:
                ok.append((len(a & b) / min(len(a), len(b)), -i))
        assert got.get(n) == ((-max(ok)[1], pytest.approx(max(ok)[0])) if ok else None), n


@pytest.mark.parametrize("brief_first", [1, 500])
def test_edit_search_equals_all_pairs(spark, brief_first):
    rng = random.Random(9)
    entries = [(i, "".join(rng.choice("abcde fgh") for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 10, 11, 13, 15, 20, 39, 43])))) for i in range(90)]
    names = sorted({misspelt(rng, misspelt(rng, rng.choice(entries)[1] or "q") or "q") for _ in range(80)} | {"", "zz", "zzzzzz", "zzzzzzzzz", "x" * 20000})
    unique = {}
    for i, e in entries:
        unique[e] = min(i, unique.get(e, i))
    got = {r["name"]: r["id"] for r in fuzzy.within_edits(spark.createDataFrame([(n,) for n in names], "name string"),
           spark.createDataFrame([(i, e) for e, i in unique.items()], "id long, entry string"), brief_first=brief_first).collect()}
    tokens = lambda s: {t for t in s.split(" ") if len(t) > 2}
    share = lambda a, b: len(a & b) / max(1, min(len(a), len(b)))
    for n in names:
        if any(share(tokens(n), tokens(e)) >= 0.5 for e in unique):
            continue   # answered by tokens
        near = [(len(tokens(n) & tokens(e)) / max(1, min(len(tokens(n)), len(tokens(e)))), -i) for e, i in unique.items()
                if abs(len(n) - len(e)) <= 8 and plain_edits(n, e) <= (5 if len(n) <= 40 else 8)]
        assert got.get(n) == (-max(near)[1] if near else None), n


def test_index_skips_cells_and_survives_long_names(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    entries = [(i, f"{word()} {word()} {word()}") for i in range(600)] + [(600, "ab" * 9990)]
    names = [(misspelt(rng, e),) for _, e in rng.sample(entries[:600], 40)] + [("ab" * 10000,)]
    e, n = spark.createDataFrame(entries, "id long, entry string"), spark.createDataFrame(names, "name string").distinct()
    index, directory = fuzzy.name_index(e, 20)
    first = fuzzy.visits(n, directory, True)
    found = fuzzy._scored(first, index, "long", 4, 100)
    later = fuzzy.visits(n.join(found.select("name", "score"), "name", "left").fillna(0.0), directory, False)
    cells = len(directory.cell) * n.count()
    assert first.count() + later.count() < 0.7 * cells
    got = {r["name"]: r["id"] for r in fuzzy.closest_names(n, e, shard_rows=20, cells=4).collect()}
    assert got["ab" * 10000] == 600


def test_common_pieces_meet_by_letters(spark):
    # "000" is in every text, but the letters around it are too far apart to be within the edits
    names = spark.createDataFrame([(f"manual co 5000000{i:03d}",) for i in range(60)] + [("suplier 000000007x",)], "name string")
    entries = spark.createDataFrame([(f"supplier 000000{i:03d}",) for i in range(60)], "entry string")
    pairs = fuzzy.edit_candidates(names, entries, 5)
    assert pairs.count() == 60 and pairs.select("name").distinct().count() == 1


def test_token_of_many_names_and_entries_makes_no_pairs(spark):
    names = spark.createDataFrame([(f"supplier n{i:04d}",) for i in range(300)], "name string")
    entries = spark.createDataFrame([(i, f"supplier e{i:04d}") for i in range(30)], "id long, entry string")
    frequent = []
    real, fuzzy.kept = fuzzy.kept, lambda df, name: (frequent.append(df.count()) if name in ("frequent", "pairs") else None, df)[1]
    try:
        got = fuzzy.by_overlap(names, entries, token_rows=50).collect()
    finally:
        fuzzy.kept = real
    assert frequent == [1, 0] and len(got) == 300 and {(r["id"], r["overlap"]) for r in got} == {(0, 0.5)}


def test_like_names_visit_few_cells(spark):
    entries = spark.createDataFrame([(i, f"supplier {i:09d}") for i in range(2000)], "id long, entry string")
    _, directory = fuzzy.name_index(entries, 50)
    names = spark.createDataFrame([(f"supblier {i:09d}", 0.97) for i in range(0, 2000, 40)], "name string, score double")
    assert fuzzy.visits(names, directory, False).count() < 0.5 * 50 * len(directory.cell)


def test_names_near_to_most_entries_try_few(spark):
    # nearly all pairs are within the edits: they are neither stored nor all compared, and the lowest id is found all the same
    entries = [(1000 - i, f"supplier#{i * 7919 % 100000:09d}") for i in range(400)]
    names = [f"supblier#{i * 104729 % 100000:09d}" for i in range(150)] + ["three other words", "supplier 000000000 of lisbon"]
    entries += [(5, "supplier#000000000 of lisbom"), (2000, "supplier 00000000x fo lisben")]
    stored = {}
    real, fuzzy.kept = fuzzy.kept, lambda df, name: stored.setdefault(name, []).append(out := real(df, name)) or out
    try:
        got = {r["name"]: r["id"] for r in fuzzy.within_edits(spark.createDataFrame([(n,) for n in names], "name string"),
               spark.createDataFrame(entries, "id long, entry string"), brief_first=30).collect()}
    finally:
        fuzzy.kept = real
    assert max(df.count() for dfs in stored.values() for df in dfs) < len(names) * len(entries) / 5
    for n in names[:-1]:
        near = [i for i, e in entries if abs(len(n) - len(e)) <= 5 and plain_edits(n, e) <= 5]
        assert got.get(n) == (min(near) if near else None), n
    assert got[names[-1]] == 2000   # shares one token of three, which beats a lower id


def swapped_requests(n):
    """Requests of names with their words in another order, or one letter off."""
    return [(2 * i, None, f"{i:09d} Supplier") for i in range(n)] + [(2 * i + 1, None, f"Supblier {i:09d}") for i in range(n)]


@pytest.mark.parametrize("query", ["jn_14", "jn_15", "jn_17"])
def test_names_of_swapped_words_visit_few_cells(spark, query):
    # all names have nearly the letters of all entries: only where these stand tells them apart
    n = 700
    suppliers = spark.createDataFrame([(i, f"5{i:08d}", f"supplier {i:09d}") for i in range(n)], "id long, nif string, normalized_name string")
    requests = spark.createDataFrame(swapped_requests(n), "document_id long, input_nif string, input_name string")
    aliases = spark.createDataFrame([], "supplier_id long, alias_text string, alias_type string")
    visits = []
    real, fuzzy.kept = fuzzy.kept, lambda df, name: (out := real(df, name), visits.append(out) if name == "visits" else None)[0]
    try:
        if query == "jn_15":
            names = requests.select(F.lower("input_name").alias("name"))
            got = {r["name"]: r["id"] for r in fuzzy.closest_names(names, suppliers.select("id", F.col("normalized_name").alias("entry")), shard_rows=50).collect()}
            assert got == {f"supblier {i:09d}": i for i in range(n)}
        else:
            resolved = resolve.resolve(requests, suppliers, aliases)
            if query == "jn_14":
                got = {r["document_id"]: (r["supplier_id"], r["method"]) for r in resolved.collect()}
                assert got == {2 * i: (None, "new_supplier") for i in range(n)} | {2 * i + 1: (i, "fuzzy") for i in range(n)}
            else:
                assert {r["normalized_name"] for r in resolve.new_suppliers(resolved).collect()} == {f"{i:09d} supplier" for i in range(n)}
    finally:
        fuzzy.kept = real
    rows = visits[0]
    for df in visits[1:]:
        rows = rows.unionByName(df)
    assert rows.where("name LIKE '% supplier'").count() == 0


def test_scores_by_words_of_bits_equal_plain_ones():
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abc 01é") for _ in range(rng.choice([1, 2, 5, 9, 18, 63, 64, 65, 80])))
    for _ in range(20):
        entries = sorted({text() for _ in range(30)})
        names = sorted({text() for _ in range(8)} | {"".join(sorted(e, key=lambda c: rng.random() < 0.2)) for e in entries[:8]})
        ids = rng.sample(range(100), len(entries))
        asked = pd.DataFrame({"name": names, "score": 0.82})
        found = fuzzy._closest(asked, pd.DataFrame({"id": ids, "entry": entries}))
        got = {n: (i, s) for n, i, s in zip(found["name"], found["id"], found["score"])}
        for n in names:
            score, at = max((round(plain_jaro_winkler(n, e), 9), -i) for i, e in zip(ids, entries))
            assert got.get(n) == ((-at, score) if score >= 0.82 else None), n
