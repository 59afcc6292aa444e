import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywork.functions import confidence, masking, names, similarity as sim, taxid, text, units

WORDS = st.text(alphabet="abcde ", max_size=12)


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()[0]


def plain_jaro_winkler(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = set(), []
    for i, ch in enumerate(a):
        spot = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == ch), None)
        if spot is not None:
            used.add(spot)
            left.append(ch)
    m = len(left)
    right = [b[j] for j in sorted(used)]
    swaps = sum(x != y for x, y in zip(left, right))
    j = (m / len(a) + m / len(b) + (m - swaps / 2) / m) / 3 if m else 0.0
    p = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return j + p * 0.1 * (1 - j)


def score(a, b):
    return float(sim.jaro_winkler_rows(*sim.code_points([a]), *sim.code_points([b]))[0])


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_jaro_winkler_matches_plain(a, b):
    assert score(a, b) == pytest.approx(plain_jaro_winkler(a, b), abs=1e-12)


def test_jaro_winkler_bounds():
    assert score("", "") == 1.0 and score("a", "") == 0.0
    assert score("supermercado ribeiro", "supermercado ribeira") > 0.95
    assert score("google inc", "microsoft corp") < 0.82


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_lcs(a, b):
    grid = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1, j + 1] = grid[i, j] + 1 if x == y else max(grid[i, j + 1], grid[i + 1, j])
    assert sim.lcs_length(a, b) == grid[-1, -1]


def test_indel_ratio(spark):
    assert one(spark, sim.indel_ratio("a", "b"), a="abcd", b="abd") == pytest.approx(6 / 7)
    assert one(spark, sim.indel_ratio("a", "b"), a="", b="") == 1.0


@pytest.mark.parametrize("raw,want", [("Empresa, Lda.", "empresa lda"), ("...,,,---", ""), ("Precisão", "precis o")])
def test_match_name(spark, raw, want):
    assert one(spark, names.match_name(F.lit(raw))) == want


def test_other_names(spark):
    assert one(spark, names.compare_name(F.lit("Precisão!  X"))) == "precisão x"
    assert one(spark, names.lookup_name(F.lit(" A-B & C d#1, "))) == "a b c d#1"


@pytest.mark.parametrize("raw,want", [("PT516315242", "516315242"), ("pt 516.315.242", "516315242"), ("  ", None), (None, None),
                                      ("DE351574837", "DE351574837"), ("ESN7207874D", "ESN7207874D"), ("PT12", "PT12")])
def test_tax_id(spark, raw, want):
    assert one(spark, taxid.normalize_tax_id(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("502030712", True), ("516315242", True), ("516315243", False), ("302030712", False),
                                      ("12345678", False), ("abcdefghi", False), (None, False)])
def test_valid_tax_id(spark, raw, want):
    assert one(spark, taxid.valid_tax_id(F.lit(raw).cast("string"))) is want


@pytest.mark.parametrize("raw,style,want", [("1234", "short", "***"), ("123456", "short", "12****56"), ("123456789", "short", "123****89"),
                                            ("12345", "long", "***"), ("123456789", "long", "123***789"), (None, "long", "***")])
def test_mask_id(spark, raw, style, want):
    assert one(spark, masking.mask_id(F.lit(raw).cast("string"), style)) == want


@pytest.mark.parametrize("raw,want", [("1234.56", "1***.56*"), ("5.5", "***.5*"), ("12", "1***"), (None, "***")])
def test_mask_amount(spark, raw, want):
    assert one(spark, masking.mask_amount(F.lit(raw).cast("string"), "long")) == want


@pytest.mark.parametrize("raw,want", [(" KGS ", "KG"), ("caixa", "CAIXA"), ("", None), (None, None), ("furlong", None)])
def test_unit(spark, raw, want):
    assert one(spark, units.normalize_unit(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("ms,want", [(-1, "0ms"), (500, "500ms"), (125400, "2m 5s"), (3661000, "1h 1m 1s"), (3600000, "1h")])
def test_duration(spark, ms, want):
    assert one(spark, text.duration_text(F.lit(ms))) == want


def test_slug_and_truncate(spark):
    assert one(spark, text.slugify(F.lit("  Hello_World 123! "))) == "hello-world-123"
    assert one(spark, text.truncate(F.lit("hello world"), 5)) == "he..."
    assert one(spark, text.truncate(F.lit("hello"), 3)) == "hel"


def test_confidence(spark):
    full = F.create_map(*[x for f in confidence.WEIGHTS for x in (F.lit(f), F.lit(0.9))])
    assert float(one(spark, confidence.overall(full))) == 0.9
    assert float(one(spark, confidence.overall(F.lit(None).cast("map<string,double>")))) == 0.5
    edge = F.create_map(F.lit("currency"), F.lit(0.7))
    assert one(spark, confidence.needs_review(edge)) is False
    assert one(spark, confidence.needs_review(F.create_map(F.lit("currency"), F.lit(0.69)))) is True
    assert len(one(spark, confidence.complete_map(edge))) == 10


def test_pairs_of_all_lengths_in_length_classes(monkeypatch):
    import random

    import pandas as pd

    def plain_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        return row[-1]

    monkeypatch.setattr(sim, "CELLS", 700)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcé€") for _ in range(n))
    lengths = [0, 1, 2, 5, 31, 63, 64, 65, 127, 128, 129, 200, 300]
    pairs = [(text(rng.choice(lengths)), text(rng.choice(lengths))) for _ in range(80)] + [("", ""), ("abc", "abc"), (None, "a"), ("a", None)] * 3
    a, b = pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs])
    indel, jaro = sim.over_pairs(a, b, sim.indel_rows), sim.over_pairs(a, b, sim.jaro_winkler_rows)
    for (x, y), i, j in zip(pairs, indel, jaro):
        if x is None or y is None:
            assert pd.isna(i) and pd.isna(j)
            continue
        assert i == pytest.approx(2 * plain_lcs(x, y) / (len(x) + len(y)) if x or y else 1.0)
        assert j == pytest.approx(plain_jaro_winkler(x, y))
    sizes = [len(c) for c in sim.length_classes([p[0] or "" for p in pairs], [p[1] or "" for p in pairs])]
    assert sum(sizes) == len(pairs) and len(sizes) > 5


def test_one_long_pair_does_not_widen_the_others():
    short = ["abc"] * 5000
    classes = list(sim.length_classes(short + ["x" * 20000], short + ["y" * 20000]))
    assert classes[-1].tolist() == [5000] and all(len(c) * 6 <= sim.CELLS for c in classes[:-1])


def test_pairs_without_values():
    import pandas as pd

    for n in (0, 3):
        assert sim.over_pairs(pd.Series([None] * n, dtype=object), pd.Series(["a"] * n, dtype=object), sim.indel_rows).isna().tolist() == [True] * n
