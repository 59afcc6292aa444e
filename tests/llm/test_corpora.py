"""Operators that compare texts or vectors with each other, against brute force, and the pipeline."""

import importlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tallywork.llm import ann, attention, classify, lines, lm, near
from tallywork.llm.common import store, words

EDGES = [(1, None), (2, ""), (None, "no id here at all, none"), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one")]


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar_texts(rnd, groups=6, copies=25):
    """Groups of edited copies, and of copies of copies, at all similarities."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        made = [[word() for _ in range(rnd.randint(60, 160))]]
        for _ in range(copies):
            base = list(rnd.choice(made[:5]))
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 8, 20])):
                base[rnd.randrange(len(base))] = word()
            made.append(base)
        out += [" ".join(t) for t in made]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(docs, percent):
    rows = [(100 + i, t) for i, t in enumerate(similar_texts(random.Random(8)))] + [e for e in EDGES if e[0] is not None]
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)]
    want = roots(ids, links)
    got = {r.doc_id: r for r in near.near_duplicates(docs(*rows), percent=percent).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    assert len(set(want.values())) < len(ids) - 30


def test_near_duplicates_edges(docs):
    got = near.near_duplicates(docs(*EDGES, (None, "one"), (6, "one"))).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 4, False), (6, 4, False), (None, None, True), (None, None, True)])
    assert near.near_duplicates(docs(*EDGES).limit(0)).collect() == []


def test_signatures_estimate_similarity():
    shared = np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = near._mix64(shared[:1500]), near._mix64(shared[500:])
    s = near.signatures([np.unique(a), np.unique(b)], 1024)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(70)] + [(7, 7)]
    ids = {x for e in edges for x in e}
    want = {i: r for i, r in roots(ids, edges).items() if any(i in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def within_one(a, b):
    """Edit distance of at most one, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= 1


def plain_duplicates(rows, least):
    told, kept = {}, []
    for i, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            w = words(line)
            if w:
                found = [(d, n) for d, n, o in kept if o == w or len(w) >= least and len(o) >= least and abs(len(o) - len(w)) < 2 and within_one(o, w)]
                equal = [(d, n) for d, n, o in kept if o == w]
                if found:
                    told[i, k] = min(found) if not equal else told.get(equal[0], equal[0])
                kept.append((i, k, w))
    return told


def test_duplicate_lines_equal_brute_force(docs):
    rnd = random.Random(10)
    pool = [[rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.choice([1, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))] for _ in range(25)]

    def line():
        w = list(rnd.choice(pool))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            at, what = rnd.randrange(len(w)), rnd.randrange(3)
            if what == 0:
                w[at] = "zz"
            elif what == 1:
                w.insert(at, rnd.choice(["yy", w[at]]))
            elif len(w) > 1:
                del w[at]
        return rnd.choice([" ", "\t"]).join(w).replace("a", rnd.choice("aA"))
    rows = [(i, "\n".join(rnd.choice([line, line, line, lambda: ""])() for _ in range(rnd.randint(1, 6)))) for i in range(80)]
    rows += [(500 + (i or 0), t) for i, t in EDGES if i is not None] + [(None, rows[0][1])]
    want = plain_duplicates(rows, 8)
    got = {(r.doc_id, r.line): tuple(r.first) for r in lines.duplicate_lines(docs(*rows)).collect()}
    assert got == want
    df = docs(*rows, (0, rows[0][1]))
    cut = lines.without_lines(df, lines.duplicate_lines(df))
    assert cut.columns == df.columns
    left = Counter()
    for i, t in [*rows, (0, rows[0][1])]:
        gone = {k for d, k in want if d == i} if i is not None else set()
        text = t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or words(text):
            left[i, text] += 1
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == left


def test_lines_edges(docs):
    none = docs(*EDGES).limit(0)
    assert lines.duplicate_lines(none).collect() == [] and lines.without_lines(none, lines.duplicate_lines(none)).collect() == []


def test_nearest_recall_and_scores(spark):
    rnd = np.random.default_rng(11)
    centres = rnd.standard_normal((12, 16))
    x = centres[rnd.integers(0, 12, 1500)] + 0.4 * rnd.standard_normal((1500, 16))
    x[:400] = x[0]   # one vector has many copies
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0] * 3, 1), (5080, [None] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 9))) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits >= 0.9 * 20 * len(got)
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == [] and ann.nearest(df.where("vec_id = 5000"), F.lit(True)).collect() == []


def test_votes_on_held_out_texts(docs, spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["ba", "do", "ri", "ku"]) for _ in range(rnd.randint(1, 4)))
    make = {1: lambda: " ".join(word() for _ in range(rnd.randint(10, 90))), 0: lambda: " ".join(word() + rnd.choice(["%%%", "$$$", " |"]) for _ in range(rnd.randint(10, 90)))}
    truth = {i: int(rnd.random() < 0.8) for i in range(400)}
    rows = [(i, make[y]()) for i, y in truth.items()] + [(900 + (i or 0), t) for i, t in EDGES if i != 4] + [(None, "x y")]
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 2] + [(None, 1), (1, None), (77_777, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in classify.vote_quality(docs(*rows), labels, max_labelled=150).collect()}
    assert len(got) == len({i for i, _ in rows}) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in truth if not i % 2]
    assert sum((got[i] >= 0.7) == truth[i] for i in held) >= 0.97 * len(held)
    assert {r.score for r in classify.vote_quality(docs(*EDGES), labels.limit(0)).collect()} == {0.5}
    assert classify.vote_quality(docs(*EDGES).limit(0), labels).collect() == []


def plain_position(p, own, i):
    """Shares of all symbols at a position by itself, in the window that scores it."""
    begin = 0 if i < attention.WINDOW else (i - attention.WINDOW) // attention.STRIDE * attention.STRIDE + attention.STRIDE
    start, classes = p["embed"].shape[0] - 1, p["outc"].shape[1]
    x = np.append(own[begin - 1] if begin else start, own[begin:i]).astype(np.int64)
    f = attention.features(p, x[None], 0)[0, -1]
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    by_class = soft(f @ p["outc"] + p["pairc"][x[-1]])
    return np.concatenate([by_class[c] * soft(f @ p["outm"] + p["pairm"][x[-1], c]) for c in range(classes)])


def test_attention_gradients_and_windows():
    rnd = np.random.default_rng(13)
    p = {k: v.astype(np.float64) for k, v in attention.initial(rnd.integers(0, 5, (9, 8)), 2, width=4, hidden=5).items()}
    x, y = rnd.integers(0, 9, (3, 40)), rnd.integers(-1, 8, (3, 40))
    loss, g = attention.gradients(p, x, y)
    assert set(g) == set(p) - set(attention.FIXED)
    for k in g:
        at = tuple(rnd.integers(0, s) for s in p[k].shape)
        moved = {**p, k: p[k].copy()}
        moved[k][at] += 1e-5
        assert abs((attention.gradients(moved, x, y)[0] - loss) / 1e-5 - g[k][at]) < 1e-3, k
    texts = [rnd.integers(0, 8, n) for n in (1, 0, 5, 63, 64, 65, 96, 97, 400)]
    got, marked = attention.log_probabilities(p, np.concatenate(texts), np.array([len(t) for t in texts]), 1, rows=3)
    at = 0
    for own in texts:
        for i in range(len(own)):
            share = plain_position(p, own, i)
            assert abs(share.sum() - 1) < 1e-6
            assert abs(np.log(share[own[i]]) - got[at + i]) < 1e-3 and abs(np.log(share[:4].sum()) - marked[at + i]) < 1e-3
        at += len(own)


def test_lm_trains_on_every_id_and_scores_with_half_a_window(docs, monkeypatch):
    monkeypatch.setattr(lm, "PACKED", 7)
    rnd = random.Random(17)
    rows = [(i, " ".join(rnd.choice(["ba", "dori", "kune", "lo"]) for _ in range(n))) for i, n in enumerate([1, 20, 62, 63, 64, 65, 130, 3000])] + EDGES
    coder = lm._subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = lambda t: coder.stream(coder.of([*words(t), lm.END]))[0].tolist()
    there, after = Counter(i for _, t in rows for i in ids(t)), Counter(pair for _, t in rows for pair in zip([coder.begin, *ids(t)], ids(t)))
    got = lm._gathered(docs(*rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    windows = lm._windows([r.windows for r in got.where("windows IS NOT NULL").collect()], coder.kind)
    targets, pairs = Counter(windows[:, 1:].ravel().tolist()), Counter(zip(windows[:, :-1].ravel().tolist(), windows[:, 1:].ravel().tolist()))
    del targets[coder.none]
    assert targets == there and {k: v for k, v in pairs.items() if k[1] != coder.none} == after
    counted = {bytes(r.word): r.c for r in got.where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c")).collect()}
    assert counted == Counter(w for _, t in rows for w in [*words(t), lm.END])
    p = attention.initial(np.ones((9, 8)), 2)
    own = np.arange(400) * 7 % 8
    base = attention.log_probabilities(p, own, np.array([400]), 1)[0]
    for i in range(64, 400, 13):   # an id sees the 32 ids before it at least
        moved = own.copy()
        moved[i - 32] = (moved[i - 32] + 1) % 8
        assert attention.log_probabilities(p, moved, np.array([400]), 1)[0][i] != base[i], i


def small_model(seed):
    """A model with random weights over the subwords of invented words."""
    rnd = np.random.default_rng(seed)
    coder = lm.Subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    syllables = [b"ba", b"dori", b"ku", b"ne", b"the", b"ing", b"xq", "é".encode(), b"7"]
    found = sorted({b"".join(rnd.choice(syllables) for _ in range(n)) for n in (1, 2, 3) for _ in range(400)})
    counts = np.zeros(coder.end + 1, np.int64)
    ids, sizes = coder.stream(coder.of([*found, lm.END]))
    np.add.at(counts, ids, rnd.integers(1, 50, len(ids)))
    model = lm.Model(counts, coder.begins)
    model.connect(rnd.integers(0, 3, (lm.SYMBOLS + 1, lm.SYMBOLS)) * model.exists)
    for k in ("outc", "outm", "embed"):
        model.weights[k] = model.weights[k] * 8
    return coder, model, found


def test_subwords_of_many_words_at_once_are_those_of_each(monkeypatch):
    rnd = random.Random(31)
    coder = lm.Subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    found = words(" ".join("".join(rnd.choice("abé'1.中🙂") for _ in range(rnd.randint(1, 12))) for _ in range(5000)))
    odd = [w for x in "\x85\xa0\x1c\u2003" for w in (x.encode(), ("a" + x).encode(), (x + "b").encode(), f"a{x}{x}b".encode())]
    plain = lambda w: [coder.end] if w == lm.END else coder.coder.encode_ordinary(" " + w.decode())
    want, calls, each = {w: plain(w) for w in [*found, *odd, lm.END]}, [], coder.coder.encode_ordinary
    monkeypatch.setattr(coder.coder, "encode_ordinary", lambda text: calls.append(text) or each(text))
    for some in (found[:3000], [*found, found[0]], [*odd, lm.END], [lm.END], found + odd):
        ids, sizes = coder.stream(coder.of(some))
        assert ids.tolist() == [i for w in some for i in want[w]] and sizes.tolist() == [len(want[w]) for w in some]
    assert len(calls) <= len(odd)   # a call for each word before


def test_training_steps_on_one_vector_equal_steps_weight_by_weight():
    rnd = np.random.default_rng(33)
    p = attention.initial(rnd.integers(0, 5, (9, 8)), 2, width=4, hidden=5)
    windows = rnd.integers(-1, 8, (40, attention.WINDOW + 1)).astype(np.int16)
    kept = {k: v.copy() for k, v in p.items()}
    got = attention.train(p, windows, 6, 0.01, 3, 16)
    assert all((p[k] == kept[k]).all() for k in p)
    m, v, order, draws = {k: 0.0 for k in p}, {k: 0.0 for k in p}, np.empty(0, int), np.random.default_rng(3)
    for s in range(6):
        if not len(order):
            order = draws.permutation(len(windows))
        some, order = windows[order[:16]].astype(np.int64), order[16:]
        _, g = attention.gradients(kept, np.where(some[:, :-1] < 0, 8, some[:, :-1]), some[:, 1:])
        for k in g:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.98 * v[k] + 0.02 * g[k] ** 2
            kept[k] = kept[k] - 0.01 * min(1, (s + 1) / 20) * (1 - 0.9 * s / 6) * m[k] / (1 - 0.9 ** (s + 1)) / (np.sqrt(v[k] / (1 - 0.98 ** (s + 1))) + 1e-8)
    assert all(np.allclose(got[k], kept[k], atol=1e-4) for k in kept)


def test_next_words_share_a_mass_of_one_at_most():
    coder, model, found = small_model(21)
    rnd = random.Random(22)
    for n in (0, 1, 5, 40, 90):
        context = [rnd.choice(found) for _ in range(n)]
        total = 0.0
        for word in [*found, lm.END]:
            text = [*context, word] if word == lm.END else [*context, word, lm.END]
            ids, sizes = coder.stream(coder.of(text))
            logs = lm.word_logs(*model.log10(ids, np.array([len(ids)])), sizes, np.arange(len(text)) == len(text) - 1)
            total += 10.0 ** logs[n]
        assert 0 < total <= 1 + 1e-5, (n, total)


def test_classes_hold_word_begins_or_others_and_shares_sum_to_one():
    coder, model, _ = small_model(23)
    assert ((model.symbol < lm.SYMBOLS // 2) == coder.begins).all()
    total = np.bincount(model.symbol, 10.0 ** model.within, lm.SYMBOLS)
    assert np.allclose(total[model.exists], 1)


def test_lm_score_equals_a_plain_recomputation(docs, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "HEAD", 15)
    kept = {}

    def keeping(windows, model, *more):
        kept["model"] = model
        kept["weights"] = round_of(windows, model, *more)
        return kept["weights"]
    round_of = lm._round
    monkeypatch.setattr(lm, "_round", keeping)
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice(["ba", "do", "ri", "ku", "ne"]) for _ in range(rnd.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 30, 90, 40])] + [(50, "ba unseen do"), (51, "")]
    got = {r.doc_id: r.score for r in lm.lm_scores(docs(*rows), F.col("doc_id") < 50, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    seen = Counter(w for i, t in rows if i < 50 for w in [*words(t), lm.END])
    coder, model, n = lm._subwords(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), kept["model"], sum(seen.values())
    p = kept["weights"]
    for i, t in rows:
        text = [*words(t), lm.END]
        parts = [coder.stream(coder.of([w]))[0].tolist() for w in text]
        ids = [x for part in parts for x in part]
        own = model.symbol[ids]
        shares = [plain_position(p, own, k) for k in range(len(ids))]
        begins = [s[:lm.SYMBOLS // 2].sum() for s in shares]
        score, at = 0.0, 0
        for w, part in zip(text, parts):
            own_share = np.prod([shares[at + k][own[at + k]] * 10 ** model.within[ids[at + k]] for k in range(len(part))]) / begins[at]
            at += len(part)
            own_share *= begins[at] if w != lm.END else 1.0
            score += np.log10((1 - lm.MIX) * own_share + lm.MIX * seen[w] / n)
        assert abs(score - got[i]) < 1e-3 * len(text), (i, score, got[i])


def test_lm_scores(docs, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 30)
    monkeypatch.setattr(lm, "HEAD", 40)   # most words go through the join
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice(["ba", "do", "ri", "ku", "ne"]) for _ in range(min(4, int(rnd.expovariate(0.7)) + 1)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(1, 200)))) for i in range(150)]
    rows += [(900 + (i or 0), t) for i, t in EDGES] + [(None, rows[0][1]), (3, rows[3][1])]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    held_col = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    seen = Counter(w for i, t in rows if not held(i) for w in [*words(t), lm.END])
    n, v = sum(seen.values()), len(seen)
    got = lm.lm_scores(docs(*rows), ~held_col, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = dict(rows)
    for r in got:
        own = [*words(texts[r.doc_id]), lm.END]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(seen[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 * len(own)
        assert r.score < 0
    assert len({round(r.score, 9) for r in got if r.doc_id == 3}) == 1
    none = lm.lm_scores(docs(*EDGES), F.lit(False), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(none) == len(EDGES) and all(r.n_known == 0 and r.base_score == 0 for r in none)
    assert lm.lm_scores(docs(*EDGES).limit(0), ~held_col, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_lm_score_is_the_same_for_any_size_of_the_word_table(docs, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 10)
    rnd = random.Random(18)
    word = lambda: "".join(rnd.choice(["ba", "do", "ri", "ku", "ne"]) for _ in range(min(4, int(rnd.expovariate(0.7)) + 1)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(1, 100)))) for i in range(60)]
    rows += [(900 + (i or 0), t) for i, t in EDGES] + [(3, rows[3][1]), (70, "x" * 3000)]   # far less likely to the model than by its share
    scores = []
    for head in (0, 40, 200_000):
        monkeypatch.setattr(lm, "HEAD", head)
        got = lm.lm_scores(docs(*rows), F.lit(True), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        scores.append(sorted((r.doc_id, r.score) for r in got))
    for some in scores[:2]:
        assert [i for i, _ in some] == [i for i, _ in scores[2]]
        assert np.allclose([x for _, x in some], [x for _, x in scores[2]], rtol=1e-6, atol=1e-6)


def test_pipeline_keeps_clean_texts_and_drops_planted_ones(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice(["ba", "do", "ri", "ku", "ne", "lo"]) for _ in range(rnd.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    clean = {i: "\n".join(line(rnd.randint(12, 40)) for _ in range(rnd.randint(2, 6))) for i in range(300)}
    passage = line(60)
    texts = dict(clean)
    texts |= {400: clean[0], 401: clean[1].replace(" ", "  "), 402: " ".join(w + "%%%" for w in line(80).split()), 403: None, 404: "short"}
    near = clean[2].split(" ")
    near[5:8] = ["xx", "yy"]
    texts |= {405: " ".join(near).replace("\n", " "), 406: line(40) + "\n" + passage, 407: passage + "\n" + line(40), 408: line(50) + " me@mail.example.com"}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = df
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        found = store(stage(spark, found, ""), name)
        assert found.columns == df.columns
        seen[name] = {r.doc_id: r.text for r in found.collect()}
    assert set(seen["quality"]) == set(texts) - {402, 403, 404}
    assert set(clean) <= set(seen["personal_data"]) and all(seen["personal_data"][i] == t for i, t in clean.items())
    assert {400, 401}.isdisjoint(seen["line_dedup"]) and passage not in seen["line_dedup"][407] and passage in seen["line_dedup"][406]
    assert 405 not in seen["near_dedup"] and "[EMAIL]" in seen["personal_data"][408]
    packed = pipeline.STAGES[-1][1](spark, found, "").collect()
    assert {r.doc_id for r in packed} == set(seen["personal_data"])
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    whole = pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    ids = defaultdict(list)   # the sequences' ids, put together from the result alone, are the redacted texts'
    for r in sorted(whole, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += r.ids
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert ids == {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in seen["personal_data"].items()}


def test_nearest_answers_are_full_when_ids_have_several_vectors(spark):
    rnd = np.random.default_rng(41)
    x = rnd.standard_normal((70, 8))
    ids = [*range(60), 5, 5, 5, 7, 20, 20, *[33] * 4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    best = {}
    for i, v in zip(ids, x):
        for j, w in zip(ids, x):
            if i % 20 == 0 and i != j:
                best[i, j] = max(best.get((i, j), -np.inf), float((w * v).sum()))
    for q in (0, 20, 40):
        own = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        want = sorted(((-s, j) for (i, j), s in best.items() if i == q))[:20]
        assert [j for _, j in own] == [j for _, j in want], q


def test_quality_votes_equal_plain_cosine_votes(docs, rows):
    rnd = random.Random(43)
    good = lambda: " ".join(rnd.choice(["the", "river", "house", "walks", "slowly", "green"]) for _ in range(40))
    bad = lambda: " ".join(rnd.choice(["buy", "$$$", "now!!!", "click", "free"]) for _ in range(40))
    texts = [(i, good() if i % 2 else bad()) for i in range(60)] + [(100, "river house free click"), (101, good()), (102, bad())]
    labels = [(i, i % 2) for i in range(60)]
    terms = classify.Terms()
    coded = sorted(((l, *terms.of(dict(texts)[i])) for i, l in labels), key=lambda r: (r[0], list(r[1]), list(r[2])))
    voter = classify.Voter([r[1:] for r in coded], [r[0] for r in coded], 8)
    got = {r.doc_id: r.score for r in classify.vote_quality(docs(*texts), rows("doc_id long, label int", *labels), dimensions=8, neighbours=5, power=3).collect()}
    for i, t in texts:
        v = classify.unit((classify.dense([terms.of(t)]) * voter.weights) @ voter.directions)[0]
        near = sorted(((float(k @ v), float(y)) for k, y in zip(voter.known, voter.labels)), reverse=True)[:5]
        weight = [max(c, 0.0) ** 3 for c, _ in near]
        want = (sum(w * y for w, (_, y) in zip(weight, near)) + 1e-6 * 0.5) / (sum(weight) + 1e-6)
        assert abs(got[i] - min(1.0, max(0.0, want))) < 0.02, (i, got[i], want)
    assert got[101] > 0.7 > got[102]


def test_nearest_sends_a_query_once_and_reads_all_where_lists_share_most_rows(spark, monkeypatch):
    # vectors without structure: most lists must be read, so queries aren't sent list by list and rows aren't read several times
    rnd = np.random.default_rng(13)
    x = rnd.standard_normal((3000, 24)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    stored = {}
    real = ann.store
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    monkeypatch.setattr(ann, "LIST_ROWS", 40)
    monkeypatch.setattr(ann, "store", lambda out, name: stored.setdefault(name, real(out, name)))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert stored["probes"].count() == 60 and stored["lists"].count() == 3000
    for q in range(0, 3000, 50):
        assert got[q] == [i for i in np.lexsort((np.arange(3000), -(x * x[q]).sum(1))) if i != q][:20]


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200])
def test_block_search_equals_plain_scores(scale):
    rnd = np.random.default_rng(17)
    v, q = rnd.standard_normal((300, 9)) * scale, rnd.standard_normal((40, 9))
    ids, qids, lists = rnd.integers(0, 250, 300), np.arange(40), rnd.integers(0, 6, 300)
    v[5], ids[:20] = v[4], 7
    reads = rnd.random((40, 6)) < 0.6
    row, col, score = ann.search_block(v, ids, lists, q, qids, np.full(40, -np.inf), reads, 10)
    for i in range(40):
        best = {}
        for j in np.flatnonzero(reads[i, lists] & (ids != i)):
            best[ids[j]] = max(best.get(ids[j], -np.inf), (v[j] * q[i]).sum())
        want = sorted((-s, d) for d, s in best.items())[:10]
        assert [(-s, ids[c]) for r, c, s in zip(row, col, score) if r == i] == want


def test_lists_meet_in_blocks_of_bounded_rows(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    blocks = ann.Blocks(np.array([30, 60, 20, 0, 250, 40, 99]))
    assert blocks.lists == [(0, 2), (2, 4), (4, 5), (4, 5), (4, 5), (5, 6), (6, 7)]
    assert blocks.first.tolist() == [0, 0, 1, 1, 2, 5, 6] and blocks.parts.tolist() == [1, 1, 1, 1, 3, 1, 1]
    reads = np.zeros((2, 7), bool)
    reads[0, [1, 4]] = True
    assert blocks.asked(reads) == [[{"block": 0, "lists": b"\x40"}, *[{"block": b, "lists": b"\x80"} for b in (2, 3, 4)]], []]


def test_walk_finds_what_looking_at_all_centroids_finds(monkeypatch):
    rnd = np.random.default_rng(19)
    graph, x = ann.Graph(rnd.standard_normal((700, 8)).astype(np.float32)), rnd.standard_normal((50, 8)).astype(np.float32)
    ids, far = graph.search(x, 24)
    near = ((graph.centroids[None] - x[:, None]) ** 2).sum(2)
    assert (ids == np.argsort(near, axis=1)[:, :24]).mean() > 0.99 and np.allclose(far, np.sort(np.sqrt(near), axis=1)[:, :24], atol=1e-4)
    monkeypatch.setattr(ann, "WALK", 0)
    assert (graph.search(x, 24)[0][:, 0] == ids[:, 0]).mean() > 0.95
