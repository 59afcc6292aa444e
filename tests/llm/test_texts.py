"""Operators that look at one text at a time, against plain versions."""

import base64
import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tallywork.llm import bpe, chat, packing, pii, quality
from tokenizers import Tokenizer
from pyspark.sql import functions as F

RANKS = P.path("byte_bpe_50k.tiktoken")
EDGES = [(1, None), (2, ""), (None, "no id"), (3, "twice twice"), (3, "twice twice"), (4, " \t\n "), (5, "é" * 5000 + " ñ\n\n  x")]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(rnd, letters, n=40):
    return "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))


def test_bpe_equals_the_library_on_noise_and_long_pretokens(coder):
    rnd, own = random.Random(1), bpe.Encoder(RANKS, P.PATTERN, keep=500)
    texts = [noise(rnd, "aab  \n\t'sé1,. \x1c中") for _ in range(3000)] + ["a" * 20_000, "abcde" * 3000, "<|endoftext|> x"]
    for start in range(0, len(texts), 200):
        some = texts[start:start + 200]
        for text, ids in zip(some, own.encode_all(some)):
            assert ids == coder.encode_ordinary(text)
            assert own.decode(ids) == text.encode()


def test_bpe_rows(docs, coder):
    df = docs(*EDGES)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(df, RANKS, P.PATTERN).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {t: coder.encode_ordinary(t or "") for _, t in EDGES}
    assert got == sorted((i or 0, len(ids[t]), sha(" ".join(map(str, ids[t]))), sha(t or "")) for i, t in EDGES)
    back = bpe.bpe_decode(bpe.bpe_encode(df, RANKS, P.PATTERN), RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in EDGES)
    assert bpe.bpe_round_trip(df.limit(0), RANKS, P.PATTERN).collect() == []


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_pii_base_spans_equal_the_patterns():
    rnd, anchors = random.Random(2), pii.automaton()
    texts = [noise(rnd, "a@@.+1234 -(). é55..") for _ in range(20_000)]
    texts += ["+1 (017) 555-7713, 4111 1111 1111 1111 a.b@c.d.e@f.g 1.2.3.4.5.6.7.8 256.1.1.1 " * 3, "1" * 4000 + ".1.1.1"]
    for text in texts:
        assert [s for s in pii.find(text, anchors) if s[0] in pii.BASE] == plain_pii(text), text


def test_pii_added_spans_and_redaction(docs):
    texts = {1: 'x token = "04dbebab91ab85687d33" y', 2: "IBAN: DE89 3704 0044 0532 0130 00 end", 3: "account no 5", 4: "acct: 12345678.",
             5: "see https://a.example/b?c=d, ok", 6: "A token of thanks", 7: "me@x.example.com or 10.0.0.1"}
    got = {r.doc_id: ([(s.kind, texts[r.doc_id][s.start:s.end]) for s in r.spans], r.redacted) for r in pii.find_pii(docs(*texts.items())).collect()}
    assert got[1] == ([("secret", "04dbebab91ab85687d33")], 'x token = "[SECRET]" y')
    assert got[2][0] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert got[4][0] == [("account", "12345678")]
    assert got[5] == ([("url", "https://a.example/b?c=d")], texts[5])
    assert got[3] == ([], texts[3]) and got[6] == ([], texts[6])
    assert got[7][1] == "[EMAIL] or [IP]"


def test_pii_values_behind_common_forms_of_cues():
    anchors = pii.automaton()
    for text, kind, value in [
            ("account number: 12345678.", "account", "12345678"), ("account no 1234567", "account", "1234567"), ("account no. 1234567", "account", "1234567"),
            ("account_id=12345678", "account", "12345678"), ("Kontonummer: 12345678", "account", "12345678"), ("aCCount Number 12345678", "account", "12345678"),
            ("acct:         12345678", "account", "12345678"), ("passport no: X1234567 ok", "account", "X1234567"), ("Passport C01X00T47", "account", "C01X00T47"),
            ("password: hunter2", "secret", "hunter2"), ('{"Password":"horses"}', "secret", "horses"), ("passwd=p@ss!w0rd, and", "secret", "p@ss!w0rd"),
            ("Api_Key = 04dbebab91ab85687d33", "secret", "04dbebab91ab85687d33"), ("\u0130 TOKEN: 04dbebab91ab85687d33", "secret", "04dbebab91ab85687d33")]:
        assert [(k, text[a:b]) for k, a, b in pii.find(text, anchors) if k not in pii.BASE] == [(kind, value)], text
    for text in ("account notes 1234567", "account number", "passport controls at 12", "Password: please choose one", "a token: short1", "account12345678"):
        assert not [x for x in pii.find(text, anchors) if x[0] not in pii.BASE], text


def test_pii_edges(docs):
    df = docs(*EDGES)
    assert Counter((r.doc_id, r.redacted) for r in pii.find_pii(df).collect()) == Counter((i, t or "") for i, t in EDGES)
    changed = pii.redact_pii(docs((1, None), (2, "a@b.c")))
    assert changed.columns == df.columns and {r.doc_id: r.text for r in changed.collect()} == {1: None, 2: "[EMAIL]"}
    assert pii.find_pii(df.limit(0)).collect() == []


def plain_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_outliers(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ba", "do", "ri", "ku"]) for _ in range(rnd.randint(1, 4)))
    texts = {i: " ".join(word() for _ in range(rnd.randint(20, 300))) for i in range(400)}
    texts |= {1000 + i: " ".join(word() + "%%%" for _ in range(60)) for i in range(5)}
    texts |= {2000: None, 2001: "", 2002: "a b c d e f g h\n" * 9, 2003: "x\n\nx\n \ny " * 30, 2004: "é ñ " * 12 + "\x0b1\x0c2"}
    texts |= {2005 + k: " ".join(rnd.choice("abc") for _ in range(n)) for k, n in enumerate((7, 8, 9, 10, 60, 200))}
    rows = [(i, t, None if i % 50 == 0 else "en", "s1" if i % 3 else None) for i, t in texts.items()]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for i, t in texts.items():
        r = got[i]
        want = plain_counts(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(400))
    assert not any(got[1000 + i].kept for i in range(5))


def test_quality_edges(docs):
    df = docs(*EDGES)
    got = quality.quality_rules(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGES) and not any(r.kept for r in got)
    assert quality.quality_rules(df.limit(0)).collect() == []


def test_distance_equals_linear_algebra(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    x = (rnd.standard_normal((500, quality.DIM)) * 700 + 2000).astype(int)
    rows = spark.createDataFrame([("g", *map(int, v)) for v in x], "g string, " + ", ".join(f"{c} long" for c in quality.X))
    got = [r.d for r in rows.join(quality._estimate(rows), "g").select(*quality.X, quality._distance().alias("d")).orderBy(*quality.X).collect()]
    x = x[np.lexsort(x.T[::-1])] / 1000
    cov = np.cov(x.T, bias=True) * quality.SPREAD + np.diag(np.square(quality.FLOORS))
    off = x - x.mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity,docs_most,cost", [(64, 64, 4096), (64, 3, 4096), (64, 64, 4500), (1, 1, 1)])
def test_plan_places_every_piece_once_within_all_capacities(rule, capacity, docs_most, cost):
    rnd = random.Random(5)
    counts = Counter(min(capacity, int(rnd.lognormvariate(2, 1)) + 1) for _ in range(5000))
    bins, got = defaultdict(list), Counter()
    for length, first, n, each, start, offset in packing.plan(counts, capacity, docs_most, cost, rule=rule):
        assert first == got[length]
        got[length] += n
        for k in range(n):
            bins[start + k // each].append((offset + k % each * length, length))
    assert got == counts
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and len(held) <= docs_most and sum(n * n for _, n in held) <= cost
    if (docs_most, cost) == (capacity, capacity * capacity):
        assert len(bins) <= 1.01 * sum(k * v for k, v in counts.items()) / capacity + 1


def test_packing(docs):
    model, rnd = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(6)
    rows = EDGES + [(100 + i, " ".join(noise(rnd, "abcdef gh\n", 12) for _ in range(rnd.randint(1, 60)))) for i in range(200)]
    df = docs(*rows)
    placed = packing.best_fit_pack(df, P.path("byte_bpe_50k.json"), 2, capacity=100).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in placed:
        own[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 100 or 100
        cuts = [(0, head), *((a, a + 100) for a in range(head, len(ids), 100))]
        want.update((i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), tuple(ids[a:b])) for k, (a, b) in enumerate(cuts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in placed) == want
    for held in bins.values():
        ends = [0, *(a + n for a, n in sorted(held))]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= 100
    assert packing.best_fit_pack(df.limit(0), P.path("byte_bpe_50k.json"), 2).collect() == []


def test_tokens_equal_the_tokenizer_by_either_way():
    path, rnd = P.path("byte_bpe_50k.json"), random.Random(61)
    tokens, model = packing.Tokens(path), Tokenizer.from_file(path)
    model.encode_special_tokens = True
    letters = [chr(c) for c in range(0x10000) if packing.SETTLED(chr(c))]
    texts = [f"a{c}a1{c}1.{c}. {c}{c} {c}'s\n{c} \n" for c in letters]
    texts += [noise(rnd, "aab  \n\t'sétheing1,. \x1c\x85\xa0中ß") for _ in range(3000)] + [noise(rnd, "ab 🙂é\U0001e900", 30) for _ in range(300)]
    texts += ["", " " * 50_000 + "x", "a" * 50_000, "\n" * 50_000, "<|endoftext|> x", *["".join(rnd.choices("aehinorst", k=200)) for _ in range(500)]]
    want = [struct.pack(f"<{len(c.ids)}I", *c.ids) for c in model.encode_batch(texts, add_special_tokens=False)]
    assert list(tokens.of(texts)) == want
    assert list(tokens.by_parts(texts[-900:])) == want[-900:]
    assert tokens.quick and not set(tokens.parts) & {"settled", "texts"}
    assert list(tokens.of(["only settled texts", "a 🙂"])) == [model_bytes(model, "only settled texts"), model_bytes(model, "a 🙂")]
    assert "🙂" in tokens.parts and not set(tokens.parts) & {"settled", "texts"}


def model_bytes(model, text):
    ids = model.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def test_tokens_of_models_that_may_differ_stay_with_the_tokenizer(tmp_path):
    spec = json.loads(open(P.path("byte_bpe_50k.json")).read())
    base = {t: i for t, i in spec["model"]["vocab"].items() if len(t) == 1}
    own = lambda merges, **more: spec | {"added_tokens": [], "model": spec["model"] | {"vocab": base | {a + b: 256 + i for i, (a, b) in enumerate(merges)}, "merges": merges}} | more
    # "abc" by itself is ab, c: the pair a, bc is listed but never comes up, while tiktoken would take the whole.
    kinds = {"same": own([["a", "b"], ["ab", "c"]]), "unreached": own([["a", "b"], ["b", "c"], ["a", "bc"]]), "normalized": own([["a", "b"]], normalizer={"type": "Lowercase"})}
    for name, kind in kinds.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(kind))
        tokens, model = packing.Tokens(str(path)), Tokenizer.from_file(str(path))
        assert (tokens.quick is not None) == (name == "same")
        texts = ["abc ABc bc abcabc", "ab abc", "", "cabbc 1"]
        assert list(tokens.of(texts)) == [model_bytes(model, t) for t in texts]


def test_chat_round_trip_of_control_strings(spark):
    rnd = random.Random(7)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", " ", "\n", "<", "s>", "/", "[", "é", "$1"]
    text = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
    data = {i: [(rnd.choice(["user", "assistant", text(), None]), rnd.choice([text(), None])) for _ in range(rnd.randint(1, 4))] + [("user", "x")] for i in range(800)}
    df = spark.createDataFrame([(i, (t,)) for i, t in data.items()], "id int, record struct<turns:array<struct<role:string,text:string>>>")
    made = chat.format_chat(df).select("id", "chat.*")
    template = chat.Template()
    got = made.select("id", template.read(F.col("formatted")).alias("back"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    for r in got:
        turns = [(a or "", b or "") for a, b in data[r.id]]
        assert [tuple(t) for t in r.back] == turns
        assert r.learned == "".join(b for a, b in turns if a == "assistant")


def test_chat_layouts(spark):
    names = "prompt completion response system instruction input output odd".split()
    kind = ",".join(f"{n}:string" for n in names) + ",messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>"
    names += ["messages", "conversations"]
    records = {
        1: {"prompt": "p", "completion": "c"}, 2: {"prompt": "p", "response": "r"}, 3: {"system": "s", "prompt": "p", "response": "r"},
        4: {"instruction": "i", "output": "o"}, 5: {"instruction": "i", "input": "n", "output": "o"},
        6: {"messages": [("user", "u"), ("assistant", "a")]}, 7: {"conversations": [("human", "h"), ("gpt", "g"), ("tool", "t")]},
        8: {"odd": "x"}, 9: {"prompt": "p", "odd": "x", "completion": "c"}, 10: {}}
    df = spark.createDataFrame([(i, "mine", tuple(r.get(n) for n in names)) for i, r in records.items()], f"id int, layout string, record struct<{kind}>")
    got = {r.id: r for r in chat.format_chat(df).select("id", F.col("layout").alias("mine"), "chat.*", chat.Template().read(F.col("chat.formatted")).alias("back")).collect()}
    turns = {i: r.back and [tuple(t) for t in r.back] for i, r in got.items()}
    assert {i: r.layout for i, r in got.items()} == {1: "prompt_completion", 2: "prompt_response", 3: "prompt_response", 4: "instruction", 5: "instruction",
                                                     6: "messages", 7: "from_value", 8: None, 9: None, 10: None}
    assert turns[3] == [("system", "s"), ("user", "p"), ("assistant", "r")] and turns[5] == [("user", "i"), ("user", "n"), ("assistant", "o")]
    assert turns[7] == [("user", "h"), ("assistant", "g"), ("tool", "t")] and got[1].mine == "mine" and got[8].formatted is None
    assert chat.format_chat(df.limit(0)).collect() == []


@pytest.mark.parametrize("cue", ["password=", "token=", "http://a.b,", "secret: '", "passport=", "account 1 ", "iban x   ", "a://,,,", "+1((((", "@a.b."])
def test_pii_takes_time_in_proportion(cue):
    anchors = pii.automaton()

    def least(n):
        took = []
        for _ in range(3):
            start = time.process_time()
            pii.find(cue * n, anchors)
            took.append(time.process_time() - start)
        return min(took)
    assert least(40_000) < 2.6 * least(20_000) + 0.02


def test_chat_keeps_columns_with_odd_names(spark):
    row = "struct<prompt:string,completion:string>"
    df = spark.createDataFrame([(1, ("hi", "yo"), "x", "gone")], f"id long, record {row}, `a``b` string, Chat string")
    got = chat.format_chat(df)
    assert got.columns == ["id", "a`b", "chat"] and got.first().chat.formatted
