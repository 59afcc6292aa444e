"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts gives a term matrix, its leading singular
directions and one unit vector per labelled text; these are broadcast.  Every
document is projected and compared with all labelled vectors in exact blocked
products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import per_batch, pick, shipped, words

#: Hashed word terms; style terms follow them.
TERMS = 4096
#: Style terms: same word as before, ending in two marks, only marks, with a digit, repeated line, very short, very long.
STYLE = 7
#: Weight of a style term against a word term, dimensions, neighbours, power of the similarity in a vote.
BOOST, DIMENSIONS, NEIGHBOURS, POWER = 2.0, 64, 25, 8
#: Most labelled rows that the model rests on.
MAX_LABELLED = 4000
BLOCK = 250


class Terms:
    """Weights of a text's terms: roots of their shares among its words, so that every text has the same length."""

    def __init__(self, keep: int = 300_000):
        import xxhash

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= keep:
                    self.clear()
                text = word.decode()
                marks = not text[-2:].isalnum() and len(text) > 1 and not text[-2].isalnum()
                found = [xxhash.xxh3_64_intdigest(word) % TERMS]
                tests = (marks, not any(c.isalnum() for c in text), any(c.isdigit() for c in text), len(text) < 2, len(text) > 30)
                found += [TERMS + k for k, yes in zip((1, 2, 3, 5, 6), tests) if yes]
                self[word] = found
                return found
        self.known = Known()

    def of(self, text: str | None) -> tuple[list[int], list[float]]:
        found = words(text)
        n = len(found)
        if not n:
            return [], []
        share = Counter()
        for word, c in Counter(found).items():
            for term in self.known[word]:
                share[term] += c
        share[TERMS] = sum(map(eq, found, found[1:]))
        lines = [x for x in text.split("\n") if x.strip()]
        share[TERMS + 4] = n * (len(lines) - len(set(lines))) / max(1, len(lines))
        return list(share), [(c / n) ** 0.5 * (BOOST if t >= TERMS else 1.0) for t, c in share.items()]


def dense(rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS + STYLE), np.float32)
    for i, (terms, weights) in enumerate(rows):
        out[i, terms] = weights
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_directions(x: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` right singular directions, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    basis = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((x.shape[0], min(k + 10, *x.shape)), np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    inner = np.linalg.svd(x @ basis, full_matrices=False)[2]
    return (basis @ inner.T)[:, :k].astype(np.float32)


class Voter:
    """``weights`` of the terms, ``directions``, unit vectors ``known`` and their ``labels``."""

    def __init__(self, rows, labels, dimensions: int):
        x = dense(rows)
        seen = (x[:, :TERMS] > 0).sum(axis=0)
        self.weights = np.ones(TERMS + STYLE, np.float32)
        self.weights[:TERMS] = np.log((1 + len(rows)) / (1 + seen)) + 0.1
        x *= self.weights
        self.directions = leading_directions(x, dimensions)
        self.labels = np.array(labels, np.float32)
        self.known = unit(x @ self.directions)

    def scores(self, rows, neighbours: int, power: int) -> np.ndarray:
        mine = unit((dense(rows) * self.weights) @ self.directions)
        near = mine @ self.known.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
        vote = np.maximum(np.take_along_axis(near, top, 1), 0.0).astype(np.float64) ** power
        mean = float(self.labels.mean())
        total = vote.sum(axis=1)
        return (((vote * self.labels[top]).sum(axis=1) + 1e-6 * mean) / (total + 1e-6)).clip(0, 1)


def vote_quality(df: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS,
                 neighbours: int = NEIGHBOURS, power: int = POWER, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """``doc_id, score`` for every row of ``df``: 0 to 1, higher where label 1 is likelier.

    ``labels`` holds ids with a label of 0 or 1.  At most ``max_labelled`` of its rows,
    those with the least hash of their id, make the model with the texts they name;
    null ids, labels and texts are left out.  Only texts are looked at.  Null, empty
    and blank texts get the mean label; without labelled texts every score is 0.5.
    Equal texts get equal scores; repeated rows and null ids are rows like others;
    other columns are ignored; an empty table gives an empty result.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    sample = pick(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IS NOT NULL")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    known = docs.where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")  # at most max_labelled short rows

    def make():
        terms = Terms()
        return lambda labels, texts: ((int(y), *terms.of(t)) for y, t in zip(labels, texts))
    # ids may repeat in docs, so the bound holds once more, over texts and in an order that no run changes
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.md5("text")).limit(max_labelled)
    rows = per_batch(known.select("label", "text"), "label int, terms array<int>, weights array<float>", make).collect()  # at most max_labelled rows
    rows.sort(key=lambda r: (r.label, r.terms, r.weights))
    model = shipped(df.sparkSession, Voter([(r.terms, r.weights) for r in rows], [r.label for r in rows], dimensions) if rows else None)

    def score():
        terms, voter = Terms(), model()

        def work(ids, texts):
            found = [terms.of(t) for t in texts]
            scores = voter.scores(found, neighbours, power).tolist() if voter else [0.5] * len(ids)
            return zip(ids, scores)
        return work

    return per_batch(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", score, BLOCK)
