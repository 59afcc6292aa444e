"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pending merges wait in one bucket per merge rank; a bucket holds the positions
(in a linked list of tokens) where that merge was possible when it was entered.
A bitmap in two levels tells which buckets are not empty, so the next rank is
found by two find-first-set steps.  Entries that a later merge has overtaken are
skipped when they come up.  A pre-token of n bytes takes O(n log n) steps.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import at_spaces, per_batch, per_process, per_row, pick

#: Texts encoded together: their unknown pre-tokens share one queue.
BATCH = 4000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_BIT = [1 << k for k in range(256)]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token; every byte must have a rank of its own.

    ``buckets[rank]``: heap of positions, so that equal ranks merge leftmost first.
    ``low[rank >> 8]`` has a bit for each bucket, ``top`` a bit for each word of ``low``.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return (whole,)
    n, bit = len(piece), _BIT
    following = list(range(1, n + 1))   # start of the next token; 0: merged away
    before = list(range(-1, n))         # start of the previous token
    buckets: dict[int, list[int]] = {}
    top, low = 0, {}
    waiting = [(r, i) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    while True:
        for rank, i in waiting:
            if rank in buckets:
                heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                high = rank >> 8
                if high in low:
                    low[high] |= bit[rank & 255]
                else:
                    low[high] = bit[rank & 255]
                    top |= bit[high] if high < 256 else 1 << high
        if not top:
            break
        high = (top & -top).bit_length() - 1
        bits = low[high]
        rank = high << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                low[high] = bits
            else:
                del low[high]
                top &= top - 1
        waiting = ()
        j = following[i]
        if not j or j == n:
            continue
        end = following[j]
        if get(piece[i:end]) != rank:   # overtaken by another merge
            continue
        following[j], following[i] = 0, end
        if end < n:
            before[end] = i
            if (r := get(piece[i:following[end]])) is not None:
                waiting = ((r, i),)
        if i and (r := get(piece[(k := before[i]):end])) is not None:
            waiting = (*waiting, (r, k))
    out, i = [], 0
    while i < n:
        out.append(get(piece[i:following[i]]))
        i = following[i]
    return tuple(out)


class JointQueue:
    """One rank queue over many short pre-tokens at once.

    The lowest bucket is taken as an array of positions: in each pre-token the
    leftmost valid one merges, the others go back to their bucket.  So each
    pre-token sees its own merges one by one, lowest rank first, as alone.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int64)[order], -1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; -1: none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces)), sizes)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        following[ends - 1], before[ends - sizes] = -1, -1
        rank_of = np.full(n, -1)  # of the pair that begins here; -1: none, or merged away
        starts = np.flatnonzero(following >= 0)
        rank_of[starts] = self.pair(token[starts], token[starts + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        top, low = 0, {}

        def push(ranks, at):
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, positions in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts)):
                if rank in buckets:
                    buckets[rank].append(positions)
                else:
                    buckets[rank] = [positions]
                    low[rank >> 8] = low.get(rank >> 8, 0) | 1 << (rank & 255)
                    top |= 1 << (rank >> 8)

        if len(first := np.flatnonzero(rank_of >= 0)):
            push(rank_of[first], first)
        while top:
            high = (top & -top).bit_length() - 1
            bits = low[high]
            rank = high << 8 | (bits & -bits).bit_length() - 1
            waiting = buckets[rank]
            at = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            at = at[rank_of[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                own = piece[at]
                later = np.append(False, own[1:] == own[:-1])
                rest, at = at[later], at[~later]
            else:
                rest = at[:0]
            if len(rest):
                buckets[rank] = [rest]
            else:
                del buckets[rank]
                low[high] = bits & (bits - 1)
                if not low[high]:
                    top &= top - 1
            if not len(at):
                continue
            gone = following[at]
            after, left = following[gone], before[at]
            token[at], token[gone] = rank, -1
            rank_of[gone] = -1
            following[at] = after
            has = after >= 0
            before[after[has]] = at[has]
            rank_of[at] = -1
            rank_of[at[has]] = self.pair(token[at[has]], token[after[has]])
            has = left >= 0
            rank_of[left[has]] = self.pair(token[left[has]], token[at[has]])
            new = np.concatenate([at, left[has]])
            new = new[rank_of[new] >= 0]
            if len(new):
                push(rank_of[new], new)
        kept = token >= 0
        ids = token[kept].tolist()
        bounds = np.append(0, np.cumsum(np.bincount(piece[kept], minlength=len(pieces)))).tolist()
        return [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Whole texts to ids and back.  ``keep`` bounds the number of parts held in memory,
    ``short`` the bytes of a pre-token that goes through the joint queue."""

    def __init__(self, path: str, pattern: str, keep: int = 400_000, short: int = 48):
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.joint = JointQueue(self.ranks)
        self.keep, self.short = keep, short
        self.parts: dict[str, tuple[int, ...]] = {}

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not known yet, their pre-tokens together."""
        new = [p for p in parts if p not in self.parts]
        if len(self.parts) + len(new) > self.keep:
            self.parts.clear()
            new = list(parts)
        split = [self.split(p) for p in new]
        pieces = {p: p.encode() for ps in split for p in ps}
        short = [p for p, b in pieces.items() if len(b) <= self.short]
        ids = dict(zip(short, self.joint.encode([pieces[p] for p in short])))
        for p, b in pieces.items():
            if p not in ids:
                ids[p] = encode_piece(b, self.ranks)
        for part, ps in zip(new, split):
            self.parts[part] = ids[ps[0]] if len(ps) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, ps)))

    def encode_all(self, texts: list[str]):
        """Ids of each text as a list, one after the other."""
        cut = []
        for text in texts:
            first, *rest = at_spaces(text)
            cut.append([first, *map(" ".__add__, rest)])
        self.learn(set(chain.from_iterable(cut)))
        for parts in cut:
            yield list(chain.from_iterable(map(self.parts.__getitem__, parts)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids (array of int) of every whole text.

    A row per input row; null text counts as empty and gives no ids, as does an
    empty text; an empty table gives an empty result; other columns are ignored.
    ``ranks_path`` is a file every executor has; ``pattern`` splits the pre-tokens.
    """
    def make():
        encoder = per_process(("bpe", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))
        return lambda doc_ids, texts: zip(doc_ids, encoder.encode_all([t or "" for t in texts]))

    rows = pick(df, doc_id=id_col, text=text_col)
    return per_batch(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>", make, BATCH)


def bpe_decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the bytes (binary) that the ids stand for; null ids give no bytes."""
    def make():
        encoder = per_process(("bpe", ranks_path, ""), lambda: Encoder(ranks_path, ""))
        return lambda doc_id, ids: (doc_id, encoder.decode(ids or []))

    rows = pick(df, doc_id=id_col, ids=ids_col)
    return per_row(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary", make)


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of :func:`bpe_encode` and :func:`bpe_decode` in one pass."""
    def make():
        encoder = per_process(("bpe", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))
        names = [str(i) for i in range(len(encoder.bytes_of))]

        def work(doc_ids, texts):
            for doc_id, ids in zip(doc_ids, encoder.encode_all([t or "" for t in texts])):
                told = " ".join(map(names.__getitem__, ids)).encode()
                yield doc_id, len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()
        return work

    rows = pick(df, doc_id=id_col, text=text_col)
    return per_batch(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, BATCH)

