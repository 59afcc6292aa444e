"""String similarity: token overlap in expressions, Jaro-Winkler and indel ratio as Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def name_tokens(c: Column) -> Column:
    """Distinct tokens of more than two characters of a normalised name."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) > 2))


def token_overlap(a: Column, b: Column) -> Column:
    """STR-6: shared tokens over the smaller token set; 0 when a set is empty."""
    x, y = name_tokens(a), name_tokens(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small > 0, F.size(F.array_intersect(x, y)) / small).otherwise(F.lit(0.0))


# --- arrays of code points: row i holds one string, padded with -1 -------------

def code_points(strings) -> tuple[np.ndarray, np.ndarray]:
    encoded = [np.frombuffer(s.encode("utf-32-le"), dtype="<i4") for s in strings]
    lengths = np.array([len(e) for e in encoded], dtype=np.int64)
    out = np.full((len(encoded), max(1, int(lengths.max(initial=0)))), -1, dtype=np.int32)
    for row, e in zip(out, encoded):
        row[:len(e)] = e
    return out, lengths


def jaro_winkler_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of row i of ``a`` with row i of ``b``; the prefix bonus is always added."""
    rows, wide = np.arange(len(b)), b.shape[1]
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    hit_a = np.zeros(a.shape, dtype=bool)
    hit_b = np.zeros(b.shape, dtype=bool)
    place = np.arange(wide)
    for i in range(a.shape[1]):
        near = (b == a[:, i:i + 1]) & ~hit_b & (np.abs(place[None, :] - i) <= window[:, None]) & (i < la)[:, None]
        found = near.any(axis=1)
        first = near.argmax(axis=1)
        hit_a[:, i] = found
        hit_b[rows[found], first[found]] = True
    m = hit_a.sum(axis=1)
    depth = int(m.max(initial=0))
    seq_a = np.take_along_axis(a, np.argsort(~hit_a, axis=1, kind="stable"), axis=1)[:, :depth]
    seq_b = np.take_along_axis(b, np.argsort(~hit_b, axis=1, kind="stable"), axis=1)[:, :depth]
    swapped = ((seq_a != seq_b) & (np.arange(depth)[None, :] < m[:, None])).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swapped / 2) / m) / 3, 0.0)
    width = min(4, a.shape[1], wide)
    same = (a[:, :width] == b[:, :width]) & (np.arange(width)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1) if width else np.zeros(len(b), dtype=int)
    score = jaro + prefix * 0.1 * (1 - jaro)
    return np.where((la == 0) & (lb == 0), 1.0, score)


#: Cells (pairs x width) of an array of code points, at most; a single longer pair is taken alone.
CELLS = 4_000_000


def length_classes(a: list[str], b: list[str]):
    """Indices of pairs that fit one array: of like length (up to twice as long) and not too many at once."""
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        wide = max(1, 2 * int(size[order[at]]))
        end = at + int(np.searchsorted(size[order[at:]], wide, "right"))
        end = min(end, at + max(1, CELLS // max(1, int(size[order[end - 1]]))))
        yield order[at:end]
        at = end


def over_pairs(a: pd.Series, b: pd.Series, score) -> pd.Series:
    """``score(codes, lengths, codes, lengths)`` of pairs, nulls kept, equal pairs computed once, like lengths together."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if not known.any():
        return pd.Series(out).where(known, None)
    which, pairs = pd.MultiIndex.from_arrays([a[known].astype(object), b[known].astype(object)]).factorize()
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    got = np.empty(len(pairs))
    for some in length_classes(left, right):
        got[some] = score(*code_points([left[i] for i in some]), *code_points([right[i] for i in some]))
    out[known] = got[which]
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-5."""
    return over_pairs(a, b, jaro_winkler_rows)


def lcs_lengths(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Longest common subsequence of row i of ``a`` with row i of ``b``: bit-parallel, 64 characters a word, all rows at once."""
    words = -(-a.shape[1] // 64)
    row = np.full((len(a), words), ~np.uint64(0))
    place = np.arange(a.shape[1])[None, :] < la[:, None]
    packed = np.zeros((len(a), words * 8), np.uint8)
    for j in range(b.shape[1]):
        hits = np.packbits((a == b[:, j:j + 1]) & place & (j < lb)[:, None], axis=1, bitorder="little")
        packed[:, :hits.shape[1]] = hits
        hit = packed.view("<u8") & row
        total, carry = np.empty_like(row), np.zeros(len(a), np.uint64)
        for w in range(words):
            first = row[:, w] + hit[:, w]
            total[:, w] = first + carry
            carry = ((first < hit[:, w]) | (total[:, w] < carry)).astype(np.uint64)
        row = total | (row & ~hit)
    bits = np.zeros((len(a), words * 8), np.uint8)
    ends = np.packbits(place, axis=1, bitorder="little")
    bits[:, :ends.shape[1]] = ends
    return np.bitwise_count(~row & bits.view("<u8")).sum(axis=1).astype(np.int64)


def lcs_length(a: str, b: str) -> int:
    return int(lcs_lengths(*code_points([a]), *code_points([b]))[0])


def indel_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n = la + lb
    return np.where(n > 0, 2 * lcs_lengths(a, la, b, lb) / np.maximum(n, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-7: 2*LCS over the summed lengths; 1 for two empty strings."""
    return over_pairs(a, b, indel_rows)
