"""Best-fit packing of token pieces into sequences, in several dimensions.

A bin has capacities for tokens, documents and attention cost (the sum of squared
piece lengths).  A piece is described by its length alone, so pieces are packed by
class: the plan works on one count per length, places many equal pieces into many
equal bins at once, and is as long as the table of lengths asks for, whatever the
number of documents.  The driver sees that table and the plan; the pieces are
numbered within their length by the tasks that make them and find their places in parallel.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import at_spaces, per_process, pick, store

#: Documents that are encoded together, and counts per task and length up to which all tasks get them (beyond, they are joined).
BATCH = 2000
SENT_COUNTS = 1_000_000

#: The split of byte-level vocabularies, and texts that all regex engines split alike by it: characters of blocks
#: whose letters, numbers and blanks have been settled for long.  Other texts are left to the tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = re.compile("[\x00-\u052f\u2000-\u2064\u20a0-\u20b2\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*").fullmatch


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int,
         weights: tuple[float, float, float] = (1.0, 0.2, 0.2), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Vector best fit, longest pieces first.

    Returns ``(length, first, n, each, bin, offset)``: of the pieces of ``length``,
    numbers ``first`` to ``first + n - 1`` go ``each`` to a bin, from ``bin`` on, one
    behind the other from ``offset`` on.  A piece goes where the weighted residual
    vector left behind is shortest (``norm``), or where its weighted dot product with
    the residual is largest (``dot``), among bins that have room in every dimension.
    Having taken a piece a bin stays first choice for the next equal one under
    ``norm``, so it takes as many as it can.
    """
    w = np.array(weights)
    scale = np.array([capacity, max_docs, max_cost], float)
    free = np.empty((0, 3), np.int64)   # residual capacities of a group of equal bins
    span = np.empty((0, 2), np.int64)   # its first bin and number of bins
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        item = np.array([length, 1, length * length])
        while left:
            fits = np.flatnonzero((free >= item).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = -(w * ((free[fits] - item) / scale) ** 2).sum(axis=1)
                else:
                    score = (w * (free[fits] / scale) * (item / scale)).sum(axis=1)
                g = fits[np.argmax(score)]
                room, (start, many) = free[g].copy(), span[g].tolist()
            else:
                room, start, many = np.array([capacity, max_docs, max_cost]), bins, None
                g = -1
                if (room < item).any():
                    raise ValueError(f"a piece of {length} tokens fits no bin")
            each = int((room // item).min())
            offset = capacity - int(room[0])
            whole = left // each if many is None else min(many, left // each)
            used = whole
            made = []
            if whole:
                out.append((length, first, whole * each, each, start, offset))
                first, left = first + whole * each, left - whole * each
                made.append((room - item * each, start, whole))
            if left and (many is None or used < many) and left < each:
                out.append((length, first, left, left, start + used, offset))
                made.append((room - item * left, start + used, 1))
                first, left, used = first + left, 0, used + 1
            if many is None:
                bins += used
            else:
                made.append((room, start + used, many - used))
                free, span = np.delete(free, g, 0), np.delete(span, g, 0)
            made = [x for x in made if x[2] and x[0][0] > 0 and x[0][1] > 0 and x[0][2] > 0]
            if made:
                free = np.vstack([free, *[x[0] for x in made]])
                span = np.vstack([span, *[x[1:] for x in made]])
    return out


def quick_coder(model):
    """tiktoken's encoding with the same ids as the tokenizer ``model`` on settled texts; None if that isn't sure.

    Both merge the pair of lowest rank, the leftmost among equals, but one asks for listed pairs, the other for
    pairs whose joined bytes are a token (or takes the whole pre-token, if it is one).  What becomes of a stretch of
    bytes doesn't depend on its neighbours until a token crosses its ends: where every token's own bytes end as that
    token, by the listed pairs, no pair but the last of these can ever stand for it.
    """
    import tiktoken

    spec = json.loads(model.to_str())
    bpe, split = spec["model"], spec["pre_tokenizer"] or {}
    if (bpe["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space")
            or any(spec.get(k) for k in ("normalizer", "truncation", "padding")) or not all(t["special"] for t in spec["added_tokens"])
            or any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = bpe["vocab"]
    made = [vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in bpe["merges"]]
    if (any(a >= b for a, b in zip(made, made[1:])) or not byte.keys() <= vocab.keys() or any(not byte.keys() >= set(t) for t in vocab)
            or any([x.id for x in model.model.tokenize(t)] != [i] for t, i in vocab.items())):
        return None
    return tiktoken.Encoding("same ids", pat_str=SPLIT, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}, special_tokens={})


class Tokens:
    """Token ids of whole texts as little-endian 32-bit numbers, of settled texts by :func:`quick_coder` if it can;
    of the others, parts between single blanks are kept once encoded."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.quick = quick_coder(self.model)
        self.parts: dict[str, bytes] = {}
        self.keep = keep
        self.size = np.zeros(self.model.get_vocab_size(), np.int64)   # a token's bytes: one character each in a byte-level vocabulary
        for token, i in self.model.get_vocab().items():
            self.size[i] = len(token)

    def learn(self, new: list[str]) -> None:
        """Encode blanks with the parts behind them: many in one string, as their ids are the same there, cut by the
        tokens' bytes; parts that end with a blank, or that the bytes don't fit, by themselves."""
        joined = [p for p in new if p and not p[-1].isspace()]
        single = [p for p in new if not p or p[-1].isspace()]
        runs = [joined[a:a + 1000] for a in range(0, len(joined), 1000)]
        for start in range(0, len(runs), 20):
            some = runs[start:start + 20]
            for run, coded in zip(some, self.model.encode_batch_fast([" " + " ".join(r) for r in some], add_special_tokens=False)):
                ids = np.array(coded.ids, "<u4")
                ends = np.cumsum(self.size[ids])
                wanted = np.cumsum([1 + len(p.encode()) for p in run])
                at = np.searchsorted(ends, wanted)
                if at[-1] < len(ends) and (ends[at] == wanted).all():
                    raw, bounds = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
                    self.parts.update(zip(run, (raw[a:b] for a, b in zip(bounds, bounds[1:]))))
                else:
                    single += run
        for part in single:
            self.parts[part] = self.whole(" " + part)

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, texts: list[str]):
        if not self.quick:
            yield from self.by_parts(texts)
            return
        settled = [SETTLED(text) is not None for text in texts]
        others = self.by_parts([text for text, quick in zip(texts, settled) if not quick])
        for text, quick in zip(texts, settled):
            yield self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes() if quick else next(others)

    def by_parts(self, texts: list[str]):
        cut = [at_spaces(text) for text in texts]
        got = [list(map(self.parts.get, parts[1:])) for parts in cut]
        open_ = [i for i, g in enumerate(got) if None in g]
        if open_:
            new = {p for i in open_ for p, ids in zip(cut[i][1:], got[i]) if ids is None}
            if len(self.parts) + len(new) > self.keep:
                self.parts.clear()
                new = {p for i in open_ for p in cut[i][1:]}
            self.learn(list(new))
            for i in open_:
                got[i] = map(self.parts.__getitem__, cut[i][1:])
        for parts, ids in zip(cut, got):
            yield self.whole(parts[0]) + b"".join(ids)


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids, task, nth``: a document's ids and ``end_id``, cut into pieces of
    ``capacity`` of which the first may be shorter; ``nth`` counts a task's pieces of one length.  Ids are
    packed, four bytes each: written and read as they are."""
    schema = StructType([StructField("doc_id", df.schema["doc_id"].dataType), *StructType.fromDDL("piece int, start bigint, length bigint, ids binary, task int, nth bigint").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        tokens, out = per_process(("tokens", tokenizer), lambda: Tokens(tokenizer)), to_arrow_schema(schema)
        end, task, seen = array("I", [end_id]).tobytes(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                docs = batch.slice(at, BATCH)
                coded = [ids + end for ids in tokens.of([t or "" for t in docs.column(1).to_pylist()])]
                sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                pieces = -(-sizes // capacity)
                first = sizes - (pieces - 1) * capacity
                doc = np.repeat(np.arange(len(coded)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                found = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) + np.repeat(seen - np.cumsum(found) + found, found)
                seen += found
                ends = np.append(0, np.cumsum(4 * length)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(coded))])
                columns = [docs.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids.cast(out.field("ids").type), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(run, schema)


def best_fit_pack(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, max_docs: int | None = None, max_cost: int | None = None,
                  weights: tuple[float, float, float] = (1.0, 0.2, 0.2), rule: str = "norm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    ``max_docs`` and ``max_cost`` bound the pieces of a sequence and the sum of their
    squared lengths; unset they allow whatever ``capacity`` allows.  Null text counts
    as empty: one piece that holds ``end_id``.  Repeated rows are packed each; null
    ids are ids like others; an empty table gives an empty result; other columns are
    ignored.  Equal lengths are placed in the order of the written pieces.

    The task that makes a piece counts it within its length; the counts of earlier tasks shift these numbers, so pieces
    are never gathered to be numbered, whatever length is common.
    """
    pieces = store(token_pieces(pick(df, doc_id=id_col, text=text_col), tokenizer, end_id, capacity), "pieces")
    counts = store(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    if counts.count() <= SENT_COUNTS:
        begins = F.broadcast(begins)
    steps = np.array(sorted(plan(by_length, capacity, max_docs or capacity, max_cost or capacity * capacity, weights, rule)), np.int64).reshape(-1, 6)
    numbered = pieces.join(begins, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("nth") + F.col("begin")).alias("number"))
    schema = StructType([*numbered.schema.fields[:4], StructField("ids", ArrayType(IntegerType())), *[StructField(c, LongType()) for c in ("ids_crc32", "sequence_id", "offset")]])

    def run(batches):
        import pyarrow as pa

        keys = steps[:, 0] << 44 | steps[:, 1]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            s = steps[np.searchsorted(keys, length << 44 | number, "right") - 1]
            nth = number - s[:, 1]
            raw = b"".join(batch.column("ids").to_pylist())
            ends = np.append(0, np.cumsum(length))
            view, cuts = memoryview(raw), (4 * ends).tolist()
            crc = [zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(raw, "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids, pa.array(crc, pa.int64()), pa.array(s[:, 4] + nth // s[:, 3]), pa.array(s[:, 5] + nth % s[:, 3] * length)],
                                             names=[*batch.schema.names[:-1], "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)
