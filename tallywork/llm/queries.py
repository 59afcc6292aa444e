"""One query per operator, each over its whole table, with the digests that the checks compare."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .bpe import bpe_round_trip
from .chat import Template, format_chat, learned_text
from .classify import vote_quality
from .lines import duplicate_lines
from .lm import lm_scores
from .near import near_duplicates
from .packing import best_fit_pack
from .pii import BASE, find_pii
from .quality import quality_rules
from .resample import importance_resample
from .shards import shard_report
from .trie import graft, prefix_trie, turn_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op2_bpe(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = duplicate_lines(docs)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "first"))), lambda x: F.concat_ws(":", x["line"], x["first"]["doc_id"], x["first"]["line"])), ",")
    per_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_removed"), listed.alias("removed"))  # lines of one document
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


@query
def op4_packing(spark, sf_dir):
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


#: The digests from the table itself: what a reversible format must give back.
ORACLES["op5_chat"] = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum(24 + length(role) + length(text) + length(regexp_extract_all(role || ' ' || text, '<s>|</s>|\\[INST\\]|\\[/INST\\]'))) AS formatted_chars
    FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars FROM whole"""


@query
def op5_chat(spark, sf_dir):
    own = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(own).alias("t")).select("conv_id", "t.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    filled = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(filled)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    record = F.struct(turns.alias("turns")).alias("record")
    done = format_chat(rows.groupBy("conv_id").agg(record)).select("conv_id", "chat.*")
    template = Template()
    back = done.select("conv_id", "formatted", template.read(F.col("formatted")).alias("back"), learned_text(F.col("formatted"), F.col("loss_spans"), template).alias("learned"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op6_lm(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = lm_scores(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op8_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op9_quality_votes(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = vote_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op11_resampling(spark, sf_dir):
    ranked = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


#: Prefixes as lists of turn hashes; subtrees by pairing a conversation's nodes with those further down.
ORACLES["op12_prefix_trie"] = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos, key, size
    FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS size
          FROM conversations WHERE conv_id IS NOT NULL)),
counts AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
hashed AS (
    SELECT conv_id, n, conv_id - conv_id % 5 AS base,
        xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda crc, byte: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, byte)), 4294967295), 4294967295) % 9 AS keep
    FROM counts),
plan AS (
    SELECT h.conv_id, h.base, h.keep, least(h.keep, coalesce(b.n, 0)) AS taken, least(h.keep, coalesce(b.n, 0)) + greatest(h.n - h.keep, 0) AS length
    FROM hashed h LEFT JOIN counts b ON b.conv_id = h.base),
rebuilt AS (
    SELECT p.conv_id, p.length, t.pos AS depth, t.key, t.size FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.taken
    UNION ALL SELECT p.conv_id, p.length, t.pos - p.keep + p.taken, t.key, t.size FROM plan p JOIN turns t USING (conv_id) WHERE t.pos > p.keep),
paths AS (
    SELECT conv_id, length, depth, size, md5(array_to_string(list(key) OVER (PARTITION BY conv_id ORDER BY depth), ',')) AS node FROM rebuilt
    UNION ALL SELECT conv_id, length, 0, 0, 'root' FROM plan),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM paths),
nodes AS (
    SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, any_value(size) AS size, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
    FROM linked GROUP BY node),
kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (
    SELECT top AS node, sum((n.n_convs - 1) * n.size) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
    FROM (SELECT DISTINCT a.node AS top, b.node AS low FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth) JOIN nodes n ON n.node = low LEFT JOIN kids k ON k.node = low
    GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.above LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node"""


@query
def op12_prefix_trie(spark, sf_dir):
    keep = F.crc32(F.col("conv_id").cast("string")) % 9
    return prefix_trie(graft(turn_rows(table(spark, sf_dir, "conversations")), F.col("conv_id") - F.col("conv_id") % 5, keep, most=8))


@query
def op13_sharding(spark, sf_dir):
    return shard_report(table(spark, sf_dir, "documents"), shards=16, seed=42)
