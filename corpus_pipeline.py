"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage is one operator of ``tallywork.llm``; its result is written and read
again before the next one starts, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywork.llm.common import store
from tallywork.llm.lines import duplicate_lines, without_lines
from tallywork.llm.near import near_duplicates
from tallywork.llm.packing import best_fit_pack
from tallywork.llm.pii import redact_pii
from tallywork.llm.quality import quality_rules


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the ids in ``gone``; rows with a null id stay."""
    return docs.join(gone.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(docs, quality_rules(docs).where("NOT kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to earlier ones go, and documents that held nothing else."""
    return _counted(without_lines(docs, duplicate_lines(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the smallest id stays."""
    return _without(docs, near_duplicates(docs, percent=80, bands=24).where("NOT kept"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become marks of their kind."""
    return _counted(redact_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, and the ids themselves, with their sequences and offsets."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: The tokenizer and the robust estimates have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
