"""Duplicate documents and fiscal-key collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import join_counted

FISCAL_KEY = ["issuer_nif", "invoice_number", "issue_date"]
LOOKUP_KEY = [*FISCAL_KEY, "total_with_vat"]
DUPLICATE = "duplicado"


def _age():
    return F.struct("created_at", "id")


def group_originals(invoices: DataFrame, keys: list[str], among=None) -> DataFrame:
    """WN-2: the earliest row (created_at, then id) of every key that occurs more than once.

    ``among`` limits which rows can be the original.  Groups are reduced with
    partial aggregation; no group is gathered in one place.
    """
    age = _age() if among is None else F.when(among, _age())
    return (invoices.dropna(subset=keys).groupBy(*keys)
            .agg(F.min(age).alias("first"), F.count("*").alias("n")).where("n > 1"))


def _with_first(rows: DataFrame, groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    side = groups.select(*keys, F.col("first").alias(name))
    return join_counted(rows, side, keys, groups.select(*keys, "n"), spread="id")


def find_duplicates(invoices: DataFrame) -> DataFrame:
    """JN-12: for each invoice the earlier one it repeats, by content hash, else by fiscal key and total.

    Two equality joins; the hash answer wins.  The fiscal answer ignores
    originals already marked as duplicates and needs all four parts present.
    """
    rows = invoices.select("id", "created_at", "document_hash", "processing_status",
                           *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("issuer_nif", "invoice_number")],
                           "issue_date", "total_with_vat")
    by_hash = group_originals(rows, ["document_hash"])
    by_key = group_originals(rows, LOOKUP_KEY, F.col("processing_status") != DUPLICATE)
    out = _with_first(rows, by_hash, ["document_hash"], "same_hash")
    out = _with_first(out, by_key, LOOKUP_KEY, "same_key")
    older = lambda c: F.when(F.col(c) < _age(), F.col(f"{c}.id"))
    found = F.coalesce(older("same_hash"), older("same_key"))
    return out.select("id", found.isNotNull().alias("is_duplicate"), found.alias("duplicate_of"),
                      F.when(older("same_hash").isNotNull(), "hash").when(found.isNotNull(), "fiscal_key").alias("matched_by"))


def fiscal_collisions(invoices: DataFrame) -> DataFrame:
    """JN-13: invoices sharing issuer, number and date, duplicates already marked aside; the total plays no part."""
    live = invoices.where(F.col("processing_status") != DUPLICATE)
    groups = live.dropna(subset=FISCAL_KEY).groupBy(*FISCAL_KEY).agg(F.count("*").alias("n")).where("n > 1")
    side = groups.withColumnRenamed("n", "sharing")
    return join_counted(live.select("id", *FISCAL_KEY), side, FISCAL_KEY, groups, spread="id").where("sharing IS NOT NULL")
