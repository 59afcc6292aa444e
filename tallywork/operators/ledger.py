"""Ledger accounts of invoices and the supplier profiles they are learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import join_counted, position

# Default account and the two confidences.
DEFAULT_CODE = "62"
PROFILE_CONFIDENCE = 0.9
DEFAULT_CONFIDENCE = 0.5


def best_profiles(profiles: DataFrame) -> DataFrame:
    """LIM-2: the profile of highest match count per supplier, lowest account id on ties."""
    best = F.min_by(F.struct("gl_account_id", "category_id"), F.struct(-F.col("match_count"), "gl_account_id"))
    return profiles.groupBy("supplier_id").agg(best.alias("p")).select("supplier_id", "p.gl_account_id", "p.category_id")


def classify(invoices: DataFrame, profiles: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    """JN-18: account and category per invoice from the supplier's profile, else the default account.

    Profiles get their code and slug first; invoices then meet one small row
    per supplier.
    """
    default = accounts.where(F.col("code") == DEFAULT_CODE)
    known = (best_profiles(profiles)
             .join(accounts.select(F.col("id").alias("gl_account_id"), "code"), "gl_account_id", "left")
             .join(categories.select(F.col("id").alias("category_id"), "slug"), "category_id", "left")
             .select(F.col("supplier_id").alias("_s"), "gl_account_id", "category_id",
                     F.coalesce("code", F.lit(DEFAULT_CODE)).alias("gl_account_code"), F.col("slug").alias("category_slug")))
    hit = F.col("_s").isNotNull()
    key = F.coalesce(F.col("supplier_id"), -1 - F.pmod(F.xxhash64("id"), F.lit(10 ** 9)))
    return (invoices.select(F.col("id").alias("invoice_id"), key.alias("_key"))
            .join(known, F.col("_key") == F.col("_s"), "left")
            .select("invoice_id", F.when(hit, F.col("gl_account_code")).otherwise(DEFAULT_CODE).alias("gl_account_code"),
                    F.coalesce(F.col("gl_account_id"), default.select("id").scalar()).alias("gl_account_id"),
                    "category_slug", "category_id",
                    F.when(hit, PROFILE_CONFIDENCE).otherwise(DEFAULT_CONFIDENCE).alias("confidence"),
                    F.lit("auto").alias("classified_by")))


def learned_profiles(classified: DataFrame) -> DataFrame:
    """AG-32: uses and last use per supplier and account, to be merged into the profiles."""
    return (classified.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id", "gl_account_id")
            .agg(F.count("*").alias("match_count"), F.max("classified_at").alias("last_seen_at")))


def merge_profiles(profiles: DataFrame, learned: DataFrame) -> DataFrame:
    """AG-32: counts add up, the later date stays, an existing category is kept."""
    both = profiles.select("supplier_id", "gl_account_id", "category_id", "match_count", "last_seen_at").unionByName(
        learned, allowMissingColumns=True)
    return both.groupBy("supplier_id", "gl_account_id").agg(
        F.max("category_id").alias("category_id"), F.sum("match_count").alias("match_count"),
        F.max("last_seen_at").alias("last_seen_at"))


def running_profile_count(classified: DataFrame) -> DataFrame:
    """WN-5: how often the supplier's account had been used up to and including each invoice."""
    return position(classified, ["supplier_id", "gl_account_id"], ["classified_at", "id"], "uses")


def unmapped_items(items: DataFrame) -> DataFrame:
    """JN-19: items without a catalogue product, each with the number of such items of its description."""
    rows = items.where(F.col("product_catalog_id").isNull()).withColumn("_d", F.coalesce("description", F.lit("\x00")))
    counts = rows.groupBy("_d").agg(F.count("*").alias("n"))
    out = join_counted(rows, counts.select("_d", F.col("n").alias("occurrence_count")), ["_d"], counts, spread="invoice_id")
    return out.drop("_d")
