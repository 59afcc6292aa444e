"""Supplier resolution and enrichment of extracted invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import lookup_name, match_name, strip
from ..functions.taxid import is_nine_digits, normalize_tax_id, valid_tax_id
from ..plans.accounting import display_name
from .fuzzy import closest_names, names_by_tokens
from .skew import join_counted

# Confidence per method, score from which a match is accepted, name of an unknown supplier.
TAX_ID_CONFIDENCE = 1.0
ALIAS_ID_CONFIDENCE = 0.98
ALIAS_NAME_CONFIDENCE = 0.95
ACCEPT_SCORE = 0.95
UNKNOWN_NAME = "Fornecedor Desconhecido"


def _filled(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _spread(c: Column, by: str) -> Column:
    """Join key that sends rows without a key to many partitions instead of one; it matches nothing."""
    return F.coalesce(c, F.concat(F.lit("\x00"), F.col(by)))


def resolve(requests: DataFrame, suppliers: DataFrame, aliases: DataFrame, manual_ids: bool = False,
            id_type: str = "long") -> DataFrame:
    """JN-14: supplier, method, confidence and review need for (document_id, input_nif, input_name).

    Distinct inputs are resolved once: tax id, id alias, name alias, closest
    name, in that order.  ``manual_ids`` also matches manual aliases as ids.
    """
    r = requests.select("document_id", _filled("input_nif").alias("input_nif"), _filled("input_name").alias("input_name"))
    r = r.withColumn("_key", F.to_json(F.struct("input_nif", "input_name")))
    inputs = r.groupBy("_key", "input_nif", "input_name").agg(F.count("*").alias("n"))
    inputs = inputs.withColumns({"_name": match_name(F.col("input_name"))})

    by_id = suppliers.groupBy(F.col("nif").alias("_k1")).agg(F.min("id").alias("_by_id"))
    id_kinds = ["nif", "manual"] if manual_ids else ["nif"]
    by_alias_id = (aliases.where(F.col("alias_type").isin(id_kinds))
                   .groupBy(F.col("alias_text").alias("_k2")).agg(F.min("supplier_id").alias("_by_alias_id")))
    # SET-3: exact-name aliases come before manual ones.
    kind = F.when(F.col("alias_type") == "name_exact", 0).otherwise(1)
    by_alias_name = (aliases.where(F.col("alias_type").isin("name_exact", "manual"))
                     .groupBy(match_name(F.col("alias_text")).alias("_k3"))
                     .agg(F.min_by("supplier_id", F.struct(kind, "supplier_id")).alias("_by_alias_name")))
    known = (inputs.withColumn("_id", _spread(F.col("input_nif"), "_key")).withColumn("_nm", _spread(F.col("_name"), "_key"))
             .join(by_id, F.col("_id") == F.col("_k1"), "left")
             .join(by_alias_id, F.col("_id") == F.col("_k2"), "left")
             .join(by_alias_name, F.col("_nm") == F.col("_k3"), "left")
             .withColumn("_direct", F.coalesce("_by_id", "_by_alias_id", "_by_alias_name")))
    open_names = known.where(F.col("_direct").isNull() & F.col("_name").isNotNull()).select(F.col("_name").alias("name"))
    fuzzy = closest_names(open_names, suppliers.select("id", F.col("normalized_name").alias("entry")), id_type)
    fuzzy = fuzzy.select(F.col("name").alias("_k4"), F.col("id").alias("_by_score"), "score")
    answered = (known.withColumn("_open", F.when(F.col("_direct").isNull(), F.col("_name")))
                .withColumn("_op", _spread(F.col("_open"), "_key"))
                .join(fuzzy, F.col("_op") == F.col("_k4"), "left"))
    method = (F.when(F.col("_by_id").isNotNull(), "nif_exact")
              .when(F.col("_by_alias_id").isNotNull() | F.col("_by_alias_name").isNotNull(), "alias")
              .when(F.col("score") >= ACCEPT_SCORE, "fuzzy").when(F.col("score").isNotNull(), "fuzzy_review")
              .otherwise("new_supplier"))
    confidence = (F.when(F.col("_by_id").isNotNull(), TAX_ID_CONFIDENCE)
                  .when(F.col("_by_alias_id").isNotNull(), ALIAS_ID_CONFIDENCE)
                  .when(F.col("_by_alias_name").isNotNull(), ALIAS_NAME_CONFIDENCE)
                  .otherwise(F.coalesce("score", F.lit(0.0))))
    answers = answered.select("_key", F.coalesce("_direct", "_by_score").alias("supplier_id"),
                              method.alias("method"), confidence.alias("confidence"))
    return (join_counted(r, answers, ["_key"], inputs.select("_key", "n"), spread="document_id")
            .select("document_id", "input_nif", "input_name", "supplier_id", "method", "confidence",
                    F.col("method").isin("fuzzy_review", "new_supplier").alias("needs_review")))


def resolution_log(resolved: DataFrame, at: Column) -> DataFrame:
    """SNK-3: log rows of a resolution run."""
    return resolved.select(F.col("document_id").alias("ocr_document_id"), "input_nif", "input_name",
                           F.col("supplier_id").alias("resolved_supplier_id"), F.col("method").alias("resolution_method"),
                           "confidence", F.lit("auto").alias("created_by"), at.alias("created_at"))


def new_suppliers(resolved: DataFrame) -> DataFrame:
    """JN-17: one supplier row per unresolved id; inputs without an id get one made from their name."""
    name = F.coalesce("input_name", F.lit(UNKNOWN_NAME))
    made = F.concat(F.lit("UNKNOWN-"), F.upper(F.sha2(name, 256)))
    return (resolved.where(F.col("method") == "new_supplier")
            .select(F.coalesce("input_nif", made).alias("nif"), name.alias("name"))
            .groupBy("nif").agg(F.min("name").alias("name"))
            .withColumn("normalized_name", match_name(F.col("name"))))


def tax_id_by_name(names: DataFrame, suppliers: DataFrame, id_type: str = "long") -> DataFrame:
    """JN-16: (raw_name, tax_id) for names of domestic suppliers; an id with a wrong checksum counts as none."""
    raw = names.where(strip(F.col("raw_name")) != "").select("raw_name").distinct().withColumn("name", lookup_name(F.col("raw_name")))
    home = suppliers.where("country = 'PT'").select("id", "nif", lookup_name(display_name()).alias("entry"))
    hits = names_by_tokens(raw.select("name"), home.select("id", "entry"), id_type)
    nif = normalize_tax_id(F.col("nif"))
    answer = F.when(~is_nine_digits(nif) | valid_tax_id(nif), nif)
    return (raw.join(hits.join(home.select("id", "nif"), "id").select("name", answer.alias("tax_id")), "name", "left")
            .select("raw_name", "tax_id"))


def enrich_issuer(invoices: DataFrame, suppliers: DataFrame, id_type: str = "long") -> DataFrame:
    """ENR-1: cleaned issuer id per invoice (id, issuer_nif).

    A missing id is looked up by name; a nine-digit id with a wrong checksum is
    replaced by the lookup or dropped; an issuer equal to the receiver is
    dropped, except when it was just recovered after a checksum failure.
    """
    own, other = normalize_tax_id(F.col("issuer_nif")), normalize_tax_id(F.col("receiver_nif"))
    rows = invoices.select("id", "issuer_nif", "issuer_name", own.alias("_own"),
                           F.coalesce(other, F.col("receiver_nif")).alias("_other"))
    rows = rows.withColumn("_case", F.when(F.col("issuer_nif").isNull(), "missing")
                           .when(F.col("_own").isNull(), "blank")
                           .when(is_nine_digits(F.col("_own")) & ~valid_tax_id(F.col("_own")), "broken").otherwise("fine"))
    rows = rows.withColumn("_ask", F.when(F.col("_case").isin("missing", "broken") & (strip(F.col("issuer_name")) != ""),
                                          F.col("issuer_name")))
    asked = rows.where(F.col("_ask").isNotNull()).groupBy("_ask").agg(F.count("*").alias("n"))
    found = tax_id_by_name(asked.select(F.col("_ask").alias("raw_name")), suppliers, id_type).select(
        F.col("raw_name").alias("_ask"), F.col("tax_id").alias("_found"))
    out = join_counted(rows, found, ["_ask"], asked, spread="id")
    value = F.when(F.col("_case") == "missing", F.col("_found")).when(F.col("_case") == "fine", F.col("_own"))
    guarded = F.when(~value.eqNullSafe(F.col("_other")), value)
    return out.select("id", F.when(F.col("_case") == "broken", F.col("_found")).otherwise(guarded).alias("issuer_nif"))


def enrich_receiver(invoices: DataFrame, clients: DataFrame) -> DataFrame:
    """JN-11: registered name of the receiver where its id is known, else the extracted one."""
    names = clients.select(F.col("nif").alias("_k"), F.col("legal_name").alias("_registered"))
    key = F.coalesce(F.when(strip(F.col("receiver_nif")) != "", F.col("receiver_nif")),
                     F.concat(F.lit("\x00"), F.col("id").cast("string")))
    return (invoices.withColumn("_r", key).join(names, F.col("_r") == F.col("_k"), "left")
            .withColumn("receiver_name", F.coalesce("_registered", "receiver_name"))
            .drop("_r", "_k", "_registered"))


def client_of_source(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN-10: client of a (source_type, source_ref), null when unmapped."""
    return sources.join(mapping.select("source_type", "source_ref", "client_id"), ["source_type", "source_ref"], "left")


def apply_corrections(corrections: DataFrame, invoices: DataFrame) -> dict[str, DataFrame]:
    """COR-1: reviewers' supplier choices (invoice_id, supplier_id, reviewer_id) as updates, aliases and log rows."""
    c = corrections.select(F.col("invoice_id").alias("_i"), F.col("supplier_id").alias("_s"), "reviewer_id")
    hit = F.col("_i").isNotNull()
    joined = invoices.join(c, F.col("id") == F.col("_i"), "left")
    updated = (joined.withColumn("supplier_id", F.coalesce("_s", "supplier_id"))
               .withColumn("processing_status", F.when(hit, "ok").otherwise(F.col("processing_status")))
               .select(*invoices.columns))
    done = joined.where(hit)
    one = F.lit(1).cast("decimal(5,4)")
    aliases = (done.select(F.col("_s").alias("supplier_id"), F.coalesce("issuer_nif", "issuer_name").alias("alias_text"),
                           F.lit("manual").alias("alias_type"), one.alias("confidence"), F.col("reviewer_id").alias("created_by"))
               .where(F.col("alias_text") != ""))
    log = done.select(F.lit(None).cast("string").alias("ocr_document_id"), F.col("issuer_nif").alias("input_nif"),
                      F.col("issuer_name").alias("input_name"), F.col("_s").alias("resolved_supplier_id"),
                      F.lit("manual_correction").alias("resolution_method"), one.alias("confidence"),
                      F.lit("auto").alias("created_by"))
    return {"invoices": updated, "aliases": aliases, "log": log}
