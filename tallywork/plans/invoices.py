"""Invoice lists, lookups and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import running_number

# Listed columns, shown statuses.
SUMMARY = ["id", "source_type", "file_name", "processing_status", "invoice_number", "issuer_name",
           "issue_date", "total_with_vat", "llm_confidence", "created_at"]
# Status labels shown to reviewers.
STATUS_LABELS = {
    "ok": "✓ OK",
    "duplicado": "⟳ Duplicado",
    "requires_review": "⚠ Revisión",
    "failed": "✗ Fallido",
    "processing": "⏳ Procesando",
}


def invoice_summaries(invoices: DataFrame, status: str | None = None) -> DataFrame:
    """PRJ-3: the list columns, optionally of one status, newest first."""
    df = invoices if status is None else invoices.where(F.col("processing_status") == status)
    return df.select(*SUMMARY).orderBy(F.desc("created_at"))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """PRJ-4: at most one row by equality."""
    return df.where(F.col(column) == value).limit(1)


def lookup_many(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """PRJ-4 for a table of keys."""
    return df.join(ids.select(column), column, "left_semi")


def status_label(status: Column) -> Column:
    """PRJ-5: label of a status; unknown ones stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), status)


def with_retention(invoices: DataFrame, years: int = 10) -> DataFrame:
    """PRJ-9: issue date plus the retention period."""
    return invoices.withColumn("retention_until", (F.col("issue_date") + F.make_ym_interval(F.lit(years))).cast("date"))


def with_public_id(invoices: DataFrame) -> DataFrame:
    """PRJ-10: ``INV-year-number`` with one running number over all invoices."""
    numbered = running_number(invoices, "id", "_no")
    no = F.col("_no").cast("string")
    return numbered.withColumn("public_invoice_id", F.concat(
        F.lit("INV-"), F.year("created_at").cast("string"), F.lit("-"),
        F.when(F.length(no) < 5, F.lpad(no, 5, "0")).otherwise(no))).drop("_no")


def with_legal_form(clients: DataFrame) -> DataFrame:
    """PRJ-13: legal form filled from the name where it is missing."""
    guess = F.when(F.lower("legal_name").contains("unipessoal"), "UNIPESSOAL").otherwise("OUTRO")
    return clients.withColumn("legal_form", F.coalesce("legal_form", guess))
