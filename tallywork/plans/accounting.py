"""Supplier totals, spend, ageing and cash flow."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ratios import mean


def display_name(alias: str = "") -> Column:
    """PRJ-11: commercial name, else legal name, else tax id."""
    p = f"{alias}." if alias else ""
    return F.coalesce(F.col(f"{p}commercial_name"), F.col(f"{p}legal_name"), F.col(f"{p}nif"))


def _with_category(suppliers: DataFrame, categories: DataFrame) -> DataFrame:
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"),
                          F.col("slug").alias("category_slug"))
    return suppliers.join(c, "category_id", "left")


def supplier_totals(suppliers: DataFrame, categories: DataFrame, invoices: DataFrame) -> DataFrame:
    """AG-13, JN-1: accepted spend per supplier; suppliers without such invoices keep a row.

    Invoices are summed per supplier before the join, so a supplier that owns a
    large part of the table meets the join as one row.  ``id`` is unique and the
    join adds no rows, so its count equals a distinct count.
    """
    sums = (invoices.where("processing_status = 'ok'").groupBy("supplier_id")
            .agg(F.count("id").alias("n"), F.sum("total_without_vat").alias("net"),
                 F.sum("vat_total").alias("vat"), F.sum("total_with_vat").alias("gross"),
                 F.min("issue_date").alias("first"), F.max("issue_date").alias("last")))
    zero = F.lit(0).cast("decimal(24,2)")
    return (_with_category(suppliers, categories)
            .join(sums, F.col("id") == F.col("supplier_id"), "left")
            .select(F.col("id").alias("supplier_id"), "nif", display_name().alias("supplier_name"),
                    "category", "category_slug", "subcategory", "country",
                    F.coalesce("n", F.lit(0)).alias("invoice_count"),
                    F.coalesce("net", zero).alias("total_net"), F.coalesce("vat", zero).alias("total_vat"),
                    F.coalesce("gross", zero).alias("total_gross"),
                    F.col("first").alias("first_invoice_date"), F.col("last").alias("last_invoice_date")))


def items_by_category(items: DataFrame, suppliers: DataFrame, categories: DataFrame) -> DataFrame:
    """AG-14, JN-2, LIM-7: spend per category, supplier, description and rate, largest first."""
    sums = (items.groupBy("supplier_id", "description", "vat_rate")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("net_amount").alias("net"),
                 F.sum("vat_amount").alias("vat"), F.sum("gross_amount").alias("gross"),
                 F.count("gross_amount").alias("n_gross")))
    s = _with_category(suppliers, categories).select(
        F.col("id").alias("supplier_id"), "category_slug", "category",
        F.col("nif").alias("supplier_nif"), F.col("name").alias("supplier_name"))
    return (sums.join(s, "supplier_id")
            .groupBy("category_slug", "category", "supplier_nif", "supplier_name", "description", "vat_rate")
            .agg(F.sum("n").alias("occurrences"), F.sum("net").alias("total_net"),
                 F.coalesce(F.sum("vat"), F.lit(0).cast("decimal(24,2)")).alias("total_vat"),
                 F.sum("gross").alias("total_gross"),
                 mean(F.sum("gross"), F.sum("n_gross"), 2).alias("avg_gross_per_occurrence"))
            .orderBy(F.desc("total_gross")))


def ageing_bucket(due: Column, today: Column) -> Column:
    days = F.datediff(today, due)
    return (F.when(days <= 30, "current").when(days <= 60, "overdue-30")
            .when(days <= 90, "overdue-60").otherwise("overdue-90"))


def ageing_report(invoices: DataFrame, today: Column | date, date_column: str = "due_date") -> DataFrame:
    """AG-15: open amounts by days past due (``date_column='issue_date'`` gives the older form)."""
    today = today if isinstance(today, Column) else F.lit(today)
    return (invoices.where(F.col("payment_status").isin("unpaid", "partial")
                           & (F.col("processing_status") == "ok") & F.col(date_column).isNotNull())
            .groupBy(ageing_bucket(F.col(date_column), today).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("invoice_count"),
                 F.coalesce(F.sum("amount_due"), F.lit(0).cast("decimal(24,2)")).alias("total_amount_due"))
            .orderBy("bucket"))


def cash_flow(invoices: DataFrame) -> DataFrame:
    """AG-16: accepted invoices per issue month, newest month first."""
    return (invoices.where("processing_status = 'ok'")
            .groupBy(F.trunc("issue_date", "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("invoice_count"),
                 F.coalesce(F.sum("total_with_vat"), F.lit(0).cast("decimal(24,2)")).alias("total_outflow"))
            .orderBy(F.desc("month")))
