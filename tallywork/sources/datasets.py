"""Labelled cases and external invoice datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Document types of external data.
DOCUMENT_TYPES = {
    "invoice": "fatura",
    "receipt": "fatura_recibo",
    "credit_note": "nota_credito",
    "debit_note": "nota_debito",
    "proforma": "proforma",
}
_text = lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names])
CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("description", T.StringType()), T.StructField("math_error", T.BooleanType())])),
    T.StructField("input", _text(["invoice_id", "raw_text"])),
    T.StructField("expected", _text(["supplier_name", "supplier_nif", "invoice_number", "invoice_date", "subtotal",
                                     "vat_amount", "total", "vat_rate", "currency"])),
])


def labelled_cases(spark: SparkSession, path: str, real_only: bool = False, first: int | None = None,
                   lines: bool = False) -> DataFrame:
    """SRC-12: labelled JSON cases in name order; ``lines`` reads one case per line instead of per file."""
    df = (spark.read.schema(CASE_SCHEMA).option("multiLine", not lines).json(path)
          .withColumn("_file", F.col("_metadata.file_name")))
    df = df.withColumn("case_id", F.coalesce("case_id", F.regexp_replace("_file", r"\.json$", ""))).drop("_file")
    if real_only:
        df = df.where(~F.col("case_id").startswith("synthetic-"))
    df = df.orderBy("case_id")
    return df if first is None else df.limit(first)


def external_invoices(items: DataFrame, first: int | None = None) -> DataFrame:
    """SRC-13: external items as expected invoices; items without total or net total are left out."""
    known = F.create_map(*[F.lit(x) for p in DOCUMENT_TYPES.items() for x in p])
    money = lambda c: F.col(c).cast("decimal(30,12)")
    df = (items.where(F.col("total").isNotNull() & F.col("net_total").isNotNull())
          .select(F.concat(F.lit("DOCILE-"), F.coalesce(F.col("document_id").cast("string"), F.lit("unknown"))).alias("invoice_number"),
                  F.col("vendor_name").alias("issuer_name"), F.col("customer_name").alias("receiver_name"),
                  F.col("document_date").alias("issue_date"), money("total").alias("total_with_vat"),
                  money("net_total").alias("total_without_vat"),
                  F.coalesce(money("tax_total"), F.round(money("total") - money("net_total"), 2)).alias("vat_total"),
                  F.coalesce("currency", F.lit("EUR")).alias("currency"),
                  F.coalesce(F.try_element_at(known, F.coalesce("document_type", F.lit("invoice"))), F.lit("fatura")).alias("document_type")))
    return df if first is None else df.orderBy("invoice_number").limit(first)
