"""Extracted document sections: guards, line checks, merge, counters and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.taxid import valid_tax_id
from .tax import VALID_RATES

# Fields of the sections.
MONEY = ["subtotal", "vat_amount", "total"]
LINE_FIELDS = ["description", "quantity", "unit_price", "subtotal"]
LINE_MONEY = ["unit_price", "subtotal", "vat_amount", "total"]
HEADER_FIELDS = ["supplier_name", "supplier_nif", "invoice_number", "invoice_date"]


def _warnings(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda w: w.isNotNull())


def header_guards(headers: DataFrame) -> DataFrame:
    """VAL-5: tax ids that are missing or fail the checksum become null with a warning."""
    ids = ("supplier_nif", "receiver_nif")
    out = headers.withColumns({f"_{c}_valid": valid_tax_id(F.col(c)) for c in ids})   # once for the warning and the value
    notes = [F.when(F.col(c).isNull(), f"{c} missing").when(~F.col(f"_{c}_valid"), f"{c} invalid") for c in ids]
    out = out.withColumn("warnings", _warnings(*notes)).withColumns({c: F.when(F.col(f"_{c}_valid"), F.col(c)) for c in ids})
    return out.drop(*[f"_{c}_valid" for c in ids])


def totals_guards(totals: DataFrame) -> DataFrame:
    """VAL-5: an unknown tax rate becomes null with a warning; the currency defaults to EUR."""
    bad = F.col("vat_rate").isNotNull() & ~F.col("vat_rate").isin(VALID_RATES)
    return totals.withColumn("warnings", _warnings(F.when(bad, "vat_rate invalid"))).withColumns({
        "vat_rate": F.when(~bad, F.col("vat_rate")),
        "currency": F.coalesce(F.when(F.col("currency") != "", F.col("currency")), F.lit("EUR"))})


def line_checks(lines: DataFrame) -> DataFrame:
    """VAL-4: amounts of lines become text, and a part that is missing gives a warning; lines that are no objects (null)
    are dropped with one."""
    item = lines.schema["line_items"].dataType.elementType
    as_text = lambda line: F.struct(*[(line[f.name].cast("string") if f.name in LINE_MONEY else line[f.name]).alias(f.name) for f in item.fields])
    kind = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType() if f.name in LINE_MONEY else f.dataType) for f in item.fields]))
    def notes(line: Column, i: Column) -> Column:
        at = F.concat(F.lit("line "), (i + 1).cast("string"))
        missing = [F.when(line[c].isNull(), F.concat(at, F.lit(f" missing {c}"))) for c in LINE_FIELDS]
        return F.when(line.isNull(), F.array(F.concat(at, F.lit(" not an object")))).otherwise(_warnings(*missing))
    return lines.withColumns({
        "warnings": F.coalesce(F.flatten(F.transform("line_items", notes)), F.array().cast("array<string>")),
        "line_items": F.coalesce(F.transform(F.filter("line_items", lambda x: x.isNotNull()), as_text), F.array().cast(kind))})


def reconcile(headers: DataFrame, lines: DataFrame, totals: DataFrame, key: str = "document_id") -> DataFrame:
    """VAL-3: guarded sections merged per document.

    Lines that do not add up to the total give a warning and the total stays.
    When all three sections failed, nothing is extracted.
    """
    h = headers.select(key, *HEADER_FIELDS, F.col("errors").alias("_eh"), F.lit(True).alias("_h"))
    i = lines.select(key, "line_items", F.col("errors").alias("_el"))
    t = totals.select(key, *MONEY, "currency", "vat_rate", F.col("errors").alias("_et"))
    none = F.array().cast("array<string>")
    errs = {c: F.coalesce(F.col(c), none) for c in ("_eh", "_el", "_et")}
    failed = (F.size(errs["_eh"]) > 0) & (F.size(errs["_el"]) > 0) & (F.size(errs["_et"]) > 0)
    money = lambda x: x.try_cast("decimal(36,18)")
    zero = F.lit(0).cast("decimal(38,18)")
    line_sum = F.aggregate("line_items", zero, lambda a, x: (a + F.coalesce(money(x["subtotal"]), zero)).cast("decimal(38,18)"))
    out = h.join(i, key, "full").join(t, key, "full").withColumn("_sum", F.coalesce(line_sum, zero))
    off = ~failed & (F.col("_sum") != 0) & (F.col("_sum") != money(F.col("total")))
    keep = lambda c: F.when(~failed, c)
    return out.select(
        key, *[keep(F.when(valid_tax_id(F.col(c)), F.col(c)) if c == "supplier_nif" else F.col(c)).alias(c) for c in HEADER_FIELDS],
        *[keep(money(F.col(c))).alias(c) for c in MONEY], keep(F.coalesce("currency", F.lit("EUR"))).alias("currency"),
        keep(F.col("vat_rate")).alias("vat_rate"), keep(F.col("line_items")).alias("line_items"),
        F.col("_sum").alias("line_sum"), _warnings(F.when(off, "line sum disagrees with total")).alias("warnings"),
        F.concat(*errs.values()).alias("errors"))


def section_counters(section: DataFrame, name: str, fields: list[str], key: str = "document_id") -> DataFrame:
    """AG-37: filled fields, warnings and errors of a section; an empty list counts as not filled."""
    def filled(c: str) -> Column:
        some = F.col(c).isNotNull()
        if section.schema[c].dataType.typeName() == "array":
            some = some & (F.size(c) > 0)
        return some.cast("int")
    return section.select(key, F.lit(name).alias("agent"), sum((filled(c) for c in fields), F.lit(0)).alias("fields_extracted"),
                          F.size("warnings").alias("warnings_count"), F.size("errors").alias("errors_count"))


def with_appended(df: DataFrame, column: str, more: str) -> DataFrame:
    """SET-4: list append; a missing list adds nothing."""
    none = F.array().cast(df.schema[column].dataType)
    return df.withColumn(column, F.concat(F.coalesce(column, none), F.coalesce(more, none))).drop(more)


def assembled_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """AG-38: one row per document, its page texts joined by newlines in page order."""
    return (pages.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t")))).alias("_p"))
            .select(key, F.array_join(F.transform("_p", lambda x: x["t"]), "\n").alias("raw_text"),
                    F.size("_p").alias("page_count"))
            .withColumn("char_count", F.length("raw_text")))
