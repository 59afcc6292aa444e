"""Documents as they land: scanning, format detection, checks, decoding, XML flattening."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import strip

# Accepted extensions with format and MIME type, format of each MIME type, size limit, PDF mark.
EXTENSIONS = {
    "pdf": ("pdf", "application/pdf"),
    "jpg": ("image", "image/jpeg"),
    "jpeg": ("image", "image/jpeg"),
    "png": ("image", "image/png"),
    "svg": ("image", "image/svg+xml"),
    "xml": ("xml", "application/xml"),
}
MIME_FORMATS = {
    "application/pdf": "pdf", "image/jpeg": "image", "image/png": "image",
    "image/svg+xml": "image", "application/xml": "xml", "text/xml": "xml",
}
MAX_BYTES = 50 * 1024 * 1024
PDF_MARK = b"%PDF"


def landed_documents(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """SRC-1: PDF files anywhere under ``invoices/{client}/...``; file bytes are only read when asked for."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[pP][dD][fF]").load(root))
    columns = ["path", "modificationTime", "length", *(["content"] if content else [])]
    return with_path_parts(files.select(*columns), "path")


def with_path_parts(df: DataFrame, column: str) -> DataFrame:
    """SRC-1: client, year, month and file name out of a storage path; missing levels are null."""
    part = lambda i: F.nullif(F.regexp_extract(column, r"invoices/([^/]+)/(?:([^/]+)/)?(?:([^/]+)/)?([^/]+)$", i), F.lit(""))
    return df.withColumns({"client_id": part(1), "year": part(2), "month": part(3), "file_name": part(4)})


def is_pdf_name(c: Column) -> Column:
    return F.lower(c).endswith(".pdf")


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def with_format(df: DataFrame, key: str = "storage_key", mime: str = "mime_type") -> DataFrame:
    """SRC-7: (doc_format, doc_mime, format_error) from the extension and an optional given MIME type."""
    ext = F.when(F.col(key).rlike(r"\.[^.]+$"), F.lower(F.substring_index(key, ".", -1)))
    fmt = F.try_element_at(_table({e: f for e, (f, _) in EXTENSIONS.items()}), ext)
    standard = F.try_element_at(_table({e: m for e, (_, m) in EXTENSIONS.items()}), ext)
    given = F.try_element_at(_table(MIME_FORMATS), F.col(mime))
    error = (F.when(ext.isNull(), "no file extension").when(fmt.isNull(), "unsupported extension")
             .when(F.col(mime).isNotNull() & given.isNull(), "unsupported MIME type")
             .when(given != fmt, "MIME type and extension disagree"))
    fine = error.isNull()
    return df.withColumns({"doc_format": F.when(fine, fmt), "doc_mime": F.when(fine, F.coalesce(F.col(mime), standard)),
                           "format_error": error})


def pdf_error(content: Column, mime: Column | None = None) -> Column:
    """SRC-8: first failed input check, or null."""
    e = (F.when(F.octet_length(content) > MAX_BYTES, "file_too_large")
         .when(F.substring(content, 1, 4) != F.lit(PDF_MARK), "invalid_magic_bytes"))
    return e if mime is None else e.when(mime != "application/pdf", "invalid_mime")


def content_hash(content: Column) -> Column:
    """SRC-9."""
    return F.sha2(content, 256)


def decode_attachment(data: Column) -> Column:
    """SRC-15: bytes of URL-safe base64 text."""
    plain = F.translate(data, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="))


def xml_text(docs: DataFrame, key: str = "storage_key", content: str = "content") -> DataFrame:
    """SRC-10: (key, text, char_count, error): ``tag: text`` lines in document order, namespaces dropped."""
    def flatten(data: bytes | None):
        if not data:
            return "", "empty document"
        try:
            root = ET.fromstring(bytes(data).decode("utf-8", errors="replace"))
        except (ET.ParseError, ValueError) as e:
            return "", f"not readable as XML: {e}"
        lines = [f"{el.tag.rsplit('}', 1)[-1]}: {el.text.strip()}" for el in root.iter() if el.text and el.text.strip()]
        return "\n".join(lines), None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [flatten(c) for c in part[content]]
            yield pd.DataFrame({key: part[key], "text": [g[0] for g in got],
                                "char_count": [len(g[0]) for g in got], "error": [g[1] for g in got]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInPandas(run, f"{key} {kind}, text string, char_count long, error string")


def recovered_json(response: Column) -> Column:
    """SRC-11: (found_in, body) of the JSON in a free-text answer: the whole text, a fenced block, or the first flat object."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    flat = F.regexp_extract(response, r"\{[^{}]*\}", 0)
    good = lambda c: F.try_parse_json(c).isNotNull()
    pick = lambda where, c: F.when(good(c), F.struct(F.lit(where).alias("found_in"), c.alias("body")))
    return F.coalesce(pick("whole", strip(response)), pick("fenced", fenced), pick("flat", flat))
