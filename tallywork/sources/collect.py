"""Collecting references to documents from client folders and the mailbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: accepted file types.
MIME_TYPES = ["application/pdf", "image/jpeg", "image/png"]


def active_clients(clients: DataFrame) -> DataFrame:
    """SRC-3: active clients that have a folder."""
    return (clients.where("status = 'active' AND drive_folder_id IS NOT NULL")
            .select("id", "legal_name", "drive_folder_id"))


def listed_files(manifest: DataFrame) -> DataFrame:
    """SRC-4: PDF, JPEG and PNG files that have an id and a name."""
    return manifest.where(F.col("mime_type").isin(MIME_TYPES) & F.col("id").isNotNull() & F.col("name").isNotNull())


def first_pdf_attachments(parts: DataFrame) -> DataFrame:
    """SRC-5: per message the first PDF part with a file name and an attachment id.

    ``parts`` is flat (message_id, ordinal, mime_type, file_name, attachment_id);
    ``ordinal`` is the depth-first position of the part.
    """
    ok = (F.col("mime_type") == "application/pdf") & (F.col("file_name") != "") & (F.col("attachment_id") != "")
    return (parts.where(ok).groupBy("message_id")
            .agg(F.min_by(F.struct("attachment_id", "file_name"), "ordinal").alias("p"))
            .select("message_id", "p.attachment_id", "p.file_name"))


def normalized_sources(files: DataFrame, messages: DataFrame) -> DataFrame:
    """SRC-6, SET-2: both kinds of sources in one shape with a metadata map."""
    drive = files.select(F.lit("drive").alias("source_type"), F.col("id").alias("source_ref"), F.col("name").alias("file_name"),
                         F.create_map(F.lit("mimeType"), F.col("mime_type")).alias("metadata"))
    mail = messages.select(F.lit("gmail").alias("source_type"), F.col("message_id").alias("source_ref"), "file_name",
                           F.create_map(F.lit("attachmentId"), F.col("attachment_id")).alias("metadata"))
    return drive.unionByName(mail)


def collected(clients: DataFrame, manifest: DataFrame, messages: DataFrame, cap: int | None = None,
              allowlist: DataFrame | None = None, preview: bool = False) -> DataFrame:
    """SRC-2, WN-1, SET-2: references of active clients' folders and of the mailbox.

    ``cap`` keeps the first references of each folder, and as many of the
    mailbox; the rank filter is applied before the shuffle too, so a crowded
    folder does not travel whole.  Only ``preview`` keeps rows without client.
    """
    folders = active_clients(clients).select(F.col("drive_folder_id").alias("folder_ref"), F.col("id").alias("client_id"))
    files = listed_files(manifest)
    mail = messages
    if allowlist is not None:
        allowed = allowlist.select("source_ref").distinct()
        files = files.join(allowed.withColumnRenamed("source_ref", "id"), "id", "left_semi")
        mail = mail.join(allowed.withColumnRenamed("source_ref", "message_id"), "message_id", "left_semi")
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("folder_ref").orderBy("id"))
        files = files.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
        mail = mail.orderBy("message_id").limit(cap)
    drive_refs = files.join(folders, "folder_ref").select(
        F.lit("drive").alias("source_type"), F.col("id").alias("source_ref"), F.col("name").alias("file_name"),
        "mime_type", "folder_ref", "client_id")
    mail_refs = mail.select(F.lit("gmail").alias("source_type"), F.col("message_id").alias("source_ref"), "file_name", "attachment_id")
    refs = drive_refs.unionByName(mail_refs, allowMissingColumns=True)
    return refs if preview else refs.where(F.col("client_id").isNotNull())
