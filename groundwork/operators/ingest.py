"""From uploads to chunks: cleaning, duplicates, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.functions import text as tx

MAX_PAGES = 2000


def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", tx.clean_page(F.col("text")))


def reject_oversized_docs(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Page count and state of each document; too many pages means FAILED."""
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    too_many = F.col("pages") > max_pages
    return counted.select(
        "document_id",
        "pages",
        F.when(too_many, "FAILED").otherwise("ACCEPTED").alias("state"),
        F.when(
            too_many,
            F.format_string(f"The PDF has %d pages; the maximum allowed is {max_pages}", "pages"),
        ).alias("reason"),
    )


def assemble_full_text(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per accepted document: pages in order, and their text with a blank line after each.

    Oversized documents are dropped before their pages are gathered, so a row holds at most
    ``max_pages`` pages.
    """
    verdict = reject_oversized_docs(pages, max_pages)
    rejected = verdict.where(F.col("state") == "FAILED").select("document_id")
    cleaned = clean_pages(pages.join(rejected, "document_id", "left_anti"))
    gathered = cleaned.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("page_no").cast("int").alias("page_no"), "text"))).alias("pages")
    )
    text = F.array_join(F.transform("pages", lambda p: F.concat(p["text"], F.lit("\n\n"))), "")
    return gathered.select(
        "document_id", "pages", text.alias("text"), F.size("pages").alias("total_pages")
    )


def dedupe_files(docs: DataFrame) -> DataFrame:
    """One document per content: the first by id."""
    same = Window.partitionBy("file_hash").orderBy("document_id")
    hashed = docs.withColumn("file_hash", F.sha2("text", 256))
    return hashed.withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn")


def classify_uploads(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """What happens to each upload, by the state of the document with the same content.

    ``uploads(upload_id, file_hash)``, ``stored(document_id, file_hash, status)``. The first
    upload of a content decides; a copy of it in the same batch finds it already processing.
    """
    first = uploads.groupBy("file_hash").agg(F.min("upload_id").alias("_first"))
    known = first.join(
        stored.select("file_hash", "document_id", "status"), "file_hash", "left"
    )
    joined = uploads.join(known, "file_hash")
    status = F.col("status")
    is_first = F.col("upload_id") == F.col("_first")
    outcome = (
        F.when(status == "INDEXED", "ALREADY_INDEXED")
        .when((status == "PROCESSING") | ~is_first, "ALREADY_PROCESSING")
        .otherwise("QUEUED")
    )
    action = (
        F.when(outcome != "QUEUED", "REUSE")
        .when(status.isNull(), "CREATE")
        .otherwise("RESET")
    )
    return joined.select(
        "upload_id", "file_hash", "document_id", outcome.alias("outcome"), action.alias("action")
    )


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """First chunk of each text inside a document; blank ones go, numbers keep their gaps."""
    same = Window.partitionBy("document_id", "chunk_hash").orderBy("sequence_number")
    filled = chunks.where(~tx.is_blank(F.col("content")))
    return filled.withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn")


def new_chunks_only(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose text their own document does not hold yet."""
    held = stored.select("document_id", "chunk_hash")
    return dedupe_chunks(chunks).join(held, ["document_id", "chunk_hash"], "left_anti")


def ingestion_status(verdict: DataFrame, chunks: DataFrame, message_limit: int = 500) -> DataFrame:
    """Final state per document: INDEXED with pages and chunks, or FAILED with a message."""
    written = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    failed = F.col("state") == "FAILED"
    return verdict.join(written, "document_id", "left").select(
        "document_id",
        F.when(failed, "FAILED").otherwise("INDEXED").alias("status"),
        F.when(~failed, F.col("pages")).alias("total_pages"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce("chunks", F.lit(0))).alias("chunks"),
        F.when(failed, F.substring("reason", 1, message_limit)).alias("error_message"),
    )


def recover_interrupted(docs: DataFrame) -> DataFrame:
    """What was still processing when the application stopped has failed. Other messages stay."""
    stuck = F.col("status") == "PROCESSING"
    message = F.col("error_message") if "error_message" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        *[c for c in docs.columns if c not in ("status", "error_message")],
        F.when(stuck, "FAILED").otherwise(F.col("status")).alias("status"),
        F.when(stuck, lex.INTERRUPTED_MESSAGE).otherwise(message).alias("error_message"),
        stuck.alias("recovered"),
    )


def reprocess_plan(requests: DataFrame, docs: DataFrame, stored_files: DataFrame) -> DataFrame:
    """What a request to process a document again comes to."""
    files = stored_files.select("storage_path").distinct().withColumn("_stored", F.lit(True))
    known = docs.select("document_id", "status", "storage_path").join(files, "storage_path", "left")
    outcome = (
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("status") != "FAILED", "NOT_FAILED")
        .when(F.col("_stored").isNull(), "FILE_MISSING")
        .otherwise("QUEUED")
    )
    return requests.join(known, "document_id", "left").select(
        "document_id", outcome.alias("outcome")
    )
