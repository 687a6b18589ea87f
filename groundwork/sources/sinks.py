"""The chunk table on disk: append, replace, keyed update.

Chunks are laid out in ``doc_bucket`` folders, a hash of the document, so that replacing or
joining the chunks of some documents touches their folders only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.text import is_blank, truncate_title
from groundwork.operators.segment import chunk_metadata
from groundwork.session import discard, is_small, remove_folder, settle, ship
from groundwork.sources.tables import CHUNK_SCHEMA

BUCKETS = 64
# The chunk table as it lies on disk.
STORED_SCHEMA = T.StructType([*CHUNK_SCHEMA.fields, T.StructField("doc_bucket", T.IntegerType())])


def document_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def chunk_id() -> Column:
    """The same for a text of a document however often it is ingested: 128 bits of hash as hex digits."""
    return F.substring(F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), "chunk_hash"), 256), 1, 32)


def stored_chunk_rows(chunks: DataFrame) -> DataFrame:
    """Segmenter output in the shape of the chunk table, not embedded yet."""
    rows = chunks.select(
        "document_id",
        chunk_id().alias("chunk_id"),
        "chunk_hash",
        F.col("sequence_number").cast("int").alias("sequence_number"),
        truncate_title(F.col("title")).alias("title"),
        "content",
        chunk_metadata().alias("metadata"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return rows.select(*CHUNK_SCHEMA.fieldNames())


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Write rows of the chunk table.

    The rebalance hint gathers each folder into few files and still splits a folder that holds
    far more than its share.
    """
    laid_out = chunks.withColumn("doc_bucket", document_bucket(buckets)).hint(
        "rebalance", "doc_bucket"
    )
    laid_out.write.mode(mode).partitionBy("doc_bucket").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def _stored_in(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame:
    """Rows of the table in some folders, with ``doc_bucket``. A table that does not exist is an empty one."""
    try:
        stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], STORED_SCHEMA)
    return stored.where(F.col("doc_bucket").isin(list(buckets)))


def _buckets_of(rows: DataFrame, buckets: int) -> list[int]:
    """The folders that the documents of ``rows`` lie in: at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(document_bucket(buckets)).distinct().collect())


def new_rows(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The chunks that the table does not hold yet. Reads keys only, and only of the folders that they belong to.

    Keys alone are counted and compared; texts move only where many chunks are held and many are new, or to choose
    among repeated ones.
    """
    from groundwork.operators.ingest import dedupe_chunks

    key = ["document_id", "chunk_hash"]
    stored = _stored_in(chunks.sparkSession, path, _buckets_of(chunks, buckets))
    held = stored.select("doc_bucket", *key, F.lit(True).alias("held")).distinct()
    filled = chunks.where(~is_blank(F.col("content")))
    counted = filled.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("doc_bucket", document_bucket(buckets))
    keys = counted.join(held, ["doc_bucket", *key], "left").select(*key, "copies", "held")
    known, new = keys.where("held").select(*key), keys.where("held IS NULL").select(*key)
    if is_small(known):
        fresh = filled.join(F.broadcast(known), key, "left_anti")
    else:
        fresh = filled.join(ship(new, is_small(new)), key, "left_semi")
    repeated = keys.where("held IS NULL AND copies > 1").select(*key)
    if repeated.isEmpty():
        return fresh
    few = is_small(repeated)
    once = fresh.join(ship(repeated, few), key, "left_anti")
    return once.unionByName(dedupe_chunks(fresh.join(ship(repeated, few), key, "left_semi")))


def append_new_chunks(
    spark: SparkSession, chunks: DataFrame, path: str, buckets: int = BUCKETS
) -> None:
    """Append what the table does not hold yet, so that writing twice equals writing once.

    The batch is written down first, as its folders are looked up before it is compared with them. A table that does
    not exist is an empty one.
    """
    batch = settle(chunks, "chunk-batch")
    write_chunks(new_rows(batch, path, buckets), path, buckets)
    discard(batch)


def replace_document_chunks(stored: DataFrame, redone: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after some documents are ingested again: their old chunks go, others stay."""
    kept = stored.join(redone.select("document_id"), "document_id", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def replace_documents(
    spark: SparkSession, path: str, redone: DataFrame, fresh: DataFrame, buckets: int = BUCKETS
) -> list[int]:
    """Put ``fresh`` chunks in the place of all chunks of the documents ``redone``, on disk.

    Only the ``doc_bucket`` folders of those documents are written again; their numbers are returned. What the folders
    are to hold is staged beside the table first and named in its journal, then the folders are swapped, then the
    journal says so. A run that fails before the staging is complete has changed nothing; one that fails later is
    finished by ``finish_replacements``, which every replacement starts with: staged folders stay until then.
    """
    finish_replacements(spark, path)
    redone = settle(redone.select("document_id").distinct(), "redone")
    fresh = settle(fresh.dropDuplicates(["document_id", "chunk_id"]), "fresh-chunks")
    touched = sorted({*_buckets_of(redone, buckets), *_buckets_of(fresh, buckets)})
    if touched:
        stored = _stored_in(spark, path, touched).drop("doc_bucket")
        rows = replace_document_chunks(stored, redone, fresh)
        staged = f"{path}/_staged/{uuid.uuid4().hex}"
        write_chunks(rows, staged, buckets)
        _note(spark, path, staged, touched, False)
        _swap(spark, path, staged, touched)
    discard(redone)
    discard(fresh)
    return touched


def finish_replacements(spark: SparkSession, path: str) -> int:
    """Finish replacements that were staged but not swapped when their run failed. Swapping again changes nothing."""
    try:
        journal = spark.read.schema(JOURNAL).parquet(f"{path}/_journal")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    open_ones = journal.groupBy("staged").agg(
        F.max("done").alias("done"), F.first("buckets").alias("buckets"), F.min("at").alias("at")).where("NOT done")
    waiting = sorted(open_ones.collect(), key=lambda r: r["at"])  # a row per failed run
    for one in waiting:
        _swap(spark, path, one["staged"], one["buckets"])
    return len(waiting)


JOURNAL = "staged string, buckets array<int>, done boolean, at long"


def _note(spark: SparkSession, path: str, staged: str, buckets: Sequence[int], done: bool) -> None:
    row = [(staged, list(buckets), done, time.time_ns())]
    spark.createDataFrame(row, JOURNAL).write.mode("append").parquet(f"{path}/_journal")


def _swap(spark: SparkSession, path: str, staged: str, buckets: Sequence[int]) -> None:
    rows = spark.read.schema(STORED_SCHEMA).parquet(staged)
    held = {r[0] for r in rows.select("doc_bucket").distinct().collect()}  # at most the folders touched
    rows.write.mode("overwrite").partitionBy("doc_bucket").option("partitionOverwriteMode", "dynamic").parquet(path)
    # An overwrite leaves folders alone that it has no rows for: their documents have lost all chunks.
    for bucket in set(buckets) - held:
        remove_folder(spark, f"{path}/doc_bucket={bucket}")
    _note(spark, path, staged, buckets, True)
    remove_folder(spark, staged)


def update_embeddings(stored: DataFrame, vectors: DataFrame) -> DataFrame:
    """The table with the vectors of ``vectors(chunk_id, embedding)`` set.

    Of several vectors for one id the last by ``written_at`` counts, without that column the largest.
    """
    last = F.max_by("embedding", "written_at") if "written_at" in vectors.columns else F.max("embedding")
    new = vectors.groupBy("chunk_id").agg(last.alias("_new"))
    merged = stored.join(new, "chunk_id", "left")
    return merged.withColumn("embedding", F.coalesce("_new", "embedding")).select(*stored.columns)


def mark_indexed(docs: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Documents whose chunks were written become INDEXED and get their page count."""
    counts = page_counts.select("document_id", F.col("pages").alias("_pages"))
    merged = docs.join(counts, "document_id", "left")
    return merged.withColumn(
        "status", F.when(F.col("_pages").isNotNull(), "INDEXED").otherwise(F.col("status"))
    ).withColumn("total_pages", F.coalesce("_pages", "total_pages")).drop("_pages")
