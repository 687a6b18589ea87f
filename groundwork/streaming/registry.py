"""Documents registered by the hash of their file while they arrive, and ingested once each.

The status of every file hash is a table beside the chunks: a hash that is new is queued, one that is indexed or in
progress is reused, one that failed is reset and queued again. A micro-batch is judged as a whole, by one aggregation and
joins; only hashes, ids and paths go through them. The texts of what was queued are read again from their files, so a
file that half of all uploads repeat costs a few bytes an upload. What each micro-batch queues is segmented and written,
and its statuses are appended to a table.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwork.functions import text as tx
from groundwork.operators import segment
from groundwork.operators.ingest import dedupe_chunks
from groundwork.session import discard, settle
from groundwork.sources import sinks

# Outcomes of an upload and states of a file: fixed values, as the other operators name them.
QUEUED, ALREADY_INDEXED, ALREADY_PROCESSING = "QUEUED", "ALREADY_INDEXED", "ALREADY_PROCESSING"
INDEXED, PROCESSING, FAILED = "INDEXED", "PROCESSING", "FAILED"

FILE = "file_hash string, status string, document_id long"
OUTCOME = "file_hash string, upload_id long, path string, document_id long, outcome string, action string, status string"


def step(status: str | None, document_id: int | None, upload: dict[str, Any]) -> tuple[str, int, str, str]:
    """(outcome, document id, action, state) of one event on a file in ``status``.

    An event whose ``verdict`` is null is an upload whose ingestion goes on elsewhere: the file stays in progress until
    an event with an ``upload_id`` of null brings its verdict.
    """
    upload_id, verdict = upload["upload_id"], upload["verdict"]
    if upload_id is None:
        return "", document_id, "", verdict or status
    if status == INDEXED:
        return ALREADY_INDEXED, document_id, "REUSE", status
    if status == PROCESSING:
        return ALREADY_PROCESSING, document_id, "REUSE", status
    if status is None:
        return QUEUED, upload_id, "CREATE", PROCESSING
    return QUEUED, document_id, "RESET", PROCESSING


def register(events: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, changed files): what ``step`` makes of a batch of events on what ``files`` holds of each hash.

    ``events`` have ``file_hash, upload_id, path, verdict`` and ``row``, a number of their own. Of the uploads of one hash
    the smallest id decides, the others find the file in progress. A file whose verdict is known with the upload ends the
    batch in it; verdicts that come as events of their own count after the uploads.
    """
    is_upload = F.col("upload_id").isNotNull()
    seen = events.groupBy("file_hash").agg(
        F.min(F.when(is_upload, F.struct("upload_id", "path", "row", "verdict"))).alias("first"),
        F.max_by(F.when(~is_upload, F.col("verdict")), F.when(~is_upload & F.col("verdict").isNotNull(), F.col("row"))).alias("late"))
    before = files.select(F.col("file_hash").alias("known_hash"), F.col("status").alias("before"), F.col("document_id").alias("held_id"))
    # A null text has the hash null, which is one file.
    each = seen.join(before, F.col("file_hash").eqNullSafe(F.col("known_hash")), "left")
    known = F.coalesce(F.col("before").isin(INDEXED, PROCESSING), F.lit(False))
    each = each.select(
        F.col("file_hash").alias("hash"), "before", "late", "first", known.alias("known"),
        F.coalesce("held_id", "first.upload_id").alias("document_id"),
        (~known & F.col("first").isNotNull()).alias("opens"))

    opened = F.when(F.col("opens"), F.coalesce("first.verdict", F.lit(PROCESSING)))
    changed = each.where("(opens OR late IS NOT NULL) AND document_id IS NOT NULL").select(
        F.col("hash").alias("file_hash"), F.coalesce("late", opened, "before").alias("status"), "document_id")

    judged = events.where(is_upload).join(each, F.col("file_hash").eqNullSafe(F.col("hash")))
    is_first = F.col("row") == F.col("first.row")
    outcome = (F.when(F.col("before") == INDEXED, ALREADY_INDEXED).when(F.col("known") | ~is_first, ALREADY_PROCESSING)
               .otherwise(QUEUED))
    action = F.when(F.col("known") | ~is_first, "REUSE").when(F.col("before").isNull(), "CREATE").otherwise("RESET")
    status = F.when(F.col("known"), F.col("before")).otherwise(F.coalesce("verdict", F.lit(PROCESSING)))
    outcomes = judged.select("file_hash", "upload_id", "path", "document_id", outcome.alias("outcome"),
                             action.alias("action"), status.alias("status"))
    return outcomes, changed


def file_states(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """(file_hash, status, document_id) of all files as they were before a batch. Reads a row per change of a file."""
    try:
        told = spark.read.schema(f"{FILE}, batch long").parquet(f"{base}/files")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILE)
    last = told.where(F.col("batch") < batch).groupBy("file_hash").agg(
        F.max(F.struct("batch", "status", "document_id")).alias("last"))
    return last.select("file_hash", "last.status", "last.document_id")


def watch_files(spark: SparkSession, folder: str, schema: str, glob: str = "*", per_run: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive, each row with the path of its file."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_run)
    return reader.parquet(folder).withColumn("path", F.col("_metadata.file_path"))


def ingest_files(
    spark: SparkSession,
    folder: str,
    schema: str,
    base: str,
    *,
    id_col: str = "document_id",
    text_col: str = "text",
    strategy: str = "RECURSIVE",
    glob: str = "*",
    per_run: int = 1000,
    buckets: int = sinks.BUCKETS,
) -> StreamingQuery:
    """Register, segment and store the documents that arrive in ``folder``, up to what is there now.

    Under ``base``: ``chunks`` (the chunk table), ``status`` (a row per upload: outcome, action, document id and the state
    its file ends in), ``files`` (a row per change of a file), ``state`` (the checkpoint). A document whose text is blank fails. A failed one that arrives again
    is reset: its chunks are replaced. A batch that is run again adds nothing: chunks are compared with what is stored,
    and the rows that it wrote to ``status`` and ``files`` before are replaced.
    """
    name = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`").cast("string")
    arriving = watch_files(spark, folder, schema, glob, per_run)
    verdict = F.when(tx.is_blank(text), FAILED).otherwise(INDEXED)
    events = arriving.select(tx.chunk_hash(text).alias("file_hash"), name.alias("upload_id"), "path", verdict.alias("verdict"))

    def ingest(arrived: DataFrame, batch: int) -> None:
        session = arrived.sparkSession
        told = settle(arrived.withColumn("row", F.monotonically_increasing_id()), "events")
        outcomes, changed = register(told, file_states(session, base, batch))
        done, files = settle(outcomes, "outcomes"), settle(changed, "changed-files")
        discard(told)
        wanted = done.where(F.col("outcome") == QUEUED)
        paths = [r[0] for r in wanted.select("path").distinct().collect()]  # at most the files of a batch
        if paths:
            good = wanted.where(F.col("status") == INDEXED).select("upload_id", "path", "document_id", "action")
            texts = session.read.schema(schema).parquet(*paths).select(
                name.alias("upload_id"), F.col("_metadata.file_path").alias("path"), text.alias("text"), tx.chunk_hash(text).alias("file_hash"))
            docs = texts.join(good, ["upload_id", "path"]).dropDuplicates(["file_hash"]).select(
                "document_id", "text", "action", F.lit(strategy).alias("strategy"))
            cut = segment.segment_by_strategy(docs.select("document_id", "text", "strategy"))
            rows = settle(sinks.stored_chunk_rows(dedupe_chunks(cut)), "new-chunks")
            reset = wanted.where(F.col("action") == "RESET").select("document_id").distinct()
            if not reset.isEmpty():
                again = rows.join(reset, "document_id", "left_semi")
                sinks.replace_documents(session, f"{base}/chunks", reset, again, buckets)
            sinks.append_new_chunks(session, rows, f"{base}/chunks", buckets)
            discard(rows)
        for rows, name_of in ((done, "status"), (files, "files")):
            rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch").option(
                "partitionOverwriteMode", "dynamic").parquet(f"{base}/{name_of}")
        discard(files)
        discard(done)

    return (
        events.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )


def statuses(spark: SparkSession, base: str) -> DataFrame:
    """What every upload came to."""
    return spark.read.schema(f"{OUTCOME}, batch long").parquet(f"{base}/status")
