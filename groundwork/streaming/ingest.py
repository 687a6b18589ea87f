"""Documents and chunks that arrive as files, processed once each.

The checkpoint remembers what was processed; running again picks up where the last run stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwork.operators import segment
from groundwork.operators.embedding import missing_vectors
from groundwork.operators.ingest import dedupe_chunks
from groundwork.sources import sinks


def watch(spark: SparkSession, folder: str, schema: str, glob: str = "*", per_run: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive. ``glob`` selects by the names of the files, not of folders above them."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", per_run).parquet(folder)


def first_of_each_file(docs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream ``..., text, at`` without repeated contents inside the watermark."""
    hashed = docs.withColumn("file_hash", F.sha2("text", 256)).withWatermark("at", delay)
    return hashed.dropDuplicatesWithinWatermark(["file_hash"])


def incremental_ingest(docs: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Segment new documents ``document_id, text, strategy`` and append their new chunks.

    A document without a strategy is cut as it would have been registered. Segmenting is row by row; only the append looks at what is stored, once per micro-batch, so
    a batch that is run again adds nothing.
    """
    registered = segment.registered_strategy(F.col("strategy"))
    chunks = segment.segment_by_strategy(docs.withColumn("strategy", registered))

    def append(batch: DataFrame, _: int) -> None:
        rows = sinks.stored_chunk_rows(dedupe_chunks(batch))
        sinks.append_new_chunks(batch.sparkSession, rows, table, buckets)

    return (
        chunks.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pending_work(chunks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Hand on the chunks ``chunk_id, document_id, embedding`` that arrived without a vector."""
    waiting = missing_vectors(chunks).select("chunk_id", "document_id")
    return (
        waiting.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
