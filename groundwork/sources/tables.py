"""Stored tables: explicit schemas, pruned scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType([
    T.StructField("document_id", T.LongType(), False),
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("chunk_hash", T.StringType(), False),
    T.StructField("sequence_number", T.IntegerType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType(), False),
    T.StructField("metadata", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CITATION_SCHEMA = T.StructType([
    T.StructField("documentTitle", T.StringType()),
    T.StructField("chunkTitle", T.StringType()),
    T.StructField("pageNumber", T.IntegerType()),
    T.StructField("questionNumber", T.IntegerType()),
    T.StructField("articleNumber", T.StringType()),
    T.StructField("legalBasis", T.StringType()),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("questionNumber", T.IntegerType()),
    T.StructField("articleNumber", T.StringType()),
    T.StructField("legalBasis", T.StringType()),
])


def scan(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A Parquet table, only the named columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    return table.select(*columns) if columns else table


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    splits: int,
    **options: str,
) -> DataFrame:
    """A table of a relational store, read by ``splits`` tasks over ranges of a number column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=split_column, **options)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", splits)
        .load()
    )


def spread(table: DataFrame, key: str) -> DataFrame:
    """Hash a table of a few files over all cores.

    Worth it where each row costs much and a file has one row group, which is one task. A table
    of many files already has enough tasks and is left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if len(table.inputFiles()) < cores else table
