"""Uploaded files: read as bytes, checked by signature, named by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PDF_SIGNATURE = b"%PDF-"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every file under a folder as ``file_name, content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file_name"), "content")


def intake_manifest(
    files: DataFrame, signature: bytes = PDF_SIGNATURE, extension: str = ".pdf"
) -> DataFrame:
    """Files of the wanted kind with hash, size and storage name. Others are left out."""
    starts_right = F.substring("content", 1, len(signature)) == F.lit(bytearray(signature))
    digest = F.sha2("content", 256)
    return files.where(starts_right).select(
        "file_name",
        digest.alias("file_hash"),
        F.octet_length("content").cast("long").alias("file_size"),
        F.concat(digest, F.lit(extension)).alias("storage_path"),
    )
