"""The document catalog and its subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.embedding import embedding_progress


def docs_by_subject(docs: DataFrame, doc_subjects: DataFrame, subject_id: str) -> DataFrame:
    tagged = doc_subjects.where(F.col("subject_id") == subject_id).select("document_id")
    return docs.join(tagged, "document_id", "left_semi")


def docs_by_status(docs: DataFrame, status: str) -> DataFrame:
    return docs.where(F.col("status") == status)


def any_processing(docs: DataFrame) -> DataFrame:
    """One row: is any document still being processed?"""
    stuck = F.coalesce(F.bool_or(F.col("status") == "PROCESSING"), F.lit(False))
    return docs.agg(stuck.alias("any_processing"))


def catalog_list(
    docs: DataFrame,
    doc_subjects: DataFrame,
    subjects: DataFrame,
    subject_id: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Documents with the names of all their subjects. A subject filter outranks a status filter."""
    if subject_id is not None:
        docs = docs_by_subject(docs, doc_subjects, subject_id)
    elif status is not None and status.strip():
        docs = docs_by_status(docs, status)
    named = doc_subjects.join(subjects.select("subject_id", "name"), "subject_id")
    names = named.groupBy("document_id").agg(F.array_sort(F.collect_list("name")).alias("subjects"))
    joined = docs.join(names, "document_id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("subjects", F.coalesce("subjects", none))


def catalog_progress(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """The catalog with embedding progress, for indexed documents that have chunks."""
    progress = embedding_progress(chunks)
    joined = catalog.join(progress, "document_id", "left")
    shown = F.col("status") == "INDEXED"
    return joined.select(
        *catalog.columns,
        *[F.when(shown, F.col(c)).alias(c) for c in ("total", "embedded", "complete")],
    )


def toggle_active(subjects: DataFrame, requests: DataFrame) -> DataFrame:
    """Subjects after a batch of toggles: the flag flips once per request."""
    counted = requests.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_toggles"))
    flips = F.coalesce("_toggles", F.lit(0)) % 2 == 1
    joined = subjects.join(counted, "subject_id", "left")
    return joined.withColumn("active", F.col("active") != flips).drop("_toggles")


def new_subjects(subjects: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``request_id, code, name`` with their outcome: a code is created once."""
    first = Window.partitionBy("code").orderBy("request_id")
    held = subjects.select("code").distinct().withColumn("_held", F.lit(True))
    created = (
        requests.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .join(held, "code", "left_anti")
        .select("request_id", F.lit(True).alias("_created"))
    )
    joined = requests.join(created, "request_id", "left")
    outcome = F.when(F.col("_created"), "CREATED").otherwise("DUPLICATE_CODE")
    return joined.select(*requests.columns, outcome.alias("outcome"))
