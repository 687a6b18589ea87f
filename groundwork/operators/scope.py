"""Which documents a question may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.where(F.col("active"))


def resolve_subject_scope(
    questions: DataFrame, requests: DataFrame, subjects: DataFrame
) -> DataFrame:
    """``query_id, scope``: the active subjects a question asked for.

    The scope is null, meaning default visibility, when nothing was asked for, nothing usable is
    left, or every active subject is covered.
    """
    active = active_subjects(subjects).select("subject_id")
    asked = requests.where(F.col("subject_id").isNotNull()).select("query_id", "subject_id")
    usable = (
        asked.distinct()
        .join(active, "subject_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list("subject_id")).alias("scope"))
    )
    all_active = active.agg(F.count(F.lit(1))).scalar()
    narrowed = F.when(F.size("scope") < all_active, F.col("scope"))
    joined = questions.select("query_id").join(usable, "query_id", "left")
    return joined.select("query_id", narrowed.alias("scope"))


def document_visibility(doc_subjects: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per tagged document its active subjects and whether the default scope sees it.

    One grouped pass instead of the two existence tests. A document that does not occur here has
    no subject at all, and is visible by default.
    """
    flags = subjects.select("subject_id", "active")
    active = F.when(F.col("active"), F.col("subject_id"))
    return (
        doc_subjects.join(flags, "subject_id")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_set(active)).alias("subjects"))
        .select("document_id", "subjects", (F.size("subjects") > 0).alias("default_visible"))
    )


def with_visibility(rows: DataFrame, visibility: DataFrame, id_type: str) -> DataFrame:
    """Rows of documents that some question could see, with ``subjects, default_visible``."""
    none = F.array().cast(f"array<{id_type}>")
    return (
        rows.join(visibility, "document_id", "left")
        .withColumn("subjects", F.coalesce("subjects", none))
        .withColumn("default_visible", F.coalesce("default_visible", F.lit(True)))
        .where(F.col("default_visible"))
    )


def sees(scope: Column) -> Column:
    """Whether a question of this scope sees a row that carries its visibility."""
    return F.when(scope.isNull(), F.col("default_visible")).otherwise(
        F.arrays_overlap(F.col("subjects"), scope)
    )


def visible_docs_default(
    docs: DataFrame, doc_subjects: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Documents with an active subject, or with none at all."""
    flags = document_visibility(doc_subjects, subjects).select("document_id", "default_visible")
    joined = docs.join(flags, "document_id", "left")
    return joined.where(F.coalesce("default_visible", F.lit(True))).drop("default_visible")


def visible_docs_filtered(
    scopes: DataFrame, doc_subjects: DataFrame, subjects: DataFrame
) -> DataFrame:
    """``query_id, document_id`` for the questions that have a scope."""
    wanted = scopes.where(F.col("scope").isNotNull()).select(
        "query_id", F.explode("scope").alias("subject_id")
    )
    tagged = doc_subjects.join(active_subjects(subjects).select("subject_id"), "subject_id", "left_semi")
    return wanted.join(tagged, "subject_id").select("query_id", "document_id").distinct()
