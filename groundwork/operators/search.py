"""Hybrid retrieval: vector ranking and text ranking fused into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import is_blank
from groundwork.operators import fulltext as ft
from groundwork.operators.scope import with_visibility
from groundwork.operators.vector_search import vector_topk
from groundwork.session import settle
from groundwork.sources.postings import TextIndex

RANK_OFFSET = 60
TOP_K = 4


def rrf_fuse(vector: DataFrame, text: DataFrame, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of a vector ranking and a text ranking.

    ``vector(query_id, chunk_id, rank, similarity)``,
    ``text(query_id, chunk_id, text_rank, lexical_score, full_text_match)``. A rank that is
    missing stays null. Equal scores keep the vector list in front, then list order.
    """
    left = vector.select(
        "query_id",
        "chunk_id",
        F.col("rank").alias("vector_rank"),
        F.col("similarity").alias("vector_similarity"),
    )
    right = text.select("query_id", "chunk_id", "text_rank", "lexical_score", "full_text_match")

    def share(rank: str):
        return F.coalesce(F.lit(1.0) / (F.lit(RANK_OFFSET) + F.col(rank)), F.lit(0.0))

    best = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("vector_rank"), "text_rank"
    )
    fused = (
        left.join(right, ["query_id", "chunk_id"], "full_outer")
        .withColumn("score", share("vector_rank") + share("text_rank"))
        .withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0)))
        .withColumn("full_text_match", F.coalesce("full_text_match", F.lit(False)))
        .withColumn("rank", F.row_number().over(best))
    )
    return fused if top_k is None else fused.where(F.col("rank") <= top_k)


def fuse_lists(rankings: list[DataFrame]) -> DataFrame:
    """Fusion of any number of ``(query_id, chunk_id, rank)`` lists: ``score`` per pair."""
    stacked = rankings[0].select("query_id", "chunk_id", "rank")
    for ranking in rankings[1:]:
        stacked = stacked.unionByName(ranking.select("query_id", "chunk_id", "rank"))
    share = F.lit(1.0) / (F.lit(RANK_OFFSET) + F.col("rank"))
    return stacked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share), 9).alias("score"))


def hybrid_search(
    questions: DataFrame,
    chunks: DataFrame,
    words: ft.Vocabulary,
    visibility: DataFrame | None = None,
    vectors: DataFrame | None = None,
    dimensions: int = 768,
    top_k: int = TOP_K,
    index: TextIndex | None = None,
) -> DataFrame:
    """Best chunks per question.

    ``questions(query_id, query[, scope][, embedding])``,
    ``chunks(chunk_id, document_id, title, content)``,
    ``vectors(chunk_id, document_id, embedding)``. Without vectors only the text ranking counts,
    as when no embedding model can be reached. ``index`` is the stored index of the chunks; without one
    an index is written for this search.
    """
    asked, askers = ask_once(questions.where(~is_blank(F.col("query"))))
    if index is None:
        matches = ft.match_questions(chunks, asked, words, visibility)
    else:
        matches = ft.match_index(index, asked, words, visibility)
    text = ft.lexical_candidates(matches, chunks, asked, words)
    if vectors is None or "embedding" not in questions.columns:
        vector = text.sparkSession.createDataFrame([], _vector_schema(text))
    else:
        if visibility is not None:
            kind = dict(visibility.dtypes)["subjects"].removeprefix("array<").removesuffix(">")
            vectors = with_visibility(vectors, visibility, kind)
        vector = vector_topk(vectors, asked, dimensions)
    found = rrf_fuse(vector, text, top_k)
    return found.join(askers, "query_id").drop("query_id").withColumnRenamed("_asker", "query_id")


def ask_once(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions without repetitions, and ``query_id, _asker``: who asked each of them.

    The same words in the same scope find the same chunks, however often they are asked.
    """
    key = ["query", *[c for c in ("scope",) if c in questions.columns]]
    rest = [c for c in questions.columns if c not in ("query_id", *key)]
    once = questions.groupBy(*key).agg(
        F.min("query_id").alias("query_id"), *[F.min_by(c, "query_id").alias(c) for c in rest]
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    condition = same[0] if len(same) == 1 else same[0] & same[1]
    askers = questions.alias("a").join(once.alias("b"), condition)
    return settle(once, "asked"), askers.select(
        F.col("b.query_id").alias("query_id"), F.col("a.query_id").alias("_asker")
    )


def _vector_schema(text: DataFrame) -> str:
    kinds = dict(text.dtypes)
    return f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, similarity double, rank int"


def with_sources(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Result rows with the title and text of their chunk.

    An inner join, so that the optimizer may ship the few results and leave the texts where they lie.
    Written ``results`` tell it their size.
    """
    return results.join(chunks, "chunk_id")
