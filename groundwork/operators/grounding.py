"""Is there enough evidence to answer, and what the answer is made of.

Result rows are ``query_id, rank, document_title, chunk_title, content, metadata, similarity,
lexical_score, full_text_match``; a question has only as many as a search returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.functions.text import escape_prompt_tags, is_blank, trim
from groundwork.sources.tables import METADATA_SCHEMA

SIMILARITY_THRESHOLD = 0.65
MIN_LEXICAL_SCORE = 4.0


def _real(similarity: Column) -> Column:
    return F.when(~F.isnan(similarity), similarity)


def is_evidence(
    similarity_threshold: float = SIMILARITY_THRESHOLD, min_lexical: float = MIN_LEXICAL_SCORE
) -> Column:
    """Whether one result grounds an answer: near enough, matched in full, or scored high."""
    near = F.coalesce(_real(F.col("similarity")) >= similarity_threshold, F.lit(False))
    return near | F.col("full_text_match") | (F.col("lexical_score") >= min_lexical)


def is_grounded(questions: DataFrame, results: DataFrame, **thresholds: float) -> DataFrame:
    """``query_id, grounded``; a question without results is not grounded."""
    judged = results.groupBy("query_id").agg(F.bool_or(is_evidence(**thresholds)).alias("grounded"))
    joined = questions.select("query_id").join(judged, "query_id", "left")
    return joined.select("query_id", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def best_similarity(questions: DataFrame, results: DataFrame) -> DataFrame:
    best = results.groupBy("query_id").agg(
        F.max(_real(F.col("similarity"))).alias("best_similarity")
    )
    return questions.select("query_id").join(best, "query_id", "left")


def _named(title: Column, before: str, after: str, shown: Column) -> Column:
    return F.when(is_blank(title), F.lit("")).otherwise(F.concat(F.lit(before), shown, F.lit(after)))


def extractive_answer(results: DataFrame) -> DataFrame:
    """``query_id, answer``: the text of the first result and where it comes from."""
    chunk = F.col("chunk_title")
    answer = F.concat(
        trim(F.col("content")),
        F.lit("\n\n— Fonte Oficial: "),
        F.col("document_title"),
        _named(chunk, " (", ")", chunk),
    )
    return results.where(F.col("rank") == 1).select("query_id", answer.alias("answer"))


def extract_citations(results: DataFrame) -> DataFrame:
    """``query_id, citations``: what each result points at, in rank order, as a JSON array.

    Metadata that cannot be read gives a citation without page or numbers.
    """
    read = F.from_json("metadata", METADATA_SCHEMA, {"mode": "PERMISSIVE"})
    rows = results.withColumn("_m", read)
    citation = F.struct(
        F.col("document_title").alias("documentTitle"),
        F.col("chunk_title").alias("chunkTitle"),
        F.col("_m.page").alias("pageNumber"),
        F.col("_m.questionNumber").alias("questionNumber"),
        F.col("_m.articleNumber").alias("articleNumber"),
        F.col("_m.legalBasis").alias("legalBasis"),
    )
    gathered = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", citation.alias("citation")))).alias("_c")
    )
    return gathered.select("query_id", F.transform("_c", lambda c: c["citation"]).alias("citations"))


def build_context(questions: DataFrame, results: DataFrame) -> DataFrame:
    """``query_id, prompt``: numbered sources and the question, tags in the data made harmless."""
    title = F.concat(
        escape_prompt_tags(F.col("document_title")),
        _named(F.col("chunk_title"), " | ", "", escape_prompt_tags(F.col("chunk_title"))),
    )
    block = F.concat(
        F.lit('<source index="'), F.col("rank").cast("string"), F.lit('">\n<title>'), title,
        F.lit("</title>\n<excerpt>\n"), escape_prompt_tags(trim(F.col("content"))),
        F.lit("\n</excerpt>\n</source>\n"),
    )
    sources = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_s")
    )
    joined = questions.select("query_id", "query").join(sources, "query_id", "left")
    blocks = F.coalesce(F.array_join(F.transform("_s", lambda s: s["block"]), ""), F.lit(""))
    prompt = F.concat(
        F.lit("<official_context>\n"), blocks, F.lit("</official_context>\n\n<user_question>\n"),
        escape_prompt_tags(trim(F.col("query"))), F.lit("\n</user_question>"),
    )
    return joined.select("query_id", prompt.alias("prompt"))


def answer_or_refuse(
    questions: DataFrame, results: DataFrame, model: str = "extractive", **thresholds: float
) -> DataFrame:
    """``query_id, grounded, answer, model_used, citations``; no evidence means the fixed refusal."""
    verdict = is_grounded(questions, results, **thresholds)
    joined = verdict.join(extractive_answer(results), "query_id", "left").join(
        extract_citations(results), "query_id", "left"
    )
    grounded = F.col("grounded")
    return joined.select(
        "query_id",
        "grounded",
        F.when(grounded, F.col("answer")).otherwise(lex.REFUSAL_MESSAGE).alias("answer"),
        F.when(grounded, model).otherwise(lex.REFUSAL_MODEL).alias("model_used"),
        F.when(grounded, F.col("citations")).alias("citations"),
    )
