"""How good a retrieval is, measured against questions with known answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import is_small, settle, ship


# Short passages that one pass over the documents looks for.
SHORT_PASSAGES = 100_000


def passages_in(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, chunk_id``: the documents that contain a passage word for word.

    The first word of a passage may start inside a document's word and the last one end inside; those between are words
    of the document. Each passage is looked for where its rarest word between is, so it meets few documents whatever
    else it shares with them. Passages of one or two words have no word between: one automaton finds them all in the
    scan. An empty passage is in every document, a null one or a null text in or with none.
    """
    words = F.split("text", r"\s")
    between = F.filter(F.array_distinct(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))), lambda w: w != "")
    asked = passages.where("text IS NOT NULL").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("_passage"), between.alias("_between")).distinct()
    asked = settle(asked, "passages")
    spelled = asked.select("query_id", "_passage", F.size("_between").alias("_size"), F.explode("_between").alias("_word"))
    used = spelled.select("_word").distinct()
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), "text")
    held = rows.select("chunk_id", F.explode(F.array_distinct(words)).alias("_word"))
    held = settle(held.join(ship(used, is_small(used)), "_word", "left_semi"), "passage-words")
    common = held.groupBy("_word").agg(F.count("*").alias("_docs"))
    # A word between that no document has rules the passage out.
    anchors = spelled.join(common, "_word").groupBy("query_id", "_passage", "_size").agg(
        F.count("*").alias("_known"), F.min(F.struct("_docs", "_word"))["_word"].alias("_word")).where("_known = _size")
    pairs = held.join(anchors.select("query_id", "_passage", "_word"), "_word").select("query_id", "_passage", "chunk_id")
    long = rows.join(pairs.distinct(), "chunk_id").where(F.contains("text", "_passage")).select("query_id", "chunk_id")
    return long.unionByName(_short_passages(asked.where(F.size("_between") == 0), rows)).distinct()


def _short_passages(asked: DataFrame, rows: DataFrame) -> DataFrame:
    kinds = dict(asked.dtypes) | dict(rows.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}"
    blocks = -(-asked.count() // SHORT_PASSAGES)
    block = F.pmod(F.xxhash64("query_id", "_passage"), F.lit(max(1, blocks)))
    found = asked.sparkSession.createDataFrame([], schema)
    for n in range(blocks):
        some = asked.where(block == n).select("query_id", "_passage").toArrow()
        shared = asked.sparkSession.sparkContext.broadcast(some)
        found = found.unionByName(rows.mapInArrow(_holders(shared), schema))
    return found


def _holders(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asked = {}
        for query, passage in zip(*(shared.value.column(c).to_pylist() for c in ("query_id", "_passage"))):
            asked.setdefault(passage, []).append(query)
        automaton = ahocorasick.Automaton()
        for passage in filter(None, asked):
            automaton.add_word(passage, passage)
        if len(automaton):
            automaton.make_automaton()
        kind = shared.value.schema.field("query_id").type
        for batch in batches:
            queries, at = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                held = {passage for _, passage in automaton.iter(text)} if len(automaton) and text else set()
                for passage in held | ({""} & asked.keys()):
                    queries += asked[passage]
                    at += [n] * len(asked[passage])
            yield pa.record_batch([pa.array(queries, kind), batch.column("chunk_id").take(pa.array(at, pa.int64()))],
                                  names=["query_id", "chunk_id"])

    return run


def judge(questions: DataFrame, results: DataFrame, golden: DataFrame) -> DataFrame:
    """Per question: expected chunks, how many were found, rank of the first, results in all."""
    expected = golden.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    marked = results.select("query_id", "chunk_id", "rank").join(
        golden.withColumn("_hit", F.lit(True)), ["query_id", "chunk_id"], "left"
    )
    found = marked.groupBy("query_id").agg(
        F.count_if("_hit").alias("hits"),
        F.min(F.when(F.col("_hit"), F.col("rank"))).alias("first_hit"),
        F.count(F.lit(1)).alias("results"),
    )
    joined = questions.select("query_id").join(expected, "query_id", "left").join(found, "query_id", "left")
    return joined.select(
        "query_id",
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        "first_hit",
        F.coalesce("results", F.lit(0)).alias("results"),
        F.col("expected").isNotNull().alias("in_corpus"),
    )


def summarize(judged: DataFrame, k: int) -> DataFrame:
    """One row of measures. A question without an answer in the corpus should get no result."""
    known = F.col("in_corpus")
    first = known & (F.col("first_hit") == 1)

    def mean(value):
        return F.round(F.avg(F.when(known, value)), 6)

    return judged.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(known).alias("answerable"),
        F.count_if(first).alias("hits_at_1"),
        mean(F.coalesce((F.col("first_hit") == 1).cast("int"), F.lit(0))).alias("hit_rate"),
        mean(F.col("hits") / F.col("expected")).alias("recall"),
        mean(F.col("hits") / k).alias("precision"),
        mean(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))).alias("mean_reciprocal_rank"),
        F.count_if(~known & (F.col("results") == 0)).alias("refused"),
    )
