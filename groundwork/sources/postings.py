"""The search index on disk: for every search token of the stored chunks, where it occurs.

``postings`` holds (term, chunk_id, document_id, hits, positions, batch) in ``term_bucket`` folders, rows of a term together;
``terms`` holds in how many chunks of a batch each term occurs. Both are appended to when chunks are ingested. A
search reads the folders of its terms and never the text. ``removed`` says up to which batch the postings of a
document are dead, so that documents can be replaced without rewriting folders.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text as tx

BUCKETS = 64
# Tasks that share the postings of a folder while they are written: a word of many chunks is dealt out over them.
PARTS = 4


def term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def tokens_of(chunks: DataFrame, stop_words: Sequence[str], *more: str) -> DataFrame:
    """A row per search token of ``chunks(chunk_id, document_id, title, content)``: with term and position."""
    text = F.concat_ws(" ", "title", "content")
    spelled = chunks.select("document_id", "chunk_id", *more, F.posexplode(tx.words(text)).alias("position", "word"))
    kept = spelled.where(F.expr(f"word NOT IN ({tx.quoted(['', *stop_words])})"))
    return kept.select("document_id", "chunk_id", *more, "position", tx.stem(F.col("word")).alias("term"))


def postings_of(chunks: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(term, chunk_id, document_id, hits, positions) of every term of every chunk.

    The tokens of a chunk come out of its row one behind the other, so they are brought together before anything is
    shuffled. Only rows that share a chunk id are grouped by it.
    """
    ids = ["chunk_id", "document_id"]
    kinds = dict(chunks.dtypes)
    schema = f"term string, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, hits int, positions array<int>"
    repeated = chunks.groupBy(*ids).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in ids])
    whole = F.lit(True)
    for c in ids:
        whole &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    some = not repeated.isEmpty()
    single = chunks.join(repeated, whole, "left_anti") if some else chunks
    each = tokens_of(single.withColumn("row", F.monotonically_increasing_id()), stop_words, "row").mapInArrow(_by_row, schema)
    if not some:
        return each
    tokens = tokens_of(chunks.join(repeated, whole, "left_semi"), stop_words)
    return each.unionByName(tokens.groupBy("term", *ids).agg(
        F.count("*").cast("int").alias("hits"), F.array_sort(F.collect_list("position")).alias("positions")))


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of whole rows at a time; the tokens of the last row of a batch may go on in the next."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("row").to_numpy()
        cut = int(np.searchsorted(rows, rows[-1]))
        if held and (cut or rows[-1] != last):
            yield from _grouped(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from _grouped(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
        last = rows[-1]
    if held:
        yield from _grouped(pa.Table.from_batches(held))


def _grouped(tokens: pa.Table) -> Iterator[pa.RecordBatch]:
    row = tokens.column("row").to_numpy()
    terms = tokens.column("term").combine_chunks().dictionary_encode()
    number = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    key = number * len(terms.dictionary) + terms.indices.to_numpy()
    order = np.argsort(key, kind="stable")  # positions stay in order
    starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    ends = np.append(starts, len(order)).astype(np.int32)
    position = tokens.column("position").to_numpy()[order].astype(np.int32)
    firsts = tokens.select(["term", "chunk_id", "document_id"]).take(pa.array(order[starts]))
    hits = pa.array(np.diff(ends), pa.int32())
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(position))
    yield from firsts.append_column("hits", hits).append_column("positions", positions).to_batches()


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder. ``stop_words`` and ``buckets`` belong to it: reading needs those it was written with."""

    spark: SparkSession
    folder: str
    stop_words: tuple[str, ...]
    buckets: int = BUCKETS
    parts: int = PARTS

    def append(self, chunks: DataFrame) -> None:
        """Index chunks that are not indexed yet. Postings shuffle once; folders of a common word are split by chunk."""
        batch = time.time_ns()
        chunks.select("chunk_id", "document_id").limit(0).write.mode("ignore").parquet(f"{self.folder}/ids")
        dealt = postings_of(chunks, self.stop_words).select(
            "*", term_bucket(self.buckets).alias("term_bucket"),
            F.pmod(F.xxhash64("chunk_id"), F.lit(self.parts)).alias("part")).repartition("term_bucket", "part")
        # Terms first: the folders are few, and the write gathers them by itself.
        ordered = dealt.drop("part").withColumn("batch", F.lit(batch)).sortWithinPartitions("term", "chunk_id")
        ordered.write.mode("append").partitionBy("term_bucket").parquet(f"{self.folder}/postings")
        written = self._read("postings").where(F.col("batch") == batch)
        counted = written.groupBy("term_bucket", "term").agg(F.count("*").alias("chunks"), F.sum("hits").alias("hits"))
        counted.repartition("term_bucket").write.mode("append").partitionBy("term_bucket").parquet(f"{self.folder}/terms")

    def remove(self, documents: DataFrame) -> None:
        """The postings that documents have so far no longer count. Chunks indexed later do."""
        dead = documents.select("document_id").distinct().withColumn("upto", F.lit(time.time_ns()))
        dead.write.mode("append").parquet(f"{self.folder}/removed")

    def postings(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Living postings, of some folders only."""
        rows = self._folders("postings", buckets)
        try:
            removed = self.spark.read.parquet(f"{self.folder}/removed").groupBy("document_id").agg(F.max("upto").alias("upto"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return rows
        dead = removed.withColumnRenamed("document_id", "_gone")
        return rows.join(dead, (F.col("document_id") == F.col("_gone")) & (F.col("batch") <= F.col("upto")), "left_anti")

    def terms(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """(term, chunks): how many chunks hold a term, those of removed documents included."""
        return self._folders("terms", buckets).groupBy("term").agg(F.sum("chunks").alias("chunks"))

    def _read(self, name: str) -> DataFrame:
        """A table of the index; one that holds no row yet has no files."""
        ids = self.spark.read.parquet(f"{self.folder}/ids").schema  # the types of both ids are those of the chunks
        kinds = {f.name: f.dataType.simpleString() for f in ids.fields}
        schema = {"postings": f"term string, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, hits int, "
                              "positions array<int>, batch long, term_bucket int",
                  "terms": "term string, chunks long, hits long, term_bucket int"}[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _folders(self, name: str, buckets: Sequence[int] | None) -> DataFrame:
        rows = self._read(name)
        return rows if buckets is None else rows.where(F.col("term_bucket").isin([int(b) for b in buckets]))
