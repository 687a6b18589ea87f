"""What ingestion leaves on disk for the searches: written once per session and folder of tables, then only read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as tx
from groundwork.functions import vectors as vx
from groundwork.operators import vector_search
from groundwork.plans import duck
from groundwork.plans.views import STOP_WORDS, Inputs
from groundwork.session import scratch_dir, settle
from groundwork.sources.postings import TextIndex
from groundwork.sources.vector_index import VectorIndex

_MADE: dict[tuple[str, str, str], object] = {}


def _once(i: Inputs, name: str, make: Callable[[], object]):
    key = (i.spark.sparkContext.applicationId, i.folder, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def text_index(i: Inputs) -> TextIndex:
    """The posting table of ``chunk_docs``."""

    def make() -> TextIndex:
        index = TextIndex(i.spark, scratch_dir(i.spark, "text-index"), tuple(STOP_WORDS))
        index.append(i.chunk_docs)
        return index

    return _once(i, "text", make)


def chunk_vectors(i: Inputs) -> DataFrame:
    """The chunk table's vectors, embedded with the expression of the built-in model."""
    whole = tx.embedding_text(F.col("title"), F.col("content"))
    return _once(i, "vectors", lambda: settle(i.chunk_docs.select(
        "chunk_id", "document_id", vx.hashed_words(whole, duck.DIMENSIONS).alias("embedding")), "chunk-vectors"))


def vector_index(i: Inputs) -> VectorIndex:
    """The index over ``vec_chunks``, with its probes measured."""

    def make() -> VectorIndex:
        index = VectorIndex(i.spark, scratch_dir(i.spark, "vector-index"), duck.DIMENSIONS)
        index.create(i.vec_chunks.select("chunk_id", "document_id", "embedding"))
        vector_search.measure_probes(index)
        return index

    return _once(i, "vector-index", make)
