"""Keeping chunk vectors complete: what is missing, how far along, and embedding itself."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as tx
from groundwork.functions import vectors as vx
from groundwork.operators.ordered import number_rows
from groundwork.session import settle

BATCH_SIZE = 16

EmbedFunction = Callable[[list[str]], Sequence[Sequence[float]]]


def validate_vectors(chunks: DataFrame, dimensions: int) -> DataFrame:
    return chunks.withColumn("problem", vx.vector_problem(F.col("embedding"), dimensions))


def missing_vectors(chunks: DataFrame, force_all: bool = False) -> DataFrame:
    """Chunks that need a vector; all of them when a full rebuild is asked for."""
    return chunks if force_all else chunks.where(vx.is_missing(F.col("embedding")))


def keyset_batches(chunks: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """The batches a keyset scan in id order would read, numbered from 1.

    The rows are dealt by ranges of the id, whatever its type, and written down: where the ranges end is
    sampled anew each time a plan runs. Give it only the columns that the batches need.
    """
    ranges = chunks.repartitionByRange("chunk_id").withColumn("_range", F.spark_partition_id())
    ranges = settle(ranges, "id-ranges")
    numbered = number_rows(ranges, [], [F.col("chunk_id")], F.col("_range"), "_rn")
    return numbered.withColumn("batch", F.ceil(F.col("_rn") / size).cast("long")).drop("_rn", "_range")


def next_batch(chunks: DataFrame, after: int | str | None, size: int = BATCH_SIZE) -> DataFrame:
    """The chunks that follow an id."""
    rest = chunks if after is None else chunks.where(F.col("chunk_id") > after)
    return rest.orderBy("chunk_id").limit(size)


def embedding_progress(chunks: DataFrame) -> DataFrame:
    usable = ~vx.is_missing(F.col("embedding"))
    counted = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(usable).alias("embedded")
    )
    return counted.withColumn("complete", F.col("embedded") >= F.col("total"))


def hash_embedding(chunks: DataFrame, text: Column, dimensions: int = 64) -> DataFrame:
    """Chunks with the deterministic bag-of-words vector of a text."""
    return chunks.withColumn("embedding", vx.hashed_words(text, dimensions))


def hashing_model(dimensions: int = 64) -> EmbedFunction:
    """The same bag-of-words vector as a plain function, the default model."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        vectors = []
        for text in texts:
            decomposed = unicodedata.normalize("NFD", text.lower())
            bare = "".join(c for c in decomposed if not unicodedata.category(c).startswith("M"))
            slots = [
                int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions
                for w in re.split(r"[^a-z0-9]+", bare)
                if len(w) >= 3
            ]
            counts = np.bincount(slots, minlength=dimensions).astype(np.float64)
            if not slots:
                counts[0] = 1.0
            vectors.append((counts / np.sqrt((counts * counts).sum())).astype(np.float32))
        return vectors

    return embed


def _problem(vector: Sequence[float], dimensions: int) -> str | None:
    values = np.asarray(vector, dtype=np.float32)
    if values.shape != (dimensions,):
        return "WRONG_DIMENSION"
    if not np.isfinite(values).all():
        return "NOT_FINITE"
    return None if values.any() else "ZERO_MAGNITUDE"


def _embed_batch(embed: EmbedFunction, texts: list[str], dimensions: int) -> list[tuple]:
    """``(vector, problem)`` per text. A batch that fails, or has one bad vector, fails whole."""
    try:
        vectors = list(embed(texts))
    except Exception as error:
        return [(None, f"FAILED: {error}"[:500])] * len(texts)
    if len(vectors) != len(texts):
        return [(None, "WRONG_COUNT")] * len(texts)
    bad = next((p for p in (_problem(v, dimensions) for v in vectors) if p), None)
    if bad:
        return [(None, bad)] * len(texts)
    return [(np.asarray(v, dtype=np.float32), None) for v in vectors]


def _embed_texts(embed: EmbedFunction, texts: list[str], dimensions: int) -> list[tuple]:
    """As a batch, and text by text where that fails, so that a text fails whatever batch it is in."""
    done = _embed_batch(embed, texts, dimensions)
    if len(texts) > 1 and any(problem for _, problem in done):
        done = [_embed_batch(embed, [text], dimensions)[0] for text in texts]
    return done


def embed_chunks(
    chunks: DataFrame,
    embed: EmbedFunction | None = None,
    dimensions: int = 64,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Vectors for ``chunks(chunk_id, title, content)``: ``chunk_id, embedding, problem``.

    The model runs on Arrow batches inside the tasks, ``batch_size`` texts per call. Blank texts
    and those that the model fails on come back with a problem instead of a vector.
    """
    model = embed or hashing_model(dimensions)
    text = tx.embedding_text(F.col("title"), F.col("content"))
    texts = chunks.select("chunk_id", F.when(~tx.is_blank(text), text).alias("text"))
    schema = f"chunk_id {dict(texts.dtypes)['chunk_id']}, embedding array<float>, problem string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done: list[tuple] = [(None, "BLANK")] * len(frame)
            filled = np.flatnonzero(frame["text"].notna()).tolist()
            for start in range(0, len(filled), batch_size):
                part = filled[start : start + batch_size]
                found = _embed_texts(model, frame["text"].iloc[part].tolist(), dimensions)
                for row, result in zip(part, found, strict=True):
                    done[row] = result
            yield pd.DataFrame({
                "chunk_id": frame["chunk_id"],
                "embedding": [vector for vector, _ in done],
                "problem": [problem for _, problem in done],
            })

    return texts.mapInPandas(run, schema)
