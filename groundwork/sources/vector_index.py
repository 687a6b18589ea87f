"""The vector index on disk: inverted cells with int8 codes beside the full vectors.

``codes`` holds for each vector its residual to the centre of its cell in eight bits a dimension, and how far the code
is off at most; ``vectors`` holds the vectors themselves. Both lie in ``cell`` folders and are appended to. ``centers``
and ``settings`` are written when the index is made: the centres come from k-means over a bounded sample, the number of
cells that a search probes from the recall measured on stored vectors. A search reads the codes of probed cells and the
vectors of the few rows that the codes leave open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import vectors as vx

# Vectors that k-means sees, cells at most (the centres travel to every task: 3 MB at 768 dimensions), rounds.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 1024, 10
# Stored vectors that ask for their neighbours when probes are measured, and the share that must be found.
MEASURED, TARGET = 256, 0.95
# What a stored row may carry along for searches to decide who sees it.
CARRIED = ("document_id", "subjects", "default_visible")


def matrix_of(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def k_means(unit: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres of unit length by cosine; a cell that runs empty takes the vector farthest from its centre."""
    rng = np.random.default_rng(seed)
    centers = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = unit @ centers.T
        own = nearest.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, unit)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = unit[np.argsort(nearest.max(axis=1))[: len(empty)]]
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder, for vectors of one length."""

    spark: SparkSession
    folder: str
    dimensions: int

    def create(self, vectors: DataFrame, cells: int | None = None, seed: int = 42) -> None:
        """Make the cells from a sample of ``vectors`` (by hash of the id) and append all of them.

        Unless given, the number of cells grows with the square root of the table.
        """
        usable = vectors.where(vx.is_usable(F.col("embedding"), self.dimensions))
        count = usable.count()
        sample = usable.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).toArrow()
        cells = cells or min(MOST_CELLS, max(16, math.isqrt(count) // 2))
        if sample.num_rows:
            unit = matrix_of(sample.column("embedding").combine_chunks(), self.dimensions)
            centers = k_means(unit, min(cells, len(unit)), seed)
        else:
            centers = np.eye(1, self.dimensions)
        self.spark.createDataFrame(pa.table({"cell": pa.array(range(len(centers)), pa.int32()), "center": centers.tolist()})).write.parquet(
            f"{self.folder}/centers")
        self.append(vectors)

    def append(self, vectors: DataFrame) -> None:
        """Code the usable ones of ``vectors(chunk_id, embedding, ...)`` against the centres that are there."""
        kept = ["chunk_id", *[c for c in CARRIED if c in vectors.columns]]
        rows = vectors.where(vx.is_usable(F.col("embedding"), self.dimensions)).select(
            *kept, F.col("embedding").cast("array<float>").alias("embedding"))
        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in [*kept, "embedding"]) + ", cell int, code binary, scale double, off double"
        shared, dimensions = self.spark.sparkContext.broadcast(self.centers()), self.dimensions

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.record_batch([*batch.columns, *code(matrix_of(batch.column("embedding"), dimensions), shared.value)],
                                          names=[*batch.schema.names, "cell", "code", "scale", "off"])

        path = f"{self.folder}/rows"
        rows.mapInArrow(coded, schema).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(path)

    def centers(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/centers").orderBy("cell").select("center").toArrow()
        return np.array(rows.column("center").to_pylist())

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """Codes and vectors of some cells. Parquet keeps columns apart, so a scan of codes reads no vector."""
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def settle_probes(self, probes: int, recall: float) -> None:
        """Store how many cells a search probes, with the share of neighbours they were measured to hold."""
        row = [(probes, recall)]
        self.spark.createDataFrame(row, "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/settings")

    def probes(self) -> tuple[int, float]:
        return tuple(self.spark.read.parquet(f"{self.folder}/settings").first())


def code(unit: np.ndarray, centers: np.ndarray) -> list[pa.Array]:
    """Cell, eight-bit residual, its unit, and how far it is off at most, of unit vectors."""
    cell = (unit @ centers.T).argmax(axis=1)
    residual = unit - centers[cell]
    scale = np.maximum(np.abs(residual).max(axis=1), 1e-30) / 127
    steps = np.rint(residual / scale[:, None]).astype(np.int8)
    off = np.linalg.norm(residual - steps * scale[:, None], axis=1)
    ends = np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]
    codes = pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(steps))])
    return [pa.array(cell, pa.int32()), codes, pa.array(scale), pa.array(off)]
