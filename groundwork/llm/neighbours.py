"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks: the originals, int8 codes with a scale per vector, and the length of what the codes
leave out. Every block of queries meets every block of candidates once. A tile is one matrix product of codes; with
the Cauchy-Schwarz bound on what was left out it says between which limits each inner product lies. Pairs whose
upper limit reaches the query's k-th best lower limit are computed again from the originals, and heaps merge
the best of each tile. No pair that could be among the nearest is lost, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import written

# Vectors in a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 8_192, 1_024
SCHEMA = "dim int, n int, ids binary, vectors binary, codes binary, scales binary, lost binary"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of (vector - scale * codes), each rounded up a little."""
    scales = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / np.where(scales > 0, scales, 1)[:, None]).astype(np.int8)
    lost = np.linalg.norm(vectors - scales[:, None] * codes, axis=1)
    return codes, scales, lost * (1 + 1e-9)


def _packer(size: int):
    """Blocks of at most ``size`` vectors of one dimension, from the rows of a task."""
    def block(dim: int, ids: list[int], rows: list[np.ndarray]):
        vectors = np.array(rows, np.float64)
        codes, scales, lost = quantise(vectors)
        parts = [np.array(ids, np.int64), vectors, codes, scales, lost]
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                                *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
                               ["dim", "n", "ids", "vectors", "codes", "scales", "lost"])

    def packed(batches):
        open_blocks: dict[int, tuple[list, list]] = {}
        for batch in batches:
            column = batch.column("vector")
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            edges = column.offsets.to_numpy()
            for ident, a, b in zip(batch.column("id").to_pylist(), edges, edges[1:], strict=False):
                ids, rows = open_blocks.setdefault(int(b - a), ([], []))
                ids.append(ident)
                rows.append(flat[a:b])
                if len(ids) == size:
                    yield block(int(b - a), *open_blocks.pop(int(b - a)))
        for dim, (ids, rows) in open_blocks.items():
            yield block(dim, ids, rows)

    return packed


def blocks(vectors: DataFrame, size: int, purpose: str) -> DataFrame:
    """Packed blocks of the usable vectors (id, vector), dealt evenly whatever the layout of the table."""
    number = max(1, -(-vectors.count() // size))
    return written(vectors.repartition(number).mapInArrow(_packer(size), SCHEMA), purpose)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows whose vector is not null or zero and has only finite components."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    infinite = float("inf")
    return table.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).where(
        "id IS NOT NULL AND vector IS NOT NULL").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
        & F.exists("vector", lambda x: x != 0))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so that equal vectors get equal scores."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def tile(q: dict, c: dict, k: int):
    """The k best candidates of a block for each query of a block: (query, score, candidate) rows."""
    # Products of codes stay below 2**24 up to 1,040 components, and are exact in single precision.
    kind = np.float32 if q["dim"] <= 1040 else np.float64
    middle = (q["codes"].astype(kind) @ c["codes"].astype(kind).T).astype(np.float64)
    middle *= q["scales"][:, None]
    middle *= c["scales"][None, :]
    # |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'|, with |u'| <= |u| + |u - u'|.
    q_len, c_len = np.linalg.norm(q["vectors"], axis=1), np.linalg.norm(c["vectors"], axis=1)
    error = q["lost"][:, None] * c_len[None, :] + (q_len + q["lost"])[:, None] * c["lost"][None, :]
    error += 1e-12 * q_len[:, None] * c_len[None, :]
    own = q["ids"][:, None] == c["ids"][None, :]
    low = np.where(own, -np.inf, middle - error)
    reach = min(k, low.shape[1])
    floor = np.partition(low, low.shape[1] - reach, axis=1)[:, low.shape[1] - reach]
    rows, columns = np.nonzero(~own & (middle + error >= floor[:, None]))
    for a in range(0, len(rows), 1 << 18):
        r, j = rows[a : a + (1 << 18)], columns[a : a + (1 << 18)]
        yield q["ids"][r], inner_products(q["vectors"][r], c["vectors"][j]), c["ids"][j]


def _unpack(row: dict, side: str) -> dict:
    n, dim = row[f"{side}n"], row["dim"]
    read = lambda name, kind: np.frombuffer(row[side + name], kind)
    return {"dim": dim, "ids": read("ids", np.int64), "scales": read("scales", np.float64),
            "lost": read("lost", np.float64), "vectors": read("vectors", np.float64).reshape(n, dim),
            "codes": read("codes", np.int8).reshape(n, dim)}


def _tiles(k: int):
    def joined(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for query, score, found in tile(_unpack(row, "q_"), _unpack(row, ""), k):
                    order = np.lexsort((found, -score, query))
                    query, score, found = query[order], score[order], found[order]
                    edge = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
                    for a, b in zip(edge, np.append(edge[1:], len(query)), strict=True):
                        b = min(a + k, b)
                        run = list(zip((-score[a:b]).tolist(), found[a:b].tolist(), strict=True))
                        ident = int(query[a])
                        best[ident] = heapq.nsmallest(k, heapq.merge(best.get(ident, []), run))
        rows = [(q, f, -s) for q, heap in best.items() for s, f in heap]
        for a in range(0, len(rows), 1 << 16):
            query, found, score = zip(*rows[a : a + (1 << 16)], strict=True)
            yield pa.record_batch({"query_id": pa.array(query, pa.int64()), "found": pa.array(found, pa.int64()),
                                   "score": pa.array(score, pa.float64())})

    return joined


def nearest(table: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest inner product with each query, ties to smaller ids.

    ``is_query`` is a condition on the id. Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; vectors of another dimension than the query's are no candidates; a query
    is no candidate of its own, and of repeated ids the smallest vector counts.
    """
    rows = usable(table, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = written(rows, "vectors")
    candidates = blocks(rows, BLOCK, "candidate-blocks")
    queries = blocks(rows.where(is_query(F.col("id"))), QUERY_BLOCK, "query-blocks")
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    # A stated query set against all rows, in blocks: each pair of blocks is one row.
    # (The difference keeps the join from being dealt by the dimension, which nearly all blocks share.)
    pairs = candidates.crossJoin(queries).where("dim - q_dim = 0").drop("q_dim")
    found = pairs.mapInArrow(_tiles(k), "query_id bigint, found bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("found").alias(id_col), "score")
