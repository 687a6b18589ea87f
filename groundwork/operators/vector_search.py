"""Nearest chunks by cosine: exact, and through a stored index.

The exact search reads the chunk vectors once, where they lie. Each task multiplies its Arrow
batches with the question vectors and hands on the best ``k`` per question; only those are
shuffled. The question vectors travel to the tasks when their number was checked; a larger set
meets the chunks on a grid of (question block, chunk cell) groups of bounded size instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import vectors as vx
from groundwork.operators.ranking import PAIRS, Askers, Edges, Top, hopeful, visibility_class
from groundwork.operators.scope import with_visibility
from groundwork.session import discard, is_small, scratch_dir, settle, ship
from groundwork.sources.vector_index import MEASURED, TARGET, VectorIndex, matrix_of

CANDIDATES = 10

# Questions that travel to every task: 4096 vectors of 768 floats are 12 MB.
SHIPPED_QUESTIONS = 4096
# The same for a search of an index, at least: of shorter vectors as many as take QUESTION_BYTES in two precisions and with
# the cells that each probes.
PROBING_QUESTIONS, QUESTION_BYTES = 16_384, 64_000_000
# Pairs that the codes leave open and that travel to every task, where the vectors lie.
SHIPPED_PAIRS = 1_000_000


class Questions(Askers):
    """Question vectors of one task: ids, unit vectors, and what each one may see."""

    def __init__(self, table: pa.Table):
        super().__init__(table.column("query_id").to_numpy(zero_copy_only=False), table.column("scope").to_pylist())
        flat = pc.list_flatten(table.column("embedding")).to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = flat.reshape(table.num_rows, -1)
        self.unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


# What products in single precision, of vectors of unit length, are off by is far below this.
ROUNDING = 1e-5
# Pairs whose vectors are multiplied one by one at a time.
EXACT_PAIRS = 1 << 15


class Nearest:
    """Compares batches of chunks with the questions and keeps the best ``k`` of each.

    Products in single precision rule out almost all pairs; those that are left are multiplied in double precision.
    """

    def __init__(self, questions: Questions, k: int):
        self.questions, self.k, self.best, self.kind = questions, k, Top(len(questions), k), None
        self.short = questions.unit.astype(np.float32)

    def add(self, batch: pa.RecordBatch) -> None:
        """Vectors without a cosine with the questions are passed over."""
        self.kind = batch.schema.field("chunk_id").type
        right_length = pc.equal(pc.list_value_length(batch.column("embedding")), self.questions.unit.shape[1])
        batch = batch.filter(right_length)
        matrix = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
        matrix = matrix.astype(np.float64).reshape(batch.num_rows, -1)
        norms = np.linalg.norm(matrix, axis=1)
        usable = np.flatnonzero(np.isfinite(norms) & (norms > 0))
        unit = matrix[usable] / norms[usable, None]
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)[usable]
        codes, seen = self.questions.masks(batch.column("class").take(pa.array(usable)))
        short = unit.astype(np.float32)
        step = max(1, PAIRS // max(1, len(self.questions)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            allowed = None if seen.all() else seen[codes[part]].T
            asked, row = hopeful(self.short @ short[part].T, allowed, self.best.edge(), self.k, 2 * ROUNDING)
            self.best.add(asked, ids[part][row], cosines(self.questions.unit, unit[part], asked, row))

    def table(self, id_type: pa.DataType) -> pa.Table:
        """(query_id, chunk_id, similarity) of what is held."""
        questions, ids, similarity = self.best.rows(self.questions.ids)
        return pa.table([pa.array(questions, type=id_type), pa.array(ids, type=self.kind), pa.array(similarity)],
                        names=["query_id", "chunk_id", "similarity"])


def cosines(questions: np.ndarray, unit: np.ndarray, asked: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of pairs of rows of both. Copies of a vector must tie, so the noise of the last digits goes."""
    found = np.empty(len(asked))
    for at in range(0, len(asked), EXACT_PAIRS):
        part = slice(at, at + EXACT_PAIRS)
        found[part] = np.einsum("ij,ij->i", questions[asked[part]], unit[row[part]])
    return np.round(found, 12)


def _output_schema(chunks: DataFrame, questions: DataFrame) -> str:
    query, chunk = dict(questions.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    return f"query_id {query}, chunk_id {chunk}, similarity double"


def _stored(chunks: DataFrame) -> DataFrame:
    """Chunk vectors with their visibility (all visible if none is given)."""
    if "subjects" not in chunks.columns:
        chunks = chunks.withColumn("subjects", F.array().cast("array<string>")).withColumn(
            "default_visible", F.lit(True)
        )
    return chunks.select("chunk_id", "embedding", visibility_class().alias("class"))


def _asked(questions: DataFrame, dimensions: int) -> DataFrame:
    if "scope" not in questions.columns:
        questions = questions.withColumn("scope", F.lit(None).cast("array<string>"))
    return questions.where(vx.is_usable(F.col("embedding"), dimensions)).select(
        "query_id", "embedding", "scope"
    )


def _best_overall(partial: DataFrame, k: int) -> DataFrame:
    """The overall best ``k``, ranked by the full similarity and told by six places of it."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", 6))


def vector_topk(
    chunks: DataFrame,
    questions: DataFrame,
    dimensions: int,
    k: int = CANDIDATES,
    shipped: int = SHIPPED_QUESTIONS,
    group_rows: int = 20_000,
) -> DataFrame:
    """Exact ``query_id, chunk_id, similarity, rank``: the ``k`` nearest visible chunks."""
    stored, asked = _stored(chunks), _asked(questions, dimensions)
    if is_small(asked, shipped):
        partial = _scan_with(stored, asked, k)
    else:
        partial = _meet_on_grid(stored, asked, k, shipped, group_rows)
    return _best_overall(partial, k)


def _scan_with(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    schema = _output_schema(stored, asked)
    table = asked.toArrow()
    if not table.num_rows:
        return stored.sparkSession.createDataFrame([], schema)
    id_type = table.schema.field("query_id").type
    shipped = stored.sparkSession.sparkContext.broadcast(Questions(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(shipped.value, k)
        for batch in batches:
            nearest.add(batch)
        if nearest.kind is not None:
            yield from nearest.table(id_type).to_batches()

    return stored.mapInArrow(run, schema)


def _nearest_in_group(k: int):
    def run(_: tuple, stored: pa.Table, asked: pa.Table) -> pa.Table:
        id_type, kind = asked.schema.field("query_id").type, stored.schema.field("chunk_id").type
        if not asked.num_rows or not stored.num_rows:
            return pa.table([pa.array([], id_type), pa.array([], kind), pa.array([], pa.float64())],
                            names=["query_id", "chunk_id", "similarity"])
        nearest = Nearest(Questions(asked), k)
        for batch in stored.combine_chunks().to_batches():
            nearest.add(batch)
        return nearest.table(id_type)

    return run


def _all_up_to(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _meet_on_grid(
    stored: DataFrame, asked: DataFrame, k: int, block_rows: int, cell_rows: int
) -> DataFrame:
    """Every question block meets every chunk cell in one group of bounded size."""
    blocks = F.lit(-(-asked.count() // block_rows))
    cells = F.lit(max(1, -(-stored.count() // cell_rows)))
    left = stored.withColumn("_cell", F.pmod(F.xxhash64("chunk_id"), cells).cast("int"))
    right = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    left = left.withColumn("_block", _all_up_to(blocks)).groupBy("_block", "_cell")
    right = right.withColumn("_cell", _all_up_to(cells)).groupBy("_block", "_cell")
    return left.cogroup(right).applyInArrow(_nearest_in_group(k), _output_schema(stored, asked))


# -- through a stored index ------------------------------------------------------------------


class _Probing:
    """Question vectors of one task, the cells that each probes, and the centres of the cells."""

    def __init__(self, table: pa.Table, centers: np.ndarray, probes: int):
        self.questions, self.centers = Questions(table), centers.astype(np.float32)
        self.all = probes >= len(centers)
        self.probed = np.ones((1, len(centers)), bool)
        if not self.all:
            order = np.argsort(-(self.questions.unit @ centers.T), axis=1, kind="stable")[:, :probes]
            self.probed = np.zeros((len(self.questions), len(centers)), bool)
            np.put_along_axis(self.probed, order, True, axis=1)


# Products of a tile, few enough to stay near the processor; rows of a task that are looked at first, before there is an edge.
TILE_PAIRS, FIRST_ROWS = 1 << 20, 256


def _left_open(near: np.ndarray, edge: np.ndarray, sees, wide: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row), by question, of products off by at most ``wide`` that may be among the best ``k``: as ``hopeful``,
    but where there is an edge only pairs that pass it are looked up in ``sees(questions, rows)``."""
    fresh = np.flatnonzero(np.isneginf(edge))
    limit = (edge - wide).astype(np.float32)
    limit[fresh] = np.inf
    asked, row = np.divmod(np.flatnonzero(near >= limit[:, None]), near.shape[1])
    seen = sees(asked, row)
    asked, row = asked[seen], row[seen]
    if len(fresh):
        allowed = sees(fresh[:, None], np.arange(near.shape[1])[None, :])
        first, at = hopeful(near[fresh], allowed, edge[fresh], k, 2 * wide)
        asked, row = np.concatenate([asked, fresh[first]]), np.concatenate([row, at])
        order = np.argsort(asked, kind="stable")
        asked, row = asked[order], row[order]
    return asked, row


def _open_pairs(shared, k: int, step: int):
    """(question, chunk_id, cell, low, high): pairs that the codes of a task do not rule out, and bounds of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probing, kind, size = shared.value, None, min(step, FIRST_ROWS)
        questions = probing.questions
        unit = questions.unit.astype(np.float32)
        held, best = [], Edges(len(questions), k)
        for whole in batches:
            kind, at = whole.schema.field("chunk_id").type, 0
            while at < whole.num_rows:
                batch = whole.slice(at, size)
                at, size = at + size, min(step, 2 * size)
                raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
                cell, scale, off = (batch.column(c).to_numpy() for c in ("cell", "scale", "off"))
                decoded = raw * scale[:, None].astype(np.float32)
                decoded += probing.centers[cell]
                codes, seen = questions.masks(batch.column("class"))
                everyone = seen.all()
                # Rows of a cell lie together: questions that do not probe it are not multiplied.
                for one in [None] if probing.all else np.unique(cell):
                    rows = np.arange(len(cell)) if one is None else np.flatnonzero(cell == one)
                    asking = np.arange(len(questions)) if one is None else np.flatnonzero(probing.probed[:, one])
                    part_of = np.ascontiguousarray(decoded[rows].T)
                    wide = float(off[rows].max()) + ROUNDING
                    tile = max(1, TILE_PAIRS // len(rows))
                    found = []
                    for low in range(0, len(asking), tile):
                        part = asking[low : low + tile]
                        near, edge = unit[part] @ part_of, best.edge()[part]

                        def sees(asked, row, part=part, rows=rows):
                            if everyone:
                                return np.ones(np.broadcast_shapes(asked.shape, row.shape), bool)
                            return seen[codes[rows[row]], part[asked]]

                        asked, row = _left_open(near, edge, sees, wide, k)
                        told, at_row = near[asked, row].astype(float), rows[row]
                        best.add(part[asked], told - off[at_row] - ROUNDING)
                        found.append((part[asked], at_row, told))
                    asked, row, told = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, int)] * 3
                    high = told + off[row] + ROUNDING
                    keep = high >= best.edge()[asked]
                    asked, row, told, high = asked[keep], row[keep], told[keep], high[keep]
                    held.append((asked.astype(np.int32), batch.column("chunk_id").take(pa.array(row)), cell[row],
                                 told - off[row] - ROUNDING, high))
        if kind is None or not held:
            return
        edge = best.edge()
        for asked, ids, cell, low, high in held:
            keep = np.flatnonzero(high >= edge[asked])
            yield pa.record_batch([pa.array(asked[keep], pa.int32()), ids.take(pa.array(keep)), pa.array(cell[keep], pa.int32()),
                                   pa.array(low[keep]), pa.array(high[keep])], names=["question", "chunk_id", "cell", "low", "high"])

    return run


def _exact_pairs(shared, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = shared.value.questions
        for batch in batches:
            if batch.num_rows:
                asked = batch.column("question").to_numpy()
                unit = matrix_of(batch.column("embedding"), dimensions)
                similarity = cosines(questions.unit, unit, asked, np.arange(len(asked)))
                yield pa.record_batch([pa.array(questions.ids[asked]), batch.column("chunk_id"), pa.array(similarity)],
                                      names=["query_id", "chunk_id", "similarity"])

    return run


def search_index(
    index: VectorIndex,
    questions: DataFrame,
    visibility: DataFrame | None = None,
    k: int = CANDIDATES,
    probes: int | None = None,
    group_rows: int = 4096,
    question_rows: int | None = None,
) -> DataFrame:
    """``query_id, chunk_id, similarity, rank``: the ``k`` nearest visible chunks of the cells closest to each question.

    The codes of those cells give bounds for every similarity; a pair whose upper bound is under the ``k`` th best lower
    bound of its question is out, the others are compared exactly. So what is found is exact within the probed cells,
    and with all of them (``probes=0``) the same as ``vector_topk`` finds. Unless given, probes are as many as the index
    was measured with. ``question_rows`` questions at a time are sent to the tasks, unless given as many as a checked
    number of bytes holds.
    """
    asked, centers = _asked(questions, index.dimensions), index.centers()
    probes = index.probes()[0] if probes is None else probes or len(centers)
    question_rows = question_rows or max(PROBING_QUESTIONS, QUESTION_BYTES // (12 * index.dimensions + len(centers)))
    count = asked.count()
    if count <= min(question_rows, SHIPPED_QUESTIONS):
        table = asked.toArrow()
        schema = _pair_schema(index, asked)
        if not table.num_rows:
            return _best_overall(index.spark.createDataFrame([], schema), k)
        probing = _Probing(table, centers, probes)
        cells = None if probing.all else np.flatnonzero(probing.probed.any(axis=0)).tolist()  # at most the number of cells
        return _best_overall(_search_block(index, _coded(index, visibility, cells), probing, cells, schema, k, group_rows), k)
    # What every block reads is made once, its rows by cells; each writes what it found, so that no plan grows with their number.
    blocks, parts = -(-count // question_rows), 2 * index.spark.sparkContext.defaultParallelism
    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(blocks, "block"), "asked-vectors")
    coded = _coded(index, visibility, None).repartitionByRange(parts, "cell", "chunk_id").sortWithinPartitions("cell")
    coded = settle(coded, "seen-codes")
    path, schema = scratch_dir(index.spark, "found-pairs"), _pair_schema(index, asked)
    for n in range(blocks):
        table = asked.where(F.col("block") == n).drop("block").toArrow()
        if table.num_rows:
            found = _search_block(index, coded, _Probing(table, centers, probes), None, schema, k, group_rows)
            found.write.mode("append").parquet(path)
    return _best_overall(index.spark.read.schema(schema).parquet(path), k)


def _pair_schema(index: VectorIndex, asked: DataFrame) -> str:
    return f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(index.rows().dtypes)['chunk_id']}, similarity double"


def _coded(index: VectorIndex, visibility: DataFrame | None, cells: list[int] | None) -> DataFrame:
    """The codes of some cells, with the visibility class of each row."""
    rows = index.rows(cells)
    if visibility is not None:
        kind = dict(visibility.dtypes)["subjects"].removeprefix("array<").removesuffix(">")
        seen = with_visibility(rows.drop("subjects", "default_visible"), visibility, kind)
    elif "subjects" in rows.columns:
        seen = rows
    else:
        seen = rows.withColumn("subjects", F.array().cast("array<string>")).withColumn("default_visible", F.lit(True))
    return seen.select("chunk_id", "cell", "code", "scale", "off", visibility_class().alias("class"))


def _search_block(
    index: VectorIndex, coded: DataFrame, probing: _Probing, cells: list[int] | None, schema: str, k: int, step: int
) -> DataFrame:
    """Of questions that travel together (query_id, chunk_id, similarity) of the pairs that the codes leave open."""
    shared, kind = index.spark.sparkContext.broadcast(probing), dict(coded.dtypes)["chunk_id"]
    pairs = coded.mapInArrow(_open_pairs(shared, k, step), f"question int, chunk_id {kind}, cell int, low double, high double")
    pairs = settle(pairs, "open-pairs")
    by_low = Window.partitionBy("question").orderBy(F.desc("low"))
    edges = pairs.withColumn("n", F.row_number().over(by_low)).where(F.col("n") == k).select("question", F.col("low").alias("edge"))
    open_pairs = pairs.join(edges, "question", "left").where(F.col("high") >= F.coalesce("edge", F.lit(float("-inf"))))
    # Copies under one id are one row of the result.
    open_pairs = settle(open_pairs.select("question", "chunk_id", "cell").distinct(), "pairs-to-compare")
    discard(pairs)
    met = index.rows(cells).select("chunk_id", "cell", "embedding").join(
        ship(open_pairs, is_small(open_pairs, SHIPPED_PAIRS)), ["cell", "chunk_id"])
    return met.select("question", "chunk_id", "embedding").mapInArrow(_exact_pairs(shared, index.dimensions), schema)


def measure_probes(index: VectorIndex, k: int = CANDIDATES, questions: DataFrame | None = None) -> int:
    """Store the fewest cells that hold ``TARGET`` of the neighbours that an exact search finds for a sample.

    The sample is of ``questions`` like those to come, else of stored vectors, whose own row does not count.
    """
    if questions is None:
        asked = index.rows().select(F.col("chunk_id").alias("query_id"), "embedding")
    else:
        asked = _asked(questions, index.dimensions).select("query_id", "embedding")
    sample = settle(asked.orderBy(F.xxhash64("query_id")).limit(MEASURED), "measured-vectors")
    table, centers = sample.toArrow(), index.centers()
    if not table.num_rows:
        index.settle_probes(1, 1.0)
        return 1
    unit = matrix_of(table.column("embedding").combine_chunks(), index.dimensions)
    rank_of = np.argsort(np.argsort(-(unit @ centers.T), axis=1, kind="stable"), axis=1)
    # Everybody sees everything here.
    everyone = index.spark.createDataFrame([], "document_id long, subjects array<string>, default_visible boolean")
    found = search_index(index, sample, everyone if "document_id" in index.rows().columns else None,
                         k + (questions is None), probes=0)
    if questions is None:
        found = found.where("query_id <> chunk_id")
    cells = index.rows().select("chunk_id", "cell").join(F.broadcast(found.select("query_id", "chunk_id")), "chunk_id").toArrow()
    place = {q: n for n, q in enumerate(table.column("query_id").to_pylist())}
    rows = np.array([place[q] for q in cells.column("query_id").to_pylist()], int)
    ranks = np.sort(rank_of[rows, cells.column("cell").to_numpy()]) if len(rows) else np.zeros(1, int)
    probes = int(ranks[math.ceil(TARGET * len(ranks)) - 1]) + 1
    index.settle_probes(probes, float((ranks < probes).mean()))
    return probes


def vector_topk_approx(
    chunks: DataFrame,
    questions: DataFrame,
    dimensions: int,
    k: int = CANDIDATES,
    cells: int | None = None,
    probes: int | None = None,
    group_rows: int = 4096,
    question_rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``search_index`` for vectors that have no index yet: one is written to the shared folder first."""
    index = VectorIndex(chunks.sparkSession, scratch_dir(chunks.sparkSession, "vector-index"), dimensions)
    index.create(chunks, cells, seed)
    if probes is None:
        measure_probes(index, k, questions)
    return search_index(index, questions, None, k, probes, group_rows, question_rows)
