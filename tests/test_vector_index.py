"""The stored vector index: exact where it probes everything, few vectors compared, recall as measured."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.operators import scope
from groundwork.operators import vector_search as vs
from groundwork.operators.ranking import Edges
from groundwork.session import scratch_dir
from groundwork.sources.vector_index import VectorIndex, code, k_means

DIMENSIONS = 24


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(30, DIMENSIONS))
    rows = [(n, n // 3, (middles[n % 30] + 0.4 * rng.normal(size=DIMENSIONS)).tolist()) for n in range(900)]
    copies = [(900 + n, 300, rows[5][2]) for n in range(60)]
    odd = [(1000, 1, None), (1001, 1, [0.0] * DIMENSIONS), (1002, 1, [1.0]), (1003, None, [float("nan")] * DIMENSIONS)]
    return spark.createDataFrame(rows + copies + odd, "chunk_id long, document_id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def index(spark, table):
    made = VectorIndex(spark, scratch_dir(spark, "test-vectors"), DIMENSIONS)
    # Two thirds first, the rest appended to the cells that are there.
    made.create(table.where("chunk_id % 3 <> 0"))
    made.append(table.where("chunk_id % 3 = 0"))
    return made


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(12)
    scopes = [None, ["a"], ["b", "z"], ["z"]]
    return spark.createDataFrame(
        [(q, rng.normal(size=DIMENSIONS).tolist(), scopes[q % 4]) for q in range(40)] + [(40, [0.0] * DIMENSIONS, None)],
        "query_id long, embedding array<float>, scope array<string>").cache()


@pytest.fixture(scope="module")
def visibility(spark):
    subjects = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "subject_id string, active boolean")
    tags = spark.createDataFrame([(d, "abc"[d % 3]) for d in range(0, 301, 2)], "document_id long, subject_id string")
    return scope.document_visibility(tags, subjects)


def rows(found):
    return sorted(map(tuple, found.select("query_id", "chunk_id", "similarity", "rank").collect()))


def test_all_cells_give_the_exact_neighbours(table, index, asked, visibility):
    exact = vs.vector_topk(scope.with_visibility(table, visibility, "string"), asked, DIMENSIONS)
    for question_rows in (4096, 7):
        assert rows(vs.search_index(index, asked, visibility, probes=0, group_rows=50, question_rows=question_rows)) == rows(exact)
    everyone = vs.vector_topk(table, asked.drop("scope"), DIMENSIONS, k=3)
    assert rows(vs.search_index(index, asked.drop("scope"), None, k=3, probes=0)) == rows(everyone)


def test_measured_probes_find_nine_of_ten_with_few_vectors(spark, table, index, asked):
    plain = asked.drop("scope")
    of_stored = vs.measure_probes(index)
    # Questions unlike the stored vectors need more cells than those that are like them.
    probes = vs.measure_probes(index, questions=plain)
    stored, recall = index.probes()
    assert stored == probes >= of_stored and recall >= 0.9 and of_stored < len(index.centers())
    exact, found = rows(vs.vector_topk(table, plain, DIMENSIONS)), rows(vs.search_index(index, plain))
    assert len({r[:2] for r in exact} & {r[:2] for r in found}) >= 0.9 * len(exact)
    # What the codes leave open is what is compared in full.
    probing = vs._Probing(vs._asked(plain, DIMENSIONS).toArrow(), index.centers(), probes)
    shared = spark.sparkContext.broadcast(probing)
    coded = index.rows().withColumn("class", F.lit('{"d":true,"s":[]}'))
    open_pairs = coded.select("chunk_id", "cell", "code", "scale", "off", "class").mapInArrow(
        vs._open_pairs(shared, 10, 4096), "question int, chunk_id long, cell int, low double, high double").count()
    assert open_pairs < 960 * 40 / 3


def test_a_search_reads_codes_of_probed_cells_and_vectors_of_few_rows(index, asked):
    one = asked.where("query_id = 3").drop("scope")
    plan = vs.search_index(index, one, probes=2)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "embedding" in line)
    assert "cell#" in scan.split("PartitionFilters", 1)[1].split("]")[0] and "code" not in scan.split("[", 1)[1].split("]")[0]


def test_codes_are_never_further_off_than_they_say():
    rng = np.random.default_rng(13)
    unit = rng.normal(size=(200, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centers = k_means(unit, 9, 1)
    cell, steps, scale, off = code(unit, centers)
    raw = np.frombuffer(b"".join(steps.to_pylist()), np.int8).reshape(200, -1)
    near = centers[cell.to_numpy()] + raw * scale.to_numpy()[:, None]
    assert np.allclose(np.linalg.norm(unit - near, axis=1), off.to_numpy(), atol=1e-12) and off.to_numpy().max() < 0.05
    assert set(cell.to_pylist()) == set(range(9))


def test_an_empty_table_makes_an_index_that_finds_nothing(spark, table, asked):
    made = VectorIndex(spark, scratch_dir(spark, "test-vectors"), DIMENSIONS)
    made.create(table.where("false"))
    made.append(table.where("chunk_id = 7"))
    assert [r.chunk_id for r in vs.search_index(made, asked.where("query_id = 3").drop("scope"), probes=0).collect()] == [7]
    assert vs.search_index(made, asked.where("false"), probes=0).count() == 0


def test_few_pairs_are_multiplied_in_full(monkeypatch):
    """Of 200 questions and 8,000 chunks the short products leave few pairs, and these hold the exact best."""
    rng = np.random.default_rng(3)
    chunks, asked = rng.normal(size=(8000, 16)), rng.normal(size=(200, 16))
    chunks[5000:5200] = chunks[0]
    counted, real = [], vs.cosines
    monkeypatch.setattr(vs, "cosines", lambda *a: counted.append(len(a[2])) or real(*a))
    monkeypatch.setattr(vs, "PAIRS", 200 * 500)
    questions = vs.Questions(pa.table({
        "query_id": pa.array(range(200)), "embedding": asked.tolist(), "scope": pa.array([None] * 200, pa.list_(pa.string()))}))
    nearest = vs.Nearest(questions, 10)
    for at in range(0, 8000, 1000):
        nearest.add(pa.record_batch({
            "chunk_id": pa.array(range(at, at + 1000)), "embedding": chunks[at : at + 1000].tolist(),
            "class": pa.array(['{"d":true,"s":[]}'] * 1000)}))
    found = nearest.table(pa.int64()).to_pandas().groupby("query_id")["chunk_id"].agg(list)
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (asked, chunks)]
    exact = np.round(unit[0] @ unit[1].T, 12)
    assert [found[q] for q in range(200)] == [np.lexsort((np.arange(8000), -exact[q]))[:10].tolist() for q in range(200)]
    assert sum(counted) < 200 * 8000 / 8


def test_many_questions_make_no_longer_plan(index, asked, visibility):
    """Each block of questions writes what it found; the plan of the result reads that and nothing else."""
    found = vs.search_index(index, asked, visibility, probes=4, question_rows=7)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert rows(found) == rows(vs.search_index(index, asked, visibility, probes=4))


def test_edges_are_the_kth_best():
    rng = np.random.default_rng(17)
    best, seen = Edges(30, 3), [[] for _ in range(30)]
    for n in (5, 200, 1, 0, 60):
        asked = np.sort(np.concatenate([rng.integers(0, 29, n), np.full(n // 2, 4)]))
        scores = np.round(rng.normal(size=len(asked)), 1)
        best.add(asked, scores)
        for q, x in zip(asked, scores, strict=True):
            seen[q].append(x)
        assert best.edge().tolist() == [sorted(x)[-3] if len(x) >= 3 else -np.inf for x in seen]
