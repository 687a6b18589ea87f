"""Appending to and replacing parts of the chunk table on disk."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from groundwork.sources import sinks


def chunks(spark, rows):
    """(document_id, text) as rows of the chunk table."""
    made = spark.createDataFrame(rows, "document_id long, content string").withColumn("chunk_hash", F.sha2("content", 256))
    return made.select("document_id", sinks.chunk_id().alias("chunk_id"), "chunk_hash", F.lit(1).alias("sequence_number"),
                       F.lit("t").alias("title"), "content", F.lit(None).cast("string").alias("metadata"),
                       F.lit(None).cast("array<float>").alias("embedding"))


def held(spark, path):
    return sorted((r.document_id, r.content) for r in sinks.read_chunks(spark, path).collect())


def files(path):
    return {os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names
            if "doc_bucket=" in folder and "/_" not in folder and name.endswith(".parquet")}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "document_id long")


START = [(n, f"text {n} {k}") for n in range(40) for k in range(3)]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.append_new_chunks(spark, chunks(spark, START), path, buckets=8)
    return path


def test_append_looks_only_into_the_folders_of_the_batch(spark, table):
    fresh = sinks.new_rows(chunks(spark, [(3, "text 3 1"), (3, "new")]), table, buckets=8)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert not any("content" in line for line in plan.split("\n") if "FileScan" in line and "doc_bucket" in line)
    assert [r.content for r in fresh.collect()] == ["new"]
    assert re.search(r"PartitionFilters: \[.*doc_bucket#\d+ = \d", plan)
    sinks.append_new_chunks(spark, chunks(spark, [(3, "text 3 1"), (3, "new"), (77, "x")]), table, buckets=8)
    assert held(spark, table) == sorted([*START, (3, "new"), (77, "x")])


def test_replacing_writes_only_the_folders_of_its_documents(spark, table):
    before = files(table)
    touched = sinks.replace_documents(spark, table, ids(spark, 5), chunks(spark, [(5, "again"), (5, "again"), (90, "added")]), buckets=8)
    assert held(spark, table) == sorted([*[r for r in START if r[0] != 5], (5, "again"), (90, "added")])
    after = files(table)
    assert 1 <= len(touched) <= 2 and before - after
    assert all(any(f"doc_bucket={b}/" in f for b in touched) for f in before ^ after)
    assert not any("_staged" in f and f.endswith(".parquet") for f in os.listdir(table))


def test_documents_that_lose_all_chunks_leave_no_folder(spark, tmp_path):
    path = str(tmp_path / "one")
    sinks.append_new_chunks(spark, chunks(spark, [(1, "a"), (2, "b")]), path, buckets=64)
    sinks.replace_documents(spark, path, ids(spark, 1), chunks(spark, []), buckets=64)
    assert held(spark, path) == [(2, "b")]
    sinks.replace_documents(spark, path, ids(spark, 1, 2), chunks(spark, [(3, "c")]), buckets=64)
    assert held(spark, path) == [(3, "c")]


def test_a_run_that_fails_before_or_behind_the_staging_loses_nothing(spark, table, monkeypatch):
    swap, fresh = sinks._swap, chunks(spark, [(5, "again")])

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "_note", broken)
    with pytest.raises(RuntimeError):
        sinks.replace_documents(spark, table, ids(spark, 5), fresh, buckets=8)
    assert held(spark, table) == sorted(START) and sinks.finish_replacements(spark, table) == 0
    monkeypatch.undo()
    monkeypatch.setattr(sinks, "_swap", broken)
    with pytest.raises(RuntimeError):
        sinks.replace_documents(spark, table, ids(spark, 5), fresh, buckets=8)
    assert held(spark, table) == sorted(START)
    monkeypatch.setattr(sinks, "_swap", swap)
    assert sinks.finish_replacements(spark, table) == 1
    expected = sorted([*[r for r in START if r[0] != 5], (5, "again")])
    assert held(spark, table) == expected
    # Nothing is left to finish, and a document without chunks changes nothing.
    assert sinks.finish_replacements(spark, table) == 0
    sinks.replace_documents(spark, table, ids(spark, 1000), chunks(spark, []), buckets=8)
    assert held(spark, table) == expected


def test_texts_move_only_to_choose_among_repeated_chunks(spark, tmp_path):
    table = str(tmp_path / "chunks")
    sinks.append_new_chunks(spark, chunks(spark, [(1, "one"), (2, "two")]), table, buckets=8)
    fresh = sinks.new_rows(chunks(spark, [(1, "one"), (2, "other"), (3, " ")]), table, buckets=8)
    assert "Window" not in fresh._jdf.queryExecution().toString()
    assert [(r.document_id, r.content) for r in fresh.collect()] == [(2, "other")]
    again = sinks.new_rows(chunks(spark, [(1, "one"), (4, "twice"), (4, "twice"), (5, "once")]), table, buckets=8)
    assert sorted((r.document_id, r.content) for r in again.collect()) == [(4, "twice"), (5, "once")]
