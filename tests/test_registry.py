"""Registration by file hash on a stream: new, known, in progress, failed and reset."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from groundwork.sources import sinks
from groundwork.streaming import registry

SCHEMA = "document_id long, text string, path string"


@pytest.mark.parametrize("status, verdict, upload, expected", [
    (None, None, 7, ("QUEUED", 7, "CREATE", "PROCESSING")),
    ("INDEXED", None, 7, ("ALREADY_INDEXED", 3, "REUSE", "INDEXED")),
    ("PROCESSING", None, 7, ("ALREADY_PROCESSING", 3, "REUSE", "PROCESSING")),
    ("FAILED", None, 7, ("QUEUED", 3, "RESET", "PROCESSING")),
    ("PROCESSING", "FAILED", None, ("", 3, "", "FAILED")),
    ("PROCESSING", "INDEXED", None, ("", 3, "", "INDEXED")),
])
def test_a_file_goes_through_its_states(status, verdict, upload, expected):
    found = registry.step(status, None if status is None else 3, {"upload_id": upload, "verdict": verdict})
    assert found == expected


def put(spark, folder, name, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, base):
    registry.ingest_files(spark, f"{folder}/*", "document_id long, text string", base, buckets=4).awaitTermination()


def outcomes(spark, base):
    return {r.upload_id: (r.document_id, r.outcome, r.action, r.status) for r in registry.statuses(spark, base).collect()}


def held(spark, base):
    return sorted((r.document_id, r.content) for r in sinks.read_chunks(spark, f"{base}/chunks").collect())


def test_repeated_files_add_nothing_and_failed_ones_start_again(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, "a", [(1, "first text"), (2, "second text"), (3, "first text"), (4, "  "), (5, None), (6, "")])
    run(spark, folder, base)
    first = outcomes(spark, base)
    assert first[1] == (1, "QUEUED", "CREATE", "INDEXED") and first[3] == (1, "ALREADY_PROCESSING", "REUSE", "INDEXED")
    assert first[4] == (4, "QUEUED", "CREATE", "FAILED")
    # Null and empty texts have one hash each: that of no file, and that of an empty one.
    assert {first[5][1], first[6][1]} <= {"QUEUED", "ALREADY_PROCESSING"} and first[5][3] == first[6][3] == "FAILED"
    assert held(spark, base) == [(1, "first text"), (2, "second text")]
    # The same files again, under other ids, and one more.
    put(spark, folder, "b", [(11, "first text"), (14, "  "), (15, "third text")])
    run(spark, folder, base)
    second = outcomes(spark, base)
    assert second[11] == (1, "ALREADY_INDEXED", "REUSE", "INDEXED")
    assert second[14] == (4, "QUEUED", "RESET", "FAILED") and second[15] == (15, "QUEUED", "CREATE", "INDEXED")
    assert held(spark, base) == [(1, "first text"), (2, "second text"), (15, "third text")]
    run(spark, folder, base)
    assert outcomes(spark, base) == second and len(held(spark, base)) == 3


def test_many_copies_in_one_batch_are_one_document(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, "a", [(n, "copy" if n % 3 else f"text {n}") for n in range(300)])
    run(spark, folder, base)
    found = outcomes(spark, base)
    assert len(found) == 300 and sum(o[1] == "QUEUED" for o in found.values()) == 101
    assert {o[0] for n, o in found.items() if n % 3} == {1}
    assert len(held(spark, base)) == 101
    assert registry.statuses(spark, base).where(F.col("status") != "INDEXED").count() == 0


def test_a_batch_is_judged_as_its_events_one_by_one(spark):
    files = [("known", "INDEXED", 1), ("open", "PROCESSING", 2), ("bad", "FAILED", 3), ("told", "PROCESSING", 4)]
    events = [("known", 10, "INDEXED"), ("known", 11, "INDEXED"), ("open", 12, None), ("bad", 14, "INDEXED"), ("bad", 13, None),
              ("told", None, "FAILED"), ("told", 15, None), ("new", 17, "INDEXED"), ("new", 16, "INDEXED"), (None, 18, "FAILED"),
              (None, 19, "FAILED"), ("never", None, "INDEXED"), ("both", 20, None), ("both", None, "INDEXED")]
    rows = spark.createDataFrame([(h, u, f"p{u}", v, n) for n, (h, u, v) in enumerate(events)],
                                 "file_hash string, upload_id long, path string, verdict string, row long")
    outcomes, changed = registry.register(rows, spark.createDataFrame(files, registry.FILE))
    state, expected = {h: (s, d) for h, s, d in files}, {}
    # Uploads by id first, then the verdicts; a verdict known with the upload takes the place of PROCESSING.
    for h, upload, verdict in sorted(events, key=lambda e: (e[1] is None, e[1] or 0)):
        status, document = state.get(h, (None, None))
        if upload is None:
            if document is not None:
                state[h] = (registry.step(status, document, {"upload_id": None, "verdict": verdict})[3], document)
            continue
        fresh = any(expected[u][4] for u in expected if expected[u][5] == h)
        outcome, document, action, after = registry.step("PROCESSING" if fresh else status, document, {"upload_id": upload, "verdict": verdict})
        opened = outcome == "QUEUED"
        expected[upload] = (outcome, document, action, (verdict or after) if opened or fresh else after, opened, h)
        if opened:
            state[h] = (verdict or after, document)
    found = {r.upload_id: (r.outcome, r.document_id, r.action, r.status) for r in outcomes.collect()}
    assert found == {u: e[:4] for u, e in expected.items()}
    after = {h: (s, d) for h, s, d in files} | {r.file_hash: (r.status, r.document_id) for r in changed.collect()}
    assert after == state


def test_files_are_judged_without_a_python_call_for_each(spark):
    rows = spark.createDataFrame([("h", 1, "p", "INDEXED", 0)], "file_hash string, upload_id long, path string, verdict string, row long")
    outcomes, _ = registry.register(rows, spark.createDataFrame([], registry.FILE))
    assert "Pandas" not in outcomes._jdf.queryExecution().toString()
