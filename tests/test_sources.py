from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import functions as F

from groundwork.operators import ingest
from groundwork.sources import files
from groundwork.sources.tables import scan


def test_intake_reads_files_as_bytes(spark):
    folder = tempfile.mkdtemp(prefix="intake-")
    contents = {"a.pdf": b"%PDF-1.7 first", "b.pdf": b"plain text", "c.pdf": b"%PDF-1.7 first"}
    for name, content in contents.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(content)
    rows = files.intake_manifest(files.read_files(spark, folder, "*.pdf")).collect()
    digest = hashlib.sha256(contents["a.pdf"]).hexdigest()
    assert sorted(r["file_name"].rsplit("/", 1)[1] for r in rows) == ["a.pdf", "c.pdf"]
    assert {(r["file_hash"], r["file_size"], r["storage_path"]) for r in rows} == {(digest, 14, f"{digest}.pdf")}


def test_a_batch_with_copies_queues_the_first_one_only(spark):
    uploads = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "w")], "upload_id long, file_hash string")
    stored = spark.createDataFrame([(10, "y", "INDEXED"), (11, "z", "PROCESSING"), (12, "w", "FAILED")], "document_id long, file_hash string, status string")
    got = {r["upload_id"]: (r["outcome"], r["action"]) for r in ingest.classify_uploads(uploads, stored).collect()}
    assert got == {
        1: ("QUEUED", "CREATE"), 2: ("ALREADY_PROCESSING", "REUSE"), 3: ("ALREADY_INDEXED", "REUSE"),
        4: ("ALREADY_PROCESSING", "REUSE"), 5: ("QUEUED", "RESET"),
    }


def test_a_scan_reads_only_the_columns_it_needs(spark):
    table = scan(spark, "/root/testdata/sf0.001/documents.parquet", ["doc_id"]).where(F.col("doc_id") > 3)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "GreaterThan(doc_id,3)" in plan
