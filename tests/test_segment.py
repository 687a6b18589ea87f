from __future__ import annotations

import random

from pyspark.sql import functions as F

from groundwork.operators import ingest, segment
from groundwork.sources import sinks
from groundwork.session import scratch_dir


def windows(text: str) -> list[tuple[int, int]]:
    """Plain restatement of the window rule."""
    text = text.strip("".join(map(chr, range(33))))
    at, out = 0, []
    while at < len(text):
        end = min(at + 1000, len(text))
        if end < len(text):
            cuts = [i for i in range(at + 501, end + 1) if text[i - 1] in "\n.;!"]
            end = cuts[-1] if cuts else end
        out.append((at, end))
        if end >= len(text):
            break
        at = end - 150 if end - 150 > at else end
    return out


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")


def test_windows_equal_the_plain_loop(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abc é. ;\n!", [30, 30, 30, 9, 1, 0.2, 9, 0.2, 0.2, 0.1], k=rng.randint(1, 6000))) for _ in range(40)]
    rows = segment.segment(docs(spark, *texts), segment.recursive).collect()
    for n, text in enumerate(texts):
        got = [(r["char_start"], r["char_end"]) for r in sorted((r for r in rows if r["document_id"] == n), key=lambda r: r["sequence_number"])]
        stripped = text.strip("".join(map(chr, range(33))))
        assert got == [(s, e) for s, e in windows(text) if stripped[s:e].strip()]


def test_questions_drop_the_preamble_and_keep_the_numbers(spark):
    text = "Preface 12\n001 — First topic\nbody one\n17 - Second\nbody two\n"
    rows = segment.segment(docs(spark, text), segment.structured_qa).orderBy("sequence_number").collect()
    assert [(r["title"], r["question_number"]) for r in rows] == [("Pergunta 001 — First topic", 1), ("Pergunta 17 — Second", 17)]
    assert rows[0]["content"] == "001 — First topic\nbody one"


def test_a_heading_may_run_over_a_line_end(spark):
    text = "5 -\n6 - six\nrest"
    rows = segment.segment(docs(spark, text), segment.structured_qa).collect()
    assert [r["title"] for r in rows] == ["Pergunta 5 — 6 - six"]


def test_articles(spark):
    rows = segment.segment(docs(spark, "Art. 1º One\ntext\nARTIGO 2-A two"), segment.legal_sections).collect()
    assert [r["title"] for r in rows] == ["Artigo 1", "Artigo 2-A"]


def test_strategy_falls_back(spark):
    frame = spark.createDataFrame(
        [(1, "no heading here", "STRUCTURED_QA"), (2, "1 - x\ny", None), (3, "1 - x\ny", "STRUCTURED_QA"), (4, "  \n", None)],
        "document_id long, text string, strategy string",
    )
    rows = {r["document_id"]: r["strategy"] for r in segment.segment_by_strategy(frame).collect()}
    assert rows == {1: "RECURSIVE", 2: "RECURSIVE", 3: "STRUCTURED_QA"}


def test_pages_give_the_first_page_that_holds_the_chunk(spark):
    pages = spark.createDataFrame([(1, 2, "beta text\r\n"), (1, 1, "alpha text"), (1, 3, "beta text")], "document_id long, page_no int, text string")
    full = ingest.assemble_full_text(pages)
    row = full.first()
    assert row["text"] == "alpha text\n\nbeta text\n\nbeta text\n\n" and row["total_pages"] == 3
    page = full.select(segment.first_page_with(F.lit("beta"), F.col("pages")), segment.first_page_with(F.lit("none"), F.col("pages"))).first()
    assert tuple(page) == (2, 1)


def test_oversized_documents_are_not_assembled(spark):
    pages = spark.range(30).selectExpr("id % 2 as document_id", "cast(id as int) as page_no", "'t' as text")
    pages = pages.where("document_id = 0 or page_no < 6")
    assert [r["document_id"] for r in ingest.assemble_full_text(pages, max_pages=5).collect()] == [1]


def test_writing_twice_equals_writing_once(spark):
    path = scratch_dir(spark, "sink-test")
    chunks = segment.segment(docs(spark, "a. " * 900, "b; " * 900, "a. " * 900), segment.recursive)
    rows = sinks.stored_chunk_rows(ingest.dedupe_chunks(chunks))
    sinks.append_new_chunks(spark, rows, path, buckets=4)
    once = sorted(map(tuple, sinks.read_chunks(spark, path).collect()))
    sinks.append_new_chunks(spark, rows, path, buckets=4)
    assert sorted(map(tuple, sinks.read_chunks(spark, path).collect())) == once
    assert {r[0] for r in once} == {0, 1, 2}


def test_written_documents_become_indexed(spark):
    docs_table = spark.createDataFrame([(1, "PROCESSING", None), (2, "FAILED", None)], "document_id long, status string, total_pages int")
    counts = spark.createDataFrame([(1, 7)], "document_id long, pages int")
    assert sorted(map(tuple, sinks.mark_indexed(docs_table, counts).select("document_id", "status", "total_pages").collect())) == [(1, "INDEXED", 7), (2, "FAILED", None)]
