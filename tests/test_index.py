"""The stored search index and the scan: the same answers as scoring every pair, from plans that move no text."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import WORDS, frames, random_corpus

from groundwork.functions import vectors as vx
from groundwork.operators import fulltext as ft
from groundwork.operators import ranking, scope
from groundwork.session import scratch_dir
from groundwork.sources import postings
from groundwork.sources.postings import TextIndex


def index_of(spark, *batches, buckets=8):
    index = TextIndex(spark, scratch_dir(spark, "test-index"), tuple(WORDS.stop_words), buckets)
    for batch in batches:
        index.append(batch)
    return index


def ranked(matches):
    return sorted(map(tuple, matches.collect()))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_appending_in_parts_equals_appending_at_once(spark):
    chunks, queries = random_corpus(21, 60)
    frame, asked = frames(spark, chunks, queries)
    whole = ranked(ft.match_questions(frame, asked, WORDS))
    parts = index_of(spark, frame.where("chunk_id < 20"), frame.where("chunk_id >= 20"))
    assert ranked(ft.match_index(parts, asked, WORDS)) == whole and whole
    assert sum(r.chunks for r in parts.terms().collect()) == parts.postings().count()


def test_removed_documents_are_not_found_until_they_are_indexed_again(spark):
    chunks, queries = random_corpus(22, 45)
    frame, asked = frames(spark, chunks, queries)
    gone = frame.where("document_id % 4 = 1").select("document_id")
    index = index_of(spark, frame)
    index.remove(gone)
    left = frame.where("document_id % 4 <> 1")
    assert ranked(ft.match_index(index, asked, WORDS)) == ranked(ft.match_questions(left, asked, WORDS))
    index.append(frame.where("document_id % 4 = 1").withColumn("content", F.concat(F.lit("gravity "), "content")))
    again = left.unionByName(frame.where("document_id % 4 = 1").withColumn("content", F.concat(F.lit("gravity "), "content")))
    assert ranked(ft.match_index(index, asked, WORDS)) == ranked(ft.match_questions(again, asked, WORDS))


def test_a_search_reads_only_the_folders_of_its_terms_and_no_text(spark):
    chunks, _ = random_corpus(23, 30)
    frame, asked = frames(spark, chunks, [(1, "gravity")])
    matches = ft.match_index(index_of(spark, frame), asked, WORDS)
    plan = plan_of(matches)
    assert "content" not in plan and "title" not in plan
    scans = [line for line in plan.split("\n") if "FileScan" in line and "term_bucket" in line]
    assert scans and all(re.search(r"PartitionFilters: \[.*term_bucket#\d+ = \d", line) for line in scans)


def test_visibility_decides_in_both_searches(spark, monkeypatch):
    chunks, queries = random_corpus(24, 60)
    frame, asked = frames(spark, chunks, queries)
    rng = random.Random(5)
    scopes = {q: rng.choice([None, ["a"], ["b", "z"], ["z"]]) for q, _ in queries}
    asked = asked.join(spark.createDataFrame(list(scopes.items()), "query_id long, scope array<string>"), "query_id")
    subjects = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "subject_id string, active boolean")
    tags = [(d, s) for d in range(20) for s in "abc" if rng.random() < 0.3]
    visibility = scope.document_visibility(spark.createDataFrame(tags, "document_id long, subject_id string"), subjects)
    held = {d: [s for n, s in tags if n == d] for d in range(20)}

    def sees(query, document):
        active = [s for s in held[document] if s != "c"]
        wanted = scopes[query]
        return bool(active) or not held[document] if wanted is None else bool(set(active) & set(wanted))

    seen = {q: frame.where(F.col("document_id").isin([d for d in range(20) if sees(q, d)])) for q in scopes}
    found = ranked(ft.match_index(index_of(spark, frame), asked, WORDS, visibility))
    scanned = ranked(ft.lexical_scan(frame, asked, WORDS, visibility))
    for q in list(scopes)[:8]:
        one = asked.where(F.col("query_id") == q).drop("scope")
        assert [r for r in found if r[0] == q] == ranked(ft.match_questions(seen[q], one, WORDS))
        assert [r for r in scanned if r[0] == q] == ranked(ft.lexical_scan(seen[q], one, WORDS))
    # Too large to be sent: joined behind the scan instead.
    monkeypatch.setattr(ft, "is_small", lambda table: False)
    assert ranked(ft.lexical_scan(frame, asked, WORDS, visibility)) == scanned
    assert ranked(ft.match_index(index_of(spark, frame), asked, WORDS, visibility)) == found


def test_questions_in_blocks_find_the_same(spark, monkeypatch):
    chunks, queries = random_corpus(25, 50)
    frame, asked = frames(spark, chunks, queries)
    whole = ranked(ft.match_questions(frame, asked, WORDS))
    monkeypatch.setattr(ft, "SHIPPED_ROWS", 9)
    monkeypatch.setattr(ranking, "PAIRS", 60)
    monkeypatch.setattr(ft, "_blocks", lambda rows, size=9, plain=ft._blocks: plain(rows, 9))
    assert ranked(ft.match_questions(frame, asked, WORDS)) == whole


def test_the_scan_moves_no_text(spark, tmp_path):
    chunks, queries = random_corpus(26, 30)
    frame, asked = frames(spark, chunks, queries)
    frame.repartition(4).write.parquet(str(tmp_path / "chunks"))
    plan = plan_of(ft.lexical_scan(spark.read.parquet(str(tmp_path / "chunks")), asked, WORDS))
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow", 1)[1]


def test_scan_of_odd_chunks(spark):
    odd = spark.createDataFrame(
        [(1, 1, None, None), (2, 1, "", ""), (3, 2, "Moon", None), (4, None, None, "moon " * 50_000), (5, 3, " ", "a  b"), (5, 3, " ", "a  b")],
        "chunk_id long, document_id long, title string, content string")
    asked = spark.createDataFrame([(1, "moon"), (2, "  "), (3, ""), (4, "a  b")], "query_id long, query string")
    found = {(r.query_id, r.chunk_id): r.lexical_score for r in ft.lexical_scan(odd, asked, WORDS).collect()}
    # A one-word title and the phrase; the word in a content and the phrase; four blanks are a phrase, too.
    assert found[1, 3] == 8.0 * 5 + 30 and found[1, 4] == 8.0 + 30 and found[4, 5] == 30.0
    assert (1, 1) not in found and (1, 2) not in found
    nothing = ft.lexical_scan(odd.where("false"), asked, WORDS)
    assert nothing.count() == 0 and ft.lexical_scan(odd, asked.where("false"), WORDS).count() == 0
    assert ft.match_questions(odd, asked.where("false"), WORDS).count() == 0
    assert {r.chunk_id for r in ft.match_questions(odd, asked, WORDS).where("query_id = 1").collect()} == {3, 4}


def test_best_keeps_the_first_of_equals():
    best = ranking.Best(2, 2)
    best.add(np.array([5, 3, 9]), np.array([[1.0, 1.0, 1.0], [2.0, -np.inf, 3.0]]))
    best.add(np.array([4, 1]), np.array([[1.0, 0.5], [2.0, 2.0]]))
    questions, ids, scores = best.rows(np.array([10, 20]))
    assert list(zip(questions.tolist(), ids.tolist(), scores.tolist())) == [(10, 3, 1.0), (10, 4, 1.0), (20, 9, 3.0), (20, 1, 2.0)]


def test_hashed_words_count_like_a_loop(spark):
    import hashlib
    import math

    texts = [None, "", "ab cd", "moon moon planet", "Éclair moon x1y " * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select(
        "n", vx.hashed_words(F.col("text"), 16).alias("v")).collect()
    for n, vector in rows:
        words = [w for w in (texts[n] or "").lower().replace("é", "e").split() if len(w) >= 3]
        counts = [0] * 16
        for w in words:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        size = math.sqrt(sum(c * c for c in counts))
        expected = [np.float32(c / size) for c in counts] if size else [1.0] + [0.0] * 15
        assert vector == pytest.approx(expected, abs=1e-7)


def test_strict_search_hands_on_complete_chunks_only(spark, monkeypatch):
    # Every chunk holds the rarest term of the question, two of them all of its terms.
    docs = [(n, n, "t", "rarest " + ("second third " if n % 20 == 0 else "second ") + "more words") for n in range(40)]
    frame = spark.createDataFrame(docs, "chunk_id long, document_id long, title string, content string")
    asked = spark.createDataFrame([(1, "rarest second third")], "query_id long, query string")
    written, settle = {}, ft.settle
    monkeypatch.setattr(ft, "settle", lambda table, purpose: written.setdefault(purpose, settle(table, purpose)))
    index = index_of(spark, frame)
    found = ft.match_index(index, asked, WORDS, modes=["strict"]).collect()
    assert sorted((r.chunk_id, r.mode) for r in found) == [(0, "strict"), (20, "strict")]
    assert written["strict-pairs"].count() == 2


def test_postings_are_grouped_before_they_are_shuffled(spark):
    # A chunk of more tokens than an Arrow batch has rows, next to short ones, an empty one and two of one id.
    long = " ".join(f"w{n % 700}" for n in range(25_000))
    rows = [(1, 1, "", long), (2, 1, "alpha", "beta alpha"), (3, 2, None, ""), (4, 2, "gamma", long), (5, 3, "one two", "one"),
            (5, 3, "two", "two three")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, title string, content string").coalesce(1)
    found = postings.postings_of(chunks, ("beta",))
    tokens = postings.tokens_of(chunks, ("beta",)).collect()
    expected = {}
    for t in tokens:
        expected.setdefault((t.term, t.chunk_id, t.document_id), []).append(t.position)
    got = found.collect()
    assert len(got) == len(expected)
    assert {(r.term, r.chunk_id, r.document_id): (r.hits, r.positions) for r in got} == {
        k: (len(p), sorted(p)) for k, p in expected.items()}
    plan = postings.postings_of(chunks.where("chunk_id < 5"), ())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
