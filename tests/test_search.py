from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from groundwork.operators import fulltext as ft
from groundwork.operators import grounding, scope, search
from groundwork.operators import vector_search as vs

WORDS = ft.Vocabulary(["the", "and", "of", "to"], ["sun"])


def plain_score(query: str, title: str, content: str) -> float:
    """Plain restatement of the term-overlap rule for text that is already normal."""
    terms = re.split(r"\s+", query.rstrip())
    score = 30.0 if query in f"{title} {content}" else 0.0
    titles = contents = 0
    for term in terms:
        if len(term) < 2 or term in WORDS.stop_words:
            continue
        common = term in WORDS.ubiquitous
        weight = 1.0 if common else 8.0 if len(term) <= 4 or re.search(r"\d", term) else 4.0
        stem = term[:6] if len(term) >= 7 else term[:-1] if len(term) >= 5 else term
        if term in title or stem in title:
            titles, score = titles + 1, score + weight * (1.5 if common else 5.0)
        if term in content or stem in content:
            contents, score = contents + 1, score + weight
    return 0.0 if titles == 0 and contents < 2 and len(terms) >= 3 else score


def random_corpus(seed: int, size: int):
    rng = random.Random(seed)
    vocabulary = ["sun", "moon", "the", "and", "planet", "planets", "gravity", "gravitation", "x1", "orbit", "to", "of", "ion", "a"]
    pick = lambda n: " ".join(rng.choices(vocabulary, k=n))
    chunks = [(n, n // 3, pick(rng.randint(0, 3)), pick(rng.randint(1, 12))) for n in range(size)]
    queries = [(n, pick(rng.randint(1, 6)) + rng.choice(["", " ", "  "])) for n in range(25)]
    queries += [(100, "the"), (101, "and the "), (102, " sun the"), (103, "a"), (104, "the and of"), (105, "planet planet x")]
    return chunks, queries


def frames(spark, chunks, queries):
    return (
        spark.createDataFrame(chunks, "chunk_id long, document_id long, title string, content string"),
        spark.createDataFrame(queries, "query_id long, query string"),
    )


@pytest.mark.parametrize("block", [1000, 7])
def test_scan_equals_scoring_every_pair(spark, block):
    chunks, queries = random_corpus(3, 60)
    frame, asked = frames(spark, chunks, queries)
    got = ft.lexical_scan(frame, asked, WORDS, limit=10, block=block).collect()
    for query_id, query in queries:
        scores = [(-plain_score(query, t, c), n) for n, _, t, c in chunks]
        expected = [(n, -s) for s, n in sorted(scores) if s < 0][:10]
        mine = sorted((r for r in got if r["query_id"] == query_id), key=lambda r: r["rank"])
        assert [(r["chunk_id"], r["lexical_score"]) for r in mine] == expected, query


def stems(text):
    cut = lambda w: w[:6] if len(w) >= 7 else w[:-1] if len(w) >= 5 else w
    return [(n, cut(w)) for n, w in enumerate(re.split(r"[^a-z0-9]+", text)) if w and w not in WORDS.stop_words]


def plain_cover_density(text: str, wanted: set[str]) -> float:
    places = [(p, w) for p, w in stems(text) if w in wanted]
    total = 0.0
    for i in range(len(places)):
        for j in range(i, len(places)):
            held = {w for _, w in places[i : j + 1]}
            if held == wanted:
                smaller = any({w for _, w in places[a : b + 1]} == wanted for a in range(i, j + 1) for b in range(a, j + 1) if (a, b) != (i, j))
                if not smaller:
                    total += 0.1 / (1 + places[j][0] - places[i][0] - (j - i))
    return round(total, 6)


def test_strict_and_relaxed_equal_brute_force(spark):
    chunks, queries = random_corpus(5, 80)
    frame, asked = frames(spark, chunks, queries)
    got = ft.match_questions(frame, asked, WORDS, strict_limit=10, relaxed_limit=50).collect()
    for query_id, query in queries:
        wanted = {w for _, w in stems(query)}
        texts = [(n, f"{t} {c}") for n, _, t, c in chunks]
        strict = sorted((-plain_cover_density(x, wanted), n) for n, x in texts if wanted and wanted <= {w for _, w in stems(x)})[:10]
        mine = {m: [(-r["rank_value"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query_id and r["mode"] == m]
                for m in ("strict", "relaxed")}
        assert mine["strict"] == strict
        short = {w for raw in re.split(r"[^a-z0-9]+", query) if len(raw) >= 2 for _, w in stems(raw)}
        counted = [(-round(0.1 * sum(Counter(w for _, w in stems(x))[w] for w in short), 6), n) for n, x in texts]
        assert mine["relaxed"] == sorted((s, n) for s, n in counted if s < 0)[:50]


def test_many_questions_take_the_joins_instead_of_broadcasts(spark, monkeypatch):
    chunks, queries = random_corpus(8, 40)
    frame, asked = frames(spark, chunks, queries)

    def run():
        matches = ft.match_questions(frame, asked, WORDS)
        text = ft.lexical_candidates(matches, frame, asked, WORDS)
        return sorted(map(tuple, text.collect())), sorted(map(tuple, ft.lexical_scan(frame, asked, WORDS).collect()))

    shipped = run()
    monkeypatch.setattr(ft, "is_small", lambda table: False)
    assert run() == shipped


def test_relaxed_list_is_cut_before_strict_ones_leave(spark):
    # Twelve chunks: all hold "moon", four hold "moon planet".
    chunks = [(n, n, "", "moon planet" if n < 4 else "moon") for n in range(12)]
    frame, asked = frames(spark, chunks, [(1, "moon planet")])
    text = ft.lexical_candidates(ft.match_questions(frame, asked, WORDS), frame, asked, WORDS).collect()
    assert sum(r["full_text_match"] for r in text) == 4
    # Best ten relaxed ones hold the four strict ones, so six others remain.
    assert len(text) == 10 and [r["text_rank"] for r in sorted(text, key=lambda r: r["text_rank"])] == list(range(1, 11))


def test_approximate_search_finds_nine_of_ten_neighbours(spark):
    rng = np.random.default_rng(4)
    stored = spark.createDataFrame(
        [(n, rng.normal(size=48).tolist(), [], True) for n in range(1500)],
        "chunk_id long, embedding array<float>, subjects array<string>, default_visible boolean")
    asked = spark.createDataFrame(
        [(q, rng.normal(size=48).tolist(), None) for q in range(400)],
        "query_id long, embedding array<float>, scope array<string>")
    exact, found = [{(r["query_id"], r["chunk_id"]) for r in search(stored, asked, 48).collect()}
                    for search in (vs.vector_topk, vs.vector_topk_approx)]
    assert len(exact) == 4000 and len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("shipped, group_rows", [(1000, 1000), (3, 40)])
def test_vector_topk_equals_brute_force_with_copies_and_scopes(spark, shipped, group_rows):
    rng = np.random.default_rng(1)
    copy = rng.normal(size=8).astype(np.float32)
    chunks = []
    for n in range(300):
        vector = copy if n % 3 == 0 else rng.normal(size=8).astype(np.float32)  # a third are copies
        broken = {7: None, 11: [0.0] * 8, 13: [float("nan")] * 8, 17: [1.0]}.get(n, vector.tolist())
        subjects = [["a"], ["b"], [], ["a", "b"]][n % 4]
        chunks.append((n, broken, subjects, bool(subjects) or n % 8 != 2))
    questions = [(q, (copy if q == 0 else rng.normal(size=8)).astype(float).tolist(), [None, ["a"], ["b", "z"], ["z"]][q % 4]) for q in range(12)]
    stored = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>, subjects array<string>, default_visible boolean")
    asked = spark.createDataFrame(questions, "query_id long, embedding array<float>, scope array<string>")
    got = vs.vector_topk(stored, asked, 8, k=5, shipped=shipped, group_rows=group_rows).collect()
    exact = vs.vector_topk_approx(stored, asked, 8, k=5, cells=4, probes=4, group_rows=30, question_rows=5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact))  # all cells probed
    for q, vector, allowed in questions:
        scores = []
        for n, v, subjects, default in chunks:
            seen = default if allowed is None else bool(set(subjects) & set(allowed))
            if seen and v is not None and len(v) == 8 and np.isfinite(v).all() and any(v):
                a, b = np.float32(vector).astype(float), np.float32(v).astype(float)
                scores.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), n))
        mine = [(-r["similarity"], r["chunk_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == sorted(scores)[:5]


def test_a_chunk_in_both_lists_beats_either(spark):
    vector = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, chunk_id long, rank int, similarity double")
    text = spark.createDataFrame([(1, 11, 1, 8.0, True), (1, 12, 2, 4.0, False)], "query_id long, chunk_id long, text_rank int, lexical_score double, full_text_match boolean")
    rows = search.rrf_fuse(vector, text).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [11, 10, 12]
    assert rows[0]["score"] == 1 / 62 + 1 / 61 and rows[2]["vector_rank"] is None
    lists = [vector.select("query_id", "chunk_id", "rank"), text.selectExpr("query_id", "chunk_id", "text_rank as rank")]
    assert {r["chunk_id"]: r["score"] for r in search.fuse_lists(lists).collect()}[11] == round(1 / 62 + 1 / 61, 9)


def test_visibility_matrix(spark):
    subjects = spark.createDataFrame([("on", True), ("off", False), ("other", True)], "subject_id string, active boolean")
    tags = spark.createDataFrame([(1, "on"), (2, "off"), (4, "on"), (4, "off"), (5, "other")], "document_id long, subject_id string")
    docs = spark.createDataFrame([(n,) for n in range(1, 6)], "document_id long")
    assert sorted(r[0] for r in scope.visible_docs_default(docs, tags, subjects).collect()) == [1, 3, 4, 5]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    requests = spark.createDataFrame([(1, "on"), (1, "on"), (2, "off"), (3, "on"), (3, "other")], "query_id long, subject_id string")
    scopes = scope.resolve_subject_scope(asked, requests, subjects)
    assert {r["query_id"]: r["scope"] for r in scopes.collect()} == {1: ["on"], 2: None, 3: None}
    assert sorted(r["document_id"] for r in scope.visible_docs_filtered(scopes, tags, subjects).collect()) == [1, 4]


def test_repeated_questions_get_the_same_answer(spark):
    chunks, queries = random_corpus(13, 30)
    frame, asked = frames(spark, chunks, queries + [(1000 + n, q) for n, q in queries])
    rows = search.hybrid_search(asked, frame, WORDS).collect()
    first = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in rows if r["query_id"] < 1000)
    again = sorted((r["query_id"] - 1000, r["rank"], r["chunk_id"]) for r in rows if r["query_id"] >= 1000)
    assert first == again and first


def test_a_blank_question_finds_nothing_and_no_vectors_still_answers(spark):
    frame, asked = frames(spark, [(1, 1, "moon", "gravity of the moon")], [(1, "  "), (2, "gravity moon")])
    rows = search.hybrid_search(asked, frame, WORDS).collect()
    assert [(r["query_id"], r["vector_rank"], r["text_rank"]) for r in rows] == [(2, None, 1)]


@pytest.mark.parametrize("similarity, lexical, full_text, grounded", [
    (0.64, 0.0, False, False), (0.65, 0.0, False, True), (float("nan"), 0.0, False, False),
    (None, 4.0, False, True), (None, 3.5, False, False), (None, 0.0, True, True),
])
def test_evidence(spark, similarity, lexical, full_text, grounded):
    results = spark.createDataFrame([(1, similarity, lexical, full_text)], "query_id long, similarity double, lexical_score double, full_text_match boolean")
    questions = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r[0]: r[1] for r in grounding.is_grounded(questions, results).collect()} == {1: grounded, 2: False}


def test_scan_hands_on_the_best_only_where_visibility_is_large(spark, monkeypatch):
    chunks, queries = random_corpus(5, 60)
    frame, asked = frames(spark, chunks, queries)
    seen = spark.createDataFrame(
        [(c[1], ["a"] if c[1] % 2 else [], c[1] % 2 == 1) for c in {c[1]: c for c in chunks}.values()],
        "document_id long, subjects array<string>, default_visible boolean")
    expected = sorted(map(tuple, ft.lexical_scan(frame, asked, WORDS, seen).collect()))
    limits, scan = [], ft._scan
    monkeypatch.setattr(ft, "_scan", lambda shared, limit: limits.append(limit) or scan(shared, limit))
    monkeypatch.setattr(ft, "is_small", lambda *a: False)
    assert sorted(map(tuple, ft.lexical_scan(frame, asked, WORDS, seen).collect())) == expected and expected
    assert limits and None not in limits
