"""Queries: scope, lexical and vector ranking, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as tx
from groundwork.functions import vectors as vx
from groundwork.operators import evaluation, scope, search
from groundwork.operators import fulltext as ft
from groundwork.operators import vector_search as vs
from groundwork.plans import duck, stored
from groundwork.plans.registry import query
from groundwork.plans.views import STOP_WORDS, UBIQUITOUS, Inputs
from groundwork.session import settle

WORDS = ft.Vocabulary(STOP_WORDS, UBIQUITOUS)
DIMENSIONS = duck.DIMENSIONS

# -- inputs --------------------------------------------------------------------------------


def visibility(i: Inputs) -> DataFrame:
    return scope.document_visibility(i.doc_subjects, i.subjects)


def scoped_questions(i: Inputs) -> DataFrame:
    """The questions with scope and vector, written once: a search reads them many times."""
    scopes = scope.resolve_subject_scope(i.bench_queries, i.subject_requests, i.subjects)
    vector = vx.hashed_words(F.col("query"), DIMENSIONS)
    return settle(i.bench_queries.join(scopes, "query_id").withColumn("embedding", vector), "questions")


def matches(i: Inputs, *modes: str) -> DataFrame:
    return ft.match_index(stored.text_index(i), scoped_questions(i), WORDS, visibility(i), modes=modes or ("strict", "relaxed"))


# -- the same in SQL -----------------------------------------------------------------------

VIEWS = {
    "doc_vis": """
        SELECT d.document_id, count(*) FILTER (s.active) > 0 AS default_visible,
               list(s.subject_id) FILTER (s.active) AS subjects
        FROM doc_subjects d JOIN subjects s USING (subject_id) GROUP BY d.document_id""",
    "scopes": """
        SELECT q.query_id, CASE WHEN len(a.scope) < (SELECT count(*) FROM subjects WHERE active) THEN a.scope END AS scope
        FROM bench_queries q LEFT JOIN (
          SELECT r.query_id, list(DISTINCT r.subject_id ORDER BY r.subject_id) AS scope
          FROM subject_requests r JOIN subjects s ON s.subject_id = r.subject_id AND s.active GROUP BY r.query_id) a
        ON a.query_id = q.query_id""",
    # Every (question, chunk) the question may see.
    "seen": """
        SELECT s.query_id, c.document_id
        FROM scopes s CROSS JOIN (SELECT doc_id AS document_id FROM documents) c
        LEFT JOIN doc_vis v ON v.document_id = c.document_id
        WHERE CASE WHEN s.scope IS NULL THEN coalesce(v.default_visible, true)
                   ELSE coalesce(list_has_any(v.subjects, s.scope), false) END""",
    "doc_words": f"""
        SELECT chunk_id, document_id, CAST(ord - 1 AS INT) AS position, {duck.stem("item")} AS term
        FROM chunk_docs, unnest({duck.words("title || ' ' || content")}) WITH ORDINALITY AS t(item, ord)
        WHERE {duck.searchable("item")}""",
    "q_strict": f"SELECT DISTINCT query_id, unnest({duck.analyze('query')}) AS term FROM bench_queries",
    "q_relaxed": f"""
        SELECT DISTINCT query_id, unnest({duck.analyze("short")}) AS term
        FROM (SELECT query_id, array_to_string({duck.query_terms("query")}, ' ') AS short FROM bench_queries)""",
    "strict_occurrences": """
        SELECT query_id, chunk_id, position, term, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position) AS i
        FROM (SELECT q.query_id, w.chunk_id, w.position, w.term,
                     len(list(DISTINCT w.term) OVER (PARTITION BY q.query_id, w.chunk_id)) AS found,
                     (SELECT count(*) FROM q_strict n WHERE n.query_id = q.query_id) AS asked
              FROM doc_words w JOIN q_strict q ON q.term = w.term
              JOIN seen s ON s.query_id = q.query_id AND s.document_id = w.document_id)
        WHERE found = asked""",
    "last_seen": """
        SELECT o.query_id, o.chunk_id, o.i, o.position, q.term,
               max(CASE WHEN o.term = q.term THEN o.i END) OVER (PARTITION BY o.query_id, o.chunk_id, q.term ORDER BY o.i) AS last_i
        FROM strict_occurrences o JOIN q_strict q ON q.query_id = o.query_id""",
    "spans": """
        SELECT *, lag(s) OVER (PARTITION BY query_id, chunk_id ORDER BY i) AS before FROM (
          SELECT query_id, chunk_id, i, position, CASE WHEN count(last_i) = count(*) THEN min(last_i) END AS s
          FROM last_seen GROUP BY ALL)""",
    "strict_ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_value DESC, chunk_id)::INT AS rank FROM (
          SELECT p.query_id, p.chunk_id, round(sum(0.1::DOUBLE / (1 + (p.position - o.position) - (p.i - p.s))), 6) AS rank_value
          FROM spans p JOIN strict_occurrences o ON o.query_id = p.query_id AND o.chunk_id = p.chunk_id AND o.i = p.s
          WHERE p.s IS NOT NULL AND (p.before IS NULL OR p.s > p.before) GROUP BY p.query_id, p.chunk_id)""",
    "strict_top": "SELECT * FROM strict_ranked WHERE rank <= 10",
    "relaxed_top": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_value DESC, chunk_id)::INT AS rank FROM (
            SELECT q.query_id, w.chunk_id, round(count(*) * 0.1::DOUBLE, 6) AS rank_value
            FROM doc_words w JOIN q_relaxed q ON q.term = w.term
            JOIN seen s ON s.query_id = q.query_id AND s.document_id = w.document_id
            GROUP BY q.query_id, w.chunk_id)) WHERE rank <= 50""",
    "q_norm": rf"""
        SELECT query_id, nq, regexp_split_to_array(regexp_replace(nq, '\s+$', ''), '\s+') AS terms
        FROM (SELECT query_id, {duck.normalize("query")} AS nq FROM bench_queries)""",
    "doc_norm": f"SELECT chunk_id, document_id, {duck.normalize('title')} AS a, {duck.normalize('content')} AS b FROM chunk_docs",
}


def overlap(pairs: str) -> str:
    """``query_id, chunk_id, lexical_score`` of the pairs of a view."""
    ubiquitous = f"w IN ({duck.UBIQUITOUS_LIST})"
    weight = f"CASE WHEN {ubiquitous} THEN 1.0 WHEN regexp_matches(w, '[0-9]') OR length(w) <= 4 THEN 8.0 ELSE 4.0 END"
    return f"""
    SELECT query_id, chunk_id, (CASE WHEN titles = 0 AND contents < 2 AND len(terms) >= 3 THEN 0
             ELSE gained + CASE WHEN contains(a || ' ' || b, nq) THEN 30 ELSE 0 END END)::DOUBLE AS lexical_score
    FROM (SELECT p.query_id, p.chunk_id, n.a, n.b, q.nq, q.terms, coalesce(sum(h.gain), 0) AS gained,
                 coalesce(sum(h.t), 0) AS titles, coalesce(sum(h.c), 0) AS contents
          FROM {pairs} p JOIN q_norm q ON q.query_id = p.query_id JOIN doc_norm n ON n.chunk_id = p.chunk_id,
          LATERAL (SELECT sum(t) AS t, sum(c) AS c, sum(t * weight * factor + c * weight) AS gain FROM (
            SELECT contains(n.a, pattern)::INT AS t, contains(n.b, pattern)::INT AS c, weight, factor FROM (
              SELECT {duck.stem("w")} AS pattern, {weight} AS weight, CASE WHEN {ubiquitous} THEN 1.5 ELSE 5.0 END AS factor
              FROM (SELECT unnest(q.terms) AS w) u WHERE length(w) >= 2 AND w NOT IN ({duck.quoted(STOP_WORDS)})) x) y) h
          GROUP BY ALL) z"""


VIEWS |= {
    "candidate_pairs": """
        SELECT coalesce(s.query_id, r.query_id) AS query_id, coalesce(s.chunk_id, r.chunk_id) AS chunk_id,
               s.rank AS strict_rank, r.rank AS relaxed_rank
        FROM strict_top s FULL JOIN relaxed_top r ON r.query_id = s.query_id AND r.chunk_id = s.chunk_id""",
    "scored_pairs": overlap("candidate_pairs"),
    "best_relaxed": """
        SELECT * FROM (
          SELECT p.query_id, p.chunk_id, o.lexical_score,
                 row_number() OVER (PARTITION BY p.query_id ORDER BY o.lexical_score DESC, p.relaxed_rank) AS best
          FROM candidate_pairs p JOIN scored_pairs o ON o.query_id = p.query_id AND o.chunk_id = p.chunk_id
          WHERE p.relaxed_rank IS NOT NULL AND o.lexical_score > 0) WHERE best <= 10""",
    "text_ranked": """
        SELECT query_id, chunk_id, text_rank, lexical_score, full_text_match FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY full_text_match DESC, pos)::INT AS text_rank FROM (
            SELECT s.query_id, s.chunk_id, s.rank AS pos, o.lexical_score, true AS full_text_match
            FROM strict_top s JOIN scored_pairs o ON o.query_id = s.query_id AND o.chunk_id = s.chunk_id
            UNION ALL
            SELECT b.query_id, b.chunk_id, b.best, b.lexical_score, false FROM best_relaxed b
            WHERE NOT EXISTS (SELECT 1 FROM strict_top s WHERE s.query_id = b.query_id AND s.chunk_id = b.chunk_id)))
        WHERE text_rank <= 10""",
    "titled_slots": f"SELECT chunk_id, {duck.hashed_words(duck.trim('title') + ' || chr(10) || ' + duck.trim('content'))} AS slots FROM chunk_docs",
    "titled_vectors": duck.unit_vectors("titled_slots"),
    "query_slots": f"SELECT query_id, {duck.hashed_words('query')} AS slots FROM bench_queries",
    "query_vectors": duck.unit_vectors("query_slots", "query_id"),
    "vector_ranked": f"""
        SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INT AS rank FROM (
            SELECT q.query_id, v.chunk_id, {duck.cosine("q.embedding", "v.embedding")} AS similarity
            FROM query_vectors q JOIN seen s ON s.query_id = q.query_id
            JOIN chunk_docs c ON c.document_id = s.document_id
            JOIN titled_vectors v ON v.chunk_id = c.chunk_id)) WHERE rank <= 10""",
    "fused": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, text_rank)::INT AS rank FROM (
          SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
                 v.rank AS vector_rank, t.text_rank, v.similarity AS vector_similarity,
                 coalesce(t.lexical_score, 0) AS lexical_score, coalesce(t.full_text_match, false) AS full_text_match,
                 coalesce(1::DOUBLE / (60 + v.rank), 0) + coalesce(1::DOUBLE / (60 + t.text_rank), 0) AS score
          FROM vector_ranked v FULL JOIN text_ranked t ON t.query_id = v.query_id AND t.chunk_id = v.chunk_id)""",
    "text_results": "SELECT query_id, chunk_id, text_rank AS rank FROM text_ranked WHERE text_rank <= 4",
}

# -- scope ---------------------------------------------------------------------------------


@query("resolve_subject_scope", "SELECT query_id, array_to_string(scope, ',') AS scope FROM scopes", VIEWS)
def resolve_subject_scope(i: Inputs) -> DataFrame:
    scopes = scope.resolve_subject_scope(i.bench_queries, i.subject_requests, i.subjects)
    return scopes.select("query_id", F.array_join("scope", ",").alias("scope"))


@query(
    "visible_docs_default",
    """SELECT document_id, status FROM doc_catalog d
       WHERE EXISTS (SELECT 1 FROM doc_subjects t JOIN subjects s ON s.subject_id = t.subject_id
                     WHERE t.document_id = d.document_id AND s.active)
          OR NOT EXISTS (SELECT 1 FROM doc_subjects t WHERE t.document_id = d.document_id)""",
)
def visible_docs_default(i: Inputs) -> DataFrame:
    docs = i.doc_catalog.select("document_id", "status")
    return scope.visible_docs_default(docs, i.doc_subjects, i.subjects)


@query(
    "visible_docs_filtered",
    """SELECT DISTINCT q.query_id, t.document_id FROM scopes q JOIN doc_subjects t ON list_contains(q.scope, t.subject_id)
       JOIN subjects s ON s.subject_id = t.subject_id AND s.active WHERE q.scope IS NOT NULL""",
    VIEWS,
)
def visible_docs_filtered(i: Inputs) -> DataFrame:
    scopes = scope.resolve_subject_scope(i.bench_queries, i.subject_requests, i.subjects)
    return scope.visible_docs_filtered(scopes, i.doc_subjects, i.subjects)


# -- words ---------------------------------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {duck.normalize('text')} AS normalized FROM documents")
def normalize_text(i: Inputs) -> DataFrame:
    return i.documents.select("doc_id", tx.normalize(F.col("text")).alias("normalized"))


@query(
    "query_terms",
    f"""SELECT 'question' AS origin, query_id AS id, array_to_string({duck.query_terms("query")}, ' ') AS terms FROM bench_queries
        UNION ALL SELECT 'passage', item_id, array_to_string({duck.query_terms("text")}, ' ') FROM benchmark""",
)
def query_terms(i: Inputs) -> DataFrame:
    both = i.bench_queries.select(F.lit("question").alias("origin"), F.col("query_id").alias("id"), "query").unionByName(
        i.benchmark.select(F.lit("passage").alias("origin"), F.col("item_id").alias("id"), F.col("text").alias("query"))
    )
    terms = tx.query_terms(F.col("query"), STOP_WORDS)
    return both.select("origin", "id", F.array_join(terms, " ").alias("terms"))


@query(
    "analyze_tokens",
    f"""SELECT chunk_id, array_to_string({duck.analyze("title || ' ' || content")}, ' ') AS tokens FROM chunk_docs""",
)
def analyze_tokens(i: Inputs) -> DataFrame:
    analyzed = ft.analyze_tokens(i.chunk_docs, WORDS)
    return analyzed.select("chunk_id", F.array_join("tokens", " ").alias("tokens"))


# -- lexical ranking -----------------------------------------------------------------------

_RANKED = "SELECT query_id, chunk_id, rank_value, rank FROM {}"


@query("fulltext_strict", _RANKED.format("strict_top"), VIEWS)
def fulltext_strict(i: Inputs) -> DataFrame:
    return ft.fulltext_strict(matches(i, "strict"))


@query("fulltext_relaxed", _RANKED.format("relaxed_top"), VIEWS)
def fulltext_relaxed(i: Inputs) -> DataFrame:
    return ft.fulltext_relaxed(matches(i, "relaxed"))


@query(
    "cover_density_rank",
    """SELECT query_id, chunk_id, 'strict' AS mode, rank_value FROM strict_top
       UNION ALL SELECT query_id, chunk_id, 'relaxed', rank_value FROM relaxed_top""",
    VIEWS,
)
def cover_density_rank(i: Inputs) -> DataFrame:
    return matches(i).select("query_id", "chunk_id", "mode", "rank_value")


@query("term_overlap_score", "SELECT query_id, chunk_id, lexical_score FROM scored_pairs", VIEWS)
def term_overlap_score(i: Inputs) -> DataFrame:
    questions = scoped_questions(i)
    found = ft.match_index(stored.text_index(i), questions, WORDS, visibility(i))
    pairs = found.select("query_id", "chunk_id").distinct()
    return ft.score_pairs(pairs, i.chunk_docs, questions, WORDS)


@query(
    "lexical_scan",
    """SELECT * FROM (SELECT query_id, chunk_id, lexical_score,
                row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id)::INT AS rank
              FROM scanned WHERE lexical_score > 0) WHERE rank <= 10""",
    VIEWS
    | {
        "seen_pairs": "SELECT s.query_id, c.chunk_id FROM seen s JOIN chunk_docs c ON c.document_id = s.document_id",
        "scanned": overlap("seen_pairs"),
    },
)
def lexical_scan(i: Inputs) -> DataFrame:
    return ft.lexical_scan(i.chunk_docs, scoped_questions(i), WORDS, visibility(i))


@query(
    "lexical_candidates",
    "SELECT query_id, chunk_id, text_rank, lexical_score, full_text_match FROM text_ranked",
    VIEWS,
)
def lexical_candidates(i: Inputs) -> DataFrame:
    questions = scoped_questions(i)
    found = ft.match_index(stored.text_index(i), questions, WORDS, visibility(i))
    return ft.lexical_candidates(found, i.chunk_docs, questions, WORDS)


# -- vector ranking ------------------------------------------------------------------------


def vector_questions(i: Inputs) -> DataFrame:
    """Every vector asks for its neighbours; those that share an id with a question take its scope."""
    scopes = scope.resolve_subject_scope(i.bench_queries, i.subject_requests, i.subjects)
    asked = i.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return asked.join(scopes, "query_id", "left")


def visible_vectors(i: Inputs) -> DataFrame:
    return scope.with_visibility(
        i.vec_chunks.select("chunk_id", "document_id", "embedding"), visibility(i), "string"
    )


_NEAREST = f"""SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (
          SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INT AS rank
          FROM (SELECT e.vec_id AS query_id, c.chunk_id, {duck.cosine("e.embedding", "c.embedding")} AS similarity
                FROM embeddings e LEFT JOIN scopes s ON s.query_id = e.vec_id
                CROSS JOIN usable_vectors c LEFT JOIN doc_vis v ON v.document_id = c.document_id
                WHERE CASE WHEN s.scope IS NULL THEN coalesce(v.default_visible, true)
                           ELSE coalesce(list_has_any(v.subjects, s.scope), false) END)) WHERE rank <= 10"""
_VECTOR_VIEWS = VIEWS | {"usable_vectors": f"SELECT * FROM vec_chunks WHERE {duck.usable('embedding')}"}


@query("vector_topk", _NEAREST, _VECTOR_VIEWS)
def vector_topk(i: Inputs) -> DataFrame:
    return vs.vector_topk(visible_vectors(i), vector_questions(i), DIMENSIONS)


@query("vector_topk_approx")
def vector_topk_approx(i: Inputs) -> DataFrame:
    """Through the stored index, with the probes that its recall was measured with."""
    return vs.search_index(stored.vector_index(i), vector_questions(i), visibility(i))


@query("vector_topk_indexed", _NEAREST, _VECTOR_VIEWS)
def vector_topk_indexed(i: Inputs) -> DataFrame:
    """Through the stored index, all cells: the codes rule out, the vectors of what is left decide."""
    return vs.search_index(stored.vector_index(i), vector_questions(i), visibility(i), probes=0)


# -- fusion --------------------------------------------------------------------------------

_FUSED = """SELECT query_id, chunk_id, rank, score, vector_rank, text_rank, vector_similarity, lexical_score, full_text_match
            FROM fused"""
RESULT = [
    "query_id", "chunk_id", "rank", "score", "vector_rank", "text_rank", "vector_similarity",
    "lexical_score", "full_text_match",
]


@query("rrf_fuse", _FUSED, VIEWS)
def rrf_fuse(i: Inputs) -> DataFrame:
    questions = scoped_questions(i)
    found = ft.match_index(stored.text_index(i), questions, WORDS, visibility(i))
    text = ft.lexical_candidates(found, i.chunk_docs, questions, WORDS)
    seen = scope.with_visibility(stored.chunk_vectors(i), visibility(i), "string")
    vector = vs.vector_topk(seen, questions, DIMENSIONS)
    return search.rrf_fuse(vector, text).select(*RESULT)


@query("hybrid_search", _FUSED + " WHERE rank <= 4", VIEWS)
def hybrid_search(i: Inputs) -> DataFrame:
    return search.hybrid_search(
        scoped_questions(i), i.chunk_docs, WORDS, visibility(i), stored.chunk_vectors(i), DIMENSIONS,
        index=stored.text_index(i),
    ).select(*RESULT)


# -- quality -------------------------------------------------------------------------------


@query(
    "retrieval_eval",
    """SELECT count(*) AS questions, count(*) FILTER (in_corpus) AS answerable,
              count(*) FILTER (in_corpus AND first_hit = 1) AS hits_at_1,
              round(avg(CASE WHEN in_corpus THEN coalesce((first_hit = 1)::INT, 0) END), 6) AS hit_rate,
              round(avg(CASE WHEN in_corpus THEN hits::DOUBLE / expected END), 6) AS recall,
              round(avg(CASE WHEN in_corpus THEN hits::DOUBLE / 4 END), 6) AS precision,
              round(avg(CASE WHEN in_corpus THEN coalesce(1::DOUBLE / first_hit, 0) END), 6) AS mean_reciprocal_rank,
              count(*) FILTER (NOT in_corpus AND results = 0) AS refused
       FROM (SELECT q.query_id, count(DISTINCT g.chunk_id) AS expected, count(DISTINCT g.chunk_id) > 0 AS in_corpus,
                    count(DISTINCT r.chunk_id) FILTER (r.chunk_id = g.chunk_id) AS hits,
                    min(r.rank) FILTER (r.chunk_id = g.chunk_id) AS first_hit, count(r.chunk_id) AS results
             FROM bench_queries q LEFT JOIN golden g ON g.query_id = q.query_id
             LEFT JOIN text_results r ON r.query_id = q.query_id GROUP BY q.query_id)""",
    VIEWS
    | {
        "golden": """SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b
                     JOIN chunk_docs c ON contains(c.content, b.text)"""
    },
)
def retrieval_eval(i: Inputs) -> DataFrame:
    results = search.hybrid_search(
        scoped_questions(i), i.chunk_docs, WORDS, visibility(i), index=stored.text_index(i))
    texts = i.chunk_docs.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
    golden = evaluation.passages_in(i.benchmark, texts)
    return evaluation.summarize(evaluation.judge(i.bench_queries, results, golden), 4)
