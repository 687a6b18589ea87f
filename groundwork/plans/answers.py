"""Queries: evidence, answers, citations, conversations, answer streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.operators import chat, grounding, limits, search
from groundwork.plans import duck, stored
from groundwork.plans.registry import query
from groundwork.plans.retrieval import DIMENSIONS, VIEWS, WORDS, scoped_questions, visibility
from groundwork.plans.views import Inputs
from groundwork.session import settle

# -- evidence and answers ------------------------------------------------------------------

_EVIDENCE = "coalesce(CASE WHEN NOT isnan(similarity) THEN similarity >= 0.65 END, false) OR full_text_match OR lexical_score >= 4.0"
_ANSWER = f"""{duck.trim("content")} || chr(10) || chr(10) || '— Fonte Oficial: ' || document_title
    || CASE WHEN {duck.blank("chunk_title")} THEN '' ELSE ' (' || chunk_title || ')' END"""
_READABLE = "CASE WHEN json_valid(metadata) THEN metadata END"
_CITATION = f"""json_object('documentTitle', document_title, 'chunkTitle', chunk_title,
    'pageNumber', json_extract({_READABLE}, '$.page'), 'questionNumber', json_extract({_READABLE}, '$.questionNumber'),
    'articleNumber', json_extract_string({_READABLE}, '$.articleNumber'), 'legalBasis', json_extract_string({_READABLE}, '$.legalBasis'))"""

RESULT_VIEWS = {
    "verdicts": f"""SELECT q.query_id, coalesce(bool_or({_EVIDENCE}), false) AS grounded
                    FROM result_queries q LEFT JOIN search_results r ON r.query_id = q.query_id GROUP BY q.query_id""",
    "first_answers": f"SELECT query_id, {_ANSWER} AS answer FROM search_results WHERE rank = 1",
}


@query("is_grounded", "SELECT query_id, grounded FROM verdicts", RESULT_VIEWS)
def is_grounded(i: Inputs) -> DataFrame:
    return grounding.is_grounded(i.result_queries, i.search_results)


@query(
    "best_similarity",
    """SELECT q.query_id, max(CASE WHEN NOT isnan(similarity) THEN similarity END) AS best_similarity
       FROM result_queries q LEFT JOIN search_results r ON r.query_id = q.query_id GROUP BY q.query_id""",
)
def best_similarity(i: Inputs) -> DataFrame:
    return grounding.best_similarity(i.result_queries, i.search_results)


@query(
    "answer_or_refuse",
    f"""SELECT v.query_id, v.grounded, CASE WHEN v.grounded THEN a.answer ELSE '{lex.REFUSAL_MESSAGE}' END AS answer,
               CASE WHEN v.grounded THEN 'extractive' ELSE '{lex.REFUSAL_MODEL}' END AS model_used,
               CASE WHEN v.grounded THEN (SELECT count(*) FROM search_results r WHERE r.query_id = v.query_id) END AS cited
        FROM verdicts v LEFT JOIN first_answers a ON a.query_id = v.query_id""",
    RESULT_VIEWS,
)
def answer_or_refuse(i: Inputs) -> DataFrame:
    answers = grounding.answer_or_refuse(i.result_queries, i.search_results)
    cited = F.when(F.col("citations").isNotNull(), F.size("citations")).cast("long")
    return answers.select("query_id", "grounded", "answer", "model_used", cited.alias("cited"))


_PARTS = ["documentTitle", "chunkTitle", "pageNumber", "questionNumber", "articleNumber", "legalBasis"]


@query(
    "extract_citations",
    f"""SELECT query_id, rank AS place, document_title AS documentTitle, chunk_title AS chunkTitle,
               json_extract({_READABLE}, '$.page')::INT AS pageNumber, json_extract({_READABLE}, '$.questionNumber')::INT AS questionNumber,
               json_extract_string({_READABLE}, '$.articleNumber') AS articleNumber, json_extract_string({_READABLE}, '$.legalBasis') AS legalBasis
        FROM search_results""",
)
def extract_citations(i: Inputs) -> DataFrame:
    listed = grounding.extract_citations(i.search_results)
    each = listed.select("query_id", F.posexplode("citations").alias("p", "c"))
    return each.select("query_id", (F.col("p") + 1).alias("place"), *[f"c.{part}" for part in _PARTS])


_TAG = r"<(\s*/?\s*(?:official_context|source|title|excerpt|user_question)\b)"


def _escaped(x: str) -> str:
    return f"regexp_replace({x}, '{_TAG}', '&lt;\\1', 'gi')"


_BLOCK = f"""'<source index="' || rank || '">' || chr(10) || '<title>' || {_escaped("document_title")}
    || CASE WHEN {duck.blank("chunk_title")} THEN '' ELSE ' | ' || {_escaped("chunk_title")} END || '</title>' || chr(10)
    || '<excerpt>' || chr(10) || {_escaped(duck.trim("content"))} || chr(10) || '</excerpt>' || chr(10) || '</source>' || chr(10)"""


@query(
    "build_context",
    f"""SELECT q.query_id, '<official_context>' || chr(10) || coalesce(s.blocks, '') || '</official_context>' || chr(10) || chr(10)
               || '<user_question>' || chr(10) || {_escaped(duck.trim("q.query"))} || chr(10) || '</user_question>' AS prompt
        FROM result_queries q LEFT JOIN (SELECT query_id, string_agg({_BLOCK}, '' ORDER BY rank) AS blocks
                                         FROM search_results GROUP BY query_id) s ON s.query_id = q.query_id""",
)
def build_context(i: Inputs) -> DataFrame:
    return grounding.build_context(i.result_queries, i.search_results)


@query("extractive_answer", "SELECT query_id, answer FROM first_answers", RESULT_VIEWS)
def extractive_answer(i: Inputs) -> DataFrame:
    return grounding.extractive_answer(i.search_results)


@query(
    "ask_questions",
    f"""SELECT q.query_id, coalesce(g.grounded, false) AS grounded,
               CASE WHEN g.grounded THEN g.answer ELSE '{lex.REFUSAL_MESSAGE}' END AS answer,
               CASE WHEN g.grounded THEN 'extractive' ELSE '{lex.REFUSAL_MODEL}' END AS model_used,
               CASE WHEN g.grounded THEN g.results END AS cited
        FROM bench_queries q LEFT JOIN (
          SELECT f.query_id, bool_or(coalesce(f.vector_similarity >= 0.65, false) OR f.full_text_match OR f.lexical_score >= 4.0) AS grounded,
                 count(*) AS results,
                 max(CASE WHEN f.rank = 1 THEN {duck.trim("c.content")} || chr(10) || chr(10) || '— Fonte Oficial: ' || c.title || ' (Seção 1)' END) AS answer
          FROM fused f JOIN chunk_docs c ON c.chunk_id = f.chunk_id WHERE f.rank <= 4 GROUP BY f.query_id) g ON g.query_id = q.query_id""",
    VIEWS,
)
def ask_questions(i: Inputs) -> DataFrame:
    """The whole read path: search, evidence, answer or refusal."""
    questions = scoped_questions(i)
    # Four rows per question: written down, since three steps read them.
    found = settle(
        search.hybrid_search(
            questions, i.chunk_docs, WORDS, visibility(i), stored.chunk_vectors(i), DIMENSIONS, index=stored.text_index(i)),
        "results",
    )
    named = search.with_sources(found, i.chunk_docs).select(
        "query_id", "rank", F.col("title").alias("document_title"), F.lit("Seção 1").alias("chunk_title"),
        "content", F.lit('{"page":1}').alias("metadata"), F.col("vector_similarity").alias("similarity"),
        "lexical_score", "full_text_match",
    )
    answers = grounding.answer_or_refuse(questions, named)
    cited = F.when(F.col("citations").isNotNull(), F.size("citations")).cast("long")
    return answers.select("query_id", "grounded", "answer", "model_used", cited.alias("cited"))


# -- conversations -------------------------------------------------------------------------

# Openings in the languages of the fixtures; what stands first in many of their sentences.
_OPENS = "^(?:and|what|et|y|und|the|le|la|el|de|que|der|die)"
_OPENING = _OPENS + r"\b"


@query(
    "rewrite_followups",
    f"""SELECT conv_id, turn, CASE WHEN {duck.blank("text")} THEN ''
               WHEN regexp_matches({duck.trim("text")}, '(?i){_OPENING}') AND before IS NOT NULL
               THEN left({duck.trim("regexp_replace(before, '[?!.,;:]', '', 'g')")}, 60) || ' — ' || {duck.trim("text")}
               ELSE {duck.trim("text")} END AS effective_query
        FROM (SELECT *, last_value(CASE WHEN role = 'user' AND NOT {duck.blank("text")} THEN text END IGNORE NULLS) OVER (
                PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)
        WHERE role = 'user'""",
)
def rewrite_followups(i: Inputs) -> DataFrame:
    return chat.rewrite_followups(i.conversations, f"(?i){_OPENS}{lex.WORD_END}", bucket_width=3)


@query(
    "screen_questions",
    r"""SELECT doc_id AS query_id, CASE WHEN length(text) > 2000 THEN 'too_long'
               WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control_characters'
               WHEN regexp_matches(text, '(?i)\bthe\s+and\b|<script[\s>]') THEN 'injection_pattern'
               WHEN regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') = '' THEN 'question_blank'
               ELSE 'accepted' END AS verdict FROM documents""",
)
def screen_questions(i: Inputs) -> DataFrame:
    questions = i.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    screened = chat.screen_questions(questions, injection=rf"(?i){lex.WORD_START}the\s+and{lex.WORD_END}|<script[\s>]")
    return screened.select("query_id", "verdict")


@query(
    "thread_messages",
    "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations",
)
def thread_messages(i: Inputs) -> DataFrame:
    return chat.thread_messages(i.conversations, bucket_width=3)


@query(
    "sessions_by_user",
    """SELECT session_id, user_id, updated_at, row_number() OVER w AS position, row_number() OVER w = 1 AS is_active
       FROM sessions WINDOW w AS (PARTITION BY user_id ORDER BY updated_at DESC, session_id)""",
)
def sessions_by_user(i: Inputs) -> DataFrame:
    return chat.sessions_by_user(i.sessions, bucket_width=60)


@query(
    "owned_sessions",
    """SELECT r.session_id, r.user_id FROM (SELECT conv_id AS session_id, (conv_id + turn) % 30 AS user_id FROM conversations) r
       WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = r.session_id AND s.user_id = r.user_id)""",
)
def owned_sessions(i: Inputs) -> DataFrame:
    asked = i.conversations.select(
        F.col("conv_id").alias("session_id"), ((F.col("conv_id") + F.col("turn")) % 30).alias("user_id")
    )
    return chat.owned_sessions(asked, i.sessions)


@query(
    "missing_sessions",
    """SELECT user_id, 'Nova Consulta' AS title FROM users
       WHERE user_id NOT IN (SELECT user_id FROM sessions)""",
)
def missing_sessions(i: Inputs) -> DataFrame:
    return chat.missing_sessions(i.users, i.sessions)


# Each user turn with the assistant turn right after it is one exchange.
_EXCHANGES = """
    SELECT u.conv_id AS session_id, 1000 + u.turn * 100 AS asked_at, u.text AS question,
           CASE WHEN a.turn IS NOT NULL THEN 1050 + u.turn * 100 END AS answered_at, a.text AS answer
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'"""


def _exchanges(i: Inputs) -> DataFrame:
    users = i.conversations.where("role = 'user'")
    replies = i.conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    asked_at = 1000 + F.col("turn") * 100
    return users.join(replies, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("session_id"), asked_at.alias("asked_at"), F.col("text").alias("question"),
        F.when(F.col("answer").isNotNull(), asked_at + 50).alias("answered_at"), "answer",
        F.lit("[]").alias("citations"), F.lit("extractive").alias("model_used"),
    )


@query(
    "append_transcript",
    """SELECT s.session_id, greatest(s.updated_at, max(e.answered_at)) AS updated_at,
              count(e.session_id) + count(e.answer) AS messages, coalesce(sum(e.answered_at - e.asked_at), 0)::BIGINT AS duration
       FROM sessions s LEFT JOIN exchanges e ON e.session_id = s.session_id GROUP BY s.session_id, s.updated_at""",
    {"exchanges": _EXCHANGES},
)
def append_transcript(i: Inputs) -> DataFrame:
    empty = i.spark.createDataFrame(
        [], "session_id long, at long, role string, text string, citations string, model_used string, duration long"
    )
    messages, sessions = chat.append_transcript(empty, i.sessions, _exchanges(i))
    counted = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("duration").alias("duration")
    )
    return sessions.join(counted, "session_id", "left").select(
        "session_id", "updated_at", F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("duration", F.lit(0)).alias("duration"),
    )


@query(
    "delete_sessions",
    """SELECT 'session' AS kind, session_id AS id FROM sessions WHERE session_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
       UNION ALL SELECT 'message', message_id FROM messages WHERE session_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def delete_sessions(i: Inputs) -> DataFrame:
    doomed = i.labels.where("toxic = 1").select(F.col("doc_id").alias("session_id"))
    sessions, messages = chat.delete_sessions(i.sessions, i.messages, doomed)
    kept = sessions.select(F.lit("session").alias("kind"), F.col("session_id").alias("id"))
    return kept.unionByName(messages.select(F.lit("message").alias("kind"), F.col("message_id").alias("id")))


@query(
    "citations_by_message",
    """SELECT message_id, ord::INT AS place, json_extract_string(item, '$.documentTitle') AS "documentTitle",
              json_extract_string(item, '$.chunkTitle') AS "chunkTitle", json_extract(item, '$.pageNumber')::INT AS "pageNumber",
              json_extract_string(item, '$.articleNumber') AS "articleNumber"
       FROM (SELECT message_id, citations FROM messages WHERE citations IS NOT NULL AND json_valid(citations)) m,
            unnest(from_json(m.citations, '["JSON"]')) WITH ORDINALITY AS t(item, ord)""",
)
def citations_by_message(i: Inputs) -> DataFrame:
    each = chat.citations_by_message(i.messages).select("message_id", F.posexplode("citations").alias("p", "c"))
    return each.select(
        "message_id", (F.col("p") + 1).alias("place"), "c.documentTitle", "c.chunkTitle", "c.pageNumber", "c.articleNumber"
    )


# -- answer streams ------------------------------------------------------------------------

STREAM_VIEWS = {
    "deltas": f"""
        SELECT stream_id, seq, CASE WHEN NOT json_valid(data) THEN NULL
                 WHEN provider = 'GEMINI' THEN json_extract_string(data, '$.candidates[0].content.parts[0].text')
                 WHEN provider = 'OPENAI' THEN json_extract_string(data, '$.choices[0].delta.content')
                 WHEN json_extract_string(data, '$.type') = 'content_block_delta' THEN json_extract_string(data, '$.delta.text') END AS delta
        FROM (SELECT *, CASE WHEN starts_with(line, 'data: ') THEN {duck.trim("substr(line, 7)")} ELSE '' END AS data FROM stream_lines)""",
    "answers": """SELECT stream_id, coalesce(string_agg(delta, '' ORDER BY seq), '') AS answer,
                         coalesce(string_agg(delta, '' ORDER BY seq), '') <> '' AS has_text FROM deltas GROUP BY stream_id""",
}


@query("assemble_stream_answers", "SELECT stream_id, answer, has_text FROM answers", STREAM_VIEWS)
def assemble_stream_answers(i: Inputs) -> DataFrame:
    return chat.assemble_stream_answers(i.stream_lines, bucket_width=50)


@query(
    "complete_answers",
    """SELECT stream_id, answer FROM answers WHERE stream_id IN (
         SELECT stream_id FROM stream_lines GROUP BY stream_id
         HAVING arg_max(line, seq) IN (': end', 'data: [DONE]', 'data: {"type":"message_stop"}'))""",
    STREAM_VIEWS,
)
def complete_answers(i: Inputs) -> DataFrame:
    answers = chat.assemble_stream_answers(i.stream_lines)
    return limits.complete_answers(i.stream_lines, answers).select("stream_id", "answer")
