"""Conversations: rewriting, screening, transcripts, sessions, stored answer streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import lexicon as lex
from groundwork.functions.text import is_blank, trim
from groundwork.operators.ordered import last_before, number_rows
from groundwork.sources.tables import CITATION_SCHEMA

MAX_QUESTION_LENGTH = 2000
MAX_SUBJECTS = 1000
TURNS_PER_BUCKET = 1000


def _turn_bucket(width: int = TURNS_PER_BUCKET) -> Column:
    return F.floor(F.col("turn") / width)


def core_topic(message: Column, limit: int = 60) -> Column:
    return F.substring(trim(F.regexp_replace(message, "[?!.,;:]", "")), 1, limit)


def rewrite_followups(
    messages: DataFrame, opening: str = lex.PORTUGUESE_FOLLOW_UP, bucket_width: int = TURNS_PER_BUCKET
) -> DataFrame:
    """User messages of ``conv_id, turn, role, text`` with the ``effective_query`` to search for.

    A question that leans on the one before it gets that one's topic in front.
    """
    is_user = F.upper("role") == "USER"
    asked = F.when(is_user & ~is_blank(F.col("text")), F.col("text"))
    known = last_before(messages, ["conv_id"], ["turn"], _turn_bucket(bucket_width), asked, "_before")
    question = trim(F.col("text"))
    leans = question.rlike(opening) & F.col("_before").isNotNull()
    effective = (
        F.when(is_blank(F.col("text")), "")
        .when(leans, F.concat(core_topic(F.col("_before")), F.lit(" — "), question))
        .otherwise(question)
    )
    return known.where(is_user).select("conv_id", "turn", effective.alias("effective_query"))


def screen_questions(
    questions: DataFrame,
    max_length: int = MAX_QUESTION_LENGTH,
    injection: str = lex.INJECTION_ATTEMPT,
    max_subjects: int = MAX_SUBJECTS,
) -> DataFrame:
    """Questions with the first reason to refuse them, or ``accepted``."""
    question = F.col("query")
    verdict = (
        F.when(F.length(question) > max_length, "too_long")
        .when(question.rlike(lex.CONTROL_CHARACTERS), "control_characters")
        .when(question.rlike(injection), "injection_pattern")
        .when(trim(question) == "", "question_blank")
    )
    if "subject_ids" in questions.columns:
        many = F.size(F.array_distinct("subject_ids")) > max_subjects
        verdict = verdict.when(many, "too_many_subjects")
    return questions.withColumn("verdict", verdict.otherwise("accepted"))


def thread_messages(messages: DataFrame, bucket_width: int = TURNS_PER_BUCKET) -> DataFrame:
    """Messages with their position in the conversation, from 1.

    Rows and not one array per conversation: a conversation may be of any length.
    """
    return number_rows(
        messages, ["conv_id"], [F.col("turn")], _turn_bucket(bucket_width), "position"
    )


def sessions_by_user(sessions: DataFrame, bucket_width: int = 86_400) -> DataFrame:
    """Sessions with their place among the user's, newest first; the first one is active."""
    newest = [F.desc("updated_at"), F.col("session_id")]
    bucket = -F.floor(F.col("updated_at") / bucket_width)
    placed = number_rows(sessions, ["user_id"], newest, bucket, "position")
    return placed.withColumn("is_active", F.col("position") == 1)


def owned_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests for a session by its owner. Somebody else's session is as good as missing."""
    own = sessions.select("session_id", "user_id")
    return requests.join(own, ["session_id", "user_id"], "left_semi")


def missing_sessions(
    users: DataFrame, sessions: DataFrame, title: str = lex.DEFAULT_SESSION_TITLE
) -> DataFrame:
    """A first session for each user who has none."""
    without = users.select("user_id").join(sessions.select("user_id"), "user_id", "left_anti")
    return without.withColumn("title", F.lit(title))


def append_transcript(
    messages: DataFrame, sessions: DataFrame, exchanges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Messages and sessions after some exchanges.

    ``exchanges(session_id, asked_at, question, answered_at, answer, citations, model_used)``;
    without an answer only the question is stored and the session keeps its time.
    """
    nothing = F.lit(None)
    asked = exchanges.select(
        "session_id", F.col("asked_at").alias("at"), F.lit("USER").alias("role"),
        F.col("question").alias("text"), nothing.cast("string").alias("citations"),
        nothing.cast("string").alias("model_used"), nothing.cast("long").alias("duration"),
    )
    answered = exchanges.where(F.col("answer").isNotNull())
    answers = answered.select(
        "session_id", F.col("answered_at").alias("at"), F.lit("ASSISTANT").alias("role"),
        F.col("answer").alias("text"), "citations", "model_used",
        (F.col("answered_at") - F.col("asked_at")).alias("duration"),
    )
    latest = answered.groupBy("session_id").agg(F.max("answered_at").alias("_answered"))
    touched = sessions.join(latest, "session_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_answered")
    )
    stored = messages.unionByName(asked).unionByName(answers)
    return stored, touched.drop("_answered")


def delete_sessions(
    sessions: DataFrame, messages: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages that stay."""
    gone = doomed.select("session_id")
    return (
        sessions.join(gone, "session_id", "left_anti"),
        messages.join(gone, "session_id", "left_anti"),
    )


def citations_by_message(messages: DataFrame) -> DataFrame:
    """``message_id, citations`` of messages that cite something. Unreadable JSON cites nothing."""
    schema = f"array<{CITATION_SCHEMA.simpleString()}>"
    parsed = messages.select("message_id", F.from_json("citations", schema).alias("citations"))
    return parsed.where(F.size("citations") > 0)


def _text_deltas(provider: Column, data: Column) -> Column:
    """Pieces of answer text in one line of a provider's stream."""
    gemini = F.from_json(
        data, "candidates array<struct<content struct<parts array<struct<text string>>>>>"
    )
    parts = F.transform(
        F.try_element_at(gemini["candidates"], F.lit(1))["content"]["parts"], lambda p: p["text"]
    )
    openai = F.array(F.get_json_object(data, "$.choices[0].delta.content"))
    claude = F.array(
        F.when(
            F.get_json_object(data, "$.type") == "content_block_delta",
            F.get_json_object(data, "$.delta.text"),
        )
    )
    found = F.when(provider == "GEMINI", parts).when(provider == "CLAUDE", claude).otherwise(openai)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: t != "")


def assemble_stream_answers(lines: DataFrame, bucket_width: int = 1000) -> DataFrame:
    """Answers out of stored stream lines ``stream_id, seq, provider, line``.

    Concatenated in two steps, so that no task gathers the lines of a stream one by one.
    ``has_text`` is false for a stream that never said anything.
    """
    data = trim(F.expr("substring(line, 7)"))
    is_data = F.startswith("line", F.lit("data: ")) & (data != "") & (data != "[DONE]")
    text = F.when(is_data, F.array_join(_text_deltas(F.col("provider"), data), "")).otherwise("")
    pieces = lines.select(
        "stream_id", "seq", F.floor(F.col("seq") / bucket_width).alias("part"), text.alias("text")
    )

    def joined(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
        in_order = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(order, "text"))))
        whole = F.array_join(F.transform(in_order, lambda p: p["text"]), "")
        return frame.groupBy(*keys).agg(whole.alias("text"))

    answers = joined(joined(pieces, ["stream_id", "part"], "seq"), ["stream_id"], "part")
    return answers.select("stream_id", F.col("text").alias("answer"), (F.col("text") != "").alias("has_text"))
