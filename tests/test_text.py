from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from groundwork.functions import text as tx
from groundwork.functions import vectors as vx
from groundwork.functions.lexicon import PORTUGUESE_STOP_WORDS
from groundwork.operators.embedding import _embed_batch, embed_chunks, hashing_model


def evaluate(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("raw, expected", [
    ("dir/sub\\file.pdf", "file.pdf"),
    ("a​b\t c.pdf", "a b c.pdf"),
    ("folder/", "document.pdf"),
    ("..", "document.pdf"),
    (None, "document.pdf"),
    ("x" * 250, "x" * 200),
])
def test_file_name(spark, raw, expected):
    assert evaluate(spark, tx.file_name(F.coalesce("raw", F.lit(""))), raw=raw) == expected


def test_title_falls_back_to_file_name(spark):
    title = tx.document_title(F.col("t"), F.col("f"))
    assert evaluate(spark, title, t=" \n ", f="scan.pdf") == "scan.pdf"
    assert evaluate(spark, title, t=None, f=None) == "document.pdf"


def test_truncate_title_strips_before_the_ellipsis(spark):
    assert evaluate(spark, tx.truncate_title(F.col("t"), 10), t="abcdefgh  ijk") == "abcdefgh…"
    assert evaluate(spark, tx.truncate_title(F.col("t"), 10), t="abcdefghij") == "abcdefghij"


def test_trim_cuts_control_characters_only_at_the_ends(spark):
    assert evaluate(spark, tx.trim(F.col("t")), t="\x00\n a\tb \r\x1f") == "a\tb"


@pytest.mark.parametrize("text", ["Ação, ÉPOCA ß œ 2026?", "étè ⃐x", "naïve—Ångström", "", "ĄČŽ ỹ"])
def test_normalize_is_decompose_and_drop_marks(spark, text):
    decomposed = unicodedata.normalize("NFD", text.lower())
    bare = "".join(c for c in decomposed if unicodedata.category(c)[0] != "M")
    assert evaluate(spark, tx.normalize(F.col("t")), t=text) == re.sub(r"[^a-z0-9\s]", " ", bare)


def test_query_terms(spark):
    terms = tx.query_terms(F.col("q"), PORTUGUESE_STOP_WORDS)
    assert evaluate(spark, terms, q="Quem PODE deduzir a saúde, e deduzir até 2026?") == ["deduzir", "saúde", "2026"]
    many = " ".join(f"w{n}" for n in range(30))
    assert evaluate(spark, terms, q=many) == [f"w{n}" for n in range(16)]


@pytest.mark.parametrize("word, stem", [("declaracao", "declar"), ("imposto", "impost"), ("abcdef", "abcde"), ("renda", "rend"), ("irpf", "irpf")])
def test_stem(spark, word, stem):
    assert evaluate(spark, tx.stem(F.col("w")), w=word) == stem


@pytest.mark.parametrize("message, delay", [
    ("Please retry in 41.2075s.", 41208),
    ('{"retryDelay": "12s"}', 12000),
    ("retry in 99999s", 3_600_000),
    ("quota exceeded", None),
    (None, None),
])
def test_retry_delay(spark, message, delay):
    assert evaluate(spark, tx.retry_delay_ms(F.col("m")), m=message) == delay


def test_embedding_text(spark):
    text = tx.embedding_text(F.col("t"), F.col("c"))
    assert evaluate(spark, text, t=" Title ", c=" body\n") == "Title\nbody"
    assert evaluate(spark, text, t=" ", c=" body\n") == "body"


def test_split_words_joins_back(spark):
    text = "  one two\n three "
    pieces = evaluate(spark, tx.split_words(F.col("t")), t=text)
    assert "".join(pieces) == text and pieces[0] == " "


def test_hashed_words_equals_the_plain_model(spark):
    texts = ["Ação de graças, ação", "", "no no", "many words make many slots"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(vx.hashed_words(F.col("t"), 16).alias("v")).collect()
    for row, vector in zip(rows, hashing_model(16)(texts)):
        assert row["v"] == pytest.approx(vector.tolist(), abs=1e-6)


def test_vector_problems(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(None, "WRONG_DIMENSION"), ([1.0], "WRONG_DIMENSION"), ([nan, 0.0], "NOT_FINITE"),
             ([inf, 1.0], "NOT_FINITE"), ([0.0, 0.0], "ZERO_MAGNITUDE"), ([0.0, 1.0], "OK")]
    frame = spark.createDataFrame([(v,) for v, _ in cases], "v array<float>")
    assert [r[0] for r in frame.select(vx.vector_problem(F.col("v"), 2)).collect()] == [p for _, p in cases]


def test_a_failed_batch_does_not_stop_the_others(spark):
    def model(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("provider down")
        return [[1.0, 0.0]] * len(texts)

    rows = [(1, "a", "x"), (2, "b", "boom"), (3, None, " "), (4, "c", "y")]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, content string").coalesce(1)
    out = {r["chunk_id"]: r for r in embed_chunks(chunks, model, dimensions=2, batch_size=1).collect()}
    assert out[1]["embedding"] == [1.0, 0.0] and out[4]["problem"] is None
    assert out[2]["embedding"] is None and "provider down" in out[2]["problem"]
    assert out[3]["problem"] == "BLANK"


def test_batch_needs_one_good_vector_per_text():
    assert _embed_batch(lambda t: [[1.0, 0.0]], ["a", "b"], 2) == [(None, "WRONG_COUNT")] * 2
    assert _embed_batch(lambda t: [[1.0, 0.0], [0.0, 0.0]], ["a", "b"], 2) == [(None, "ZERO_MAGNITUDE")] * 2
