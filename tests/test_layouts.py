"""Inputs in other forms: tables that are folders of part files, letters beyond ASCII."""

from __future__ import annotations

import os

import compare
import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundwork.functions import text as tx


@pytest.fixture(scope="module")
def foldered(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("foldered"))
    for name in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{name}").repartition(3).write.parquet(f"{folder}/{name}")
    return folder


@pytest.mark.parametrize("name", ["incremental_ingest", "pending_work"])
def test_streams_read_tables_of_several_files(spark, foldered, name):
    columns, rows = compare.spark_rows(entry.queries()[name](spark, foldered))
    expected_columns, expected = compare.duck_rows(compare.connect(SMALL), entry.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected


@pytest.fixture(scope="module")
def accented(spark, tmp_path_factory):
    """Words that go on with a letter beyond ASCII, where a word of the patterns ends or begins."""
    folder = str(tmp_path_factory.mktemp("accented"))
    turns = ["Old topic.", "Laññasra is what?", "Leçon", "la one", "lañ", "lab"]
    spark.createDataFrame(
        [(1, n, "user", text) for n, text in enumerate(turns)], "conv_id long, turn long, role string, text string"
    ).write.parquet(f"{folder}/conversations.parquet")
    texts = ["éthe and", "the andé", "xthe and", "the and_", "the\nand"]
    spark.createDataFrame(
        [(n, text, "en", "src1", len(text)) for n, text in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name, table", [("rewrite_followups", "conversations"), ("screen_questions", "documents")])
def test_words_end_before_letters_beyond_ascii(spark, accented, name, table):
    columns, rows = compare.spark_rows(entry.queries()[name](spark, accented))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{accented}/{table}.parquet/*.parquet'")
    expected_columns, expected = compare.duck_rows(con, entry.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected


def test_prompt_tags_end_before_letters_beyond_ascii(spark):
    shown = spark.createDataFrame([("<sourceé>",), ("<sources>",), ("<source>",)], "t string").select(tx.escape_prompt_tags(F.col("t")))
    assert [r[0] for r in shown.collect()] == ["&lt;sourceé>", "<sources>", "&lt;source>"]
