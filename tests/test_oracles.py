"""Every registered query against its SQL, on the whole small tables."""

from __future__ import annotations

import compare
import pytest
from conftest import SMALL

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    columns, rows = compare.spark_rows(entry.queries()[name](spark, SMALL))
    expected_columns, expected = compare.duck_rows(duck, entry.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_answers_every_question(spark):
    answers = entry.entry(spark)
    assert answers.count() == spark.read.parquet(f"{SMALL}/benchmark.parquet").count()
