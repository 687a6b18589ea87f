"""Named queries over a folder of tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.plans.views import Inputs, duck_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: dict[str, str] | None = None):
    """Register ``function(inputs) -> DataFrame``; ``views`` are helper views of the oracle."""

    def register(function: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = duck_views(oracle, views)
        return function

    return register
