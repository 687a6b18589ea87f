"""Constraints a file table cannot enforce, as queries that return what violates them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(rows: DataFrame, keys: Sequence[str], nulls_allowed: bool = False) -> DataFrame:
    """Keys that occur more than once, with their count."""
    if nulls_allowed:
        rows = rows.dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def orphan_rows(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that point at a parent that does not exist."""
    known = parent.select(F.col(key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(known, foreign_key, "left_anti")


def domain_violations(
    rows: DataFrame,
    key: str,
    required: Sequence[str] = (),
    enums: Mapping[str, Sequence[str]] | None = None,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per broken rule: ``key, column_name, rule``. All rules are checked in one pass."""

    def broken(column: str, rule: str, condition):
        return F.when(condition, F.struct(F.lit(column).alias("column_name"), F.lit(rule).alias("rule")))

    checks = [broken(c, "REQUIRED", F.col(c).isNull()) for c in required]
    checks += [broken(c, "NOT_IN_DOMAIN", ~F.col(c).isin(*v)) for c, v in (enums or {}).items()]
    checks += [broken(c, "TOO_LONG", F.length(c) > n) for c, n in (limits or {}).items()]
    found = F.explode(F.array_compact(F.array(*checks)))
    return rows.select(key, found.alias("v")).select(key, "v.column_name", "v.rule")
