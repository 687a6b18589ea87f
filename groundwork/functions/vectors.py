"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions.text import bind, fold_accents

VECTOR_OK = "OK"


def is_missing(vector: Column) -> Column:
    """Not embedded yet: no vector, or one of zero length."""
    return vector.isNull() | F.forall(vector, lambda x: x == F.lit(0.0))


def vector_problem(vector: Column, dimensions: int) -> Column:
    """First reason a vector cannot be stored, or ``OK``."""
    infinite = F.lit(float("inf"))
    return (
        F.when(vector.isNull() | (F.size(vector) != dimensions), "WRONG_DIMENSION")
        .when(F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == infinite)), "NOT_FINITE")
        .when(F.forall(vector, lambda x: x == F.lit(0.0)), "ZERO_MAGNITUDE")
        .otherwise(VECTOR_OK)
    )


def is_usable(vector: Column, dimensions: int) -> Column:
    """A vector that has a cosine: right length, finite, not zero."""
    return vector_problem(vector, dimensions) == VECTOR_OK


def hashed_words(text: Column, dimensions: int) -> Column:
    """Bag-of-words vector: each word of three letters or more counts in one hashed dimension.

    Computed inside the row, so that embedding a table moves nothing between executors.
    """
    counted = F.filter(
        F.split(fold_accents(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"),
        lambda w: F.length(w) >= 3,
    )
    slots = F.transform(
        counted,
        lambda w: F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)
        ).cast("int"),
    )

    # Every slot once more than it is hit, in order: where a slot ends tells how often it was hit.
    every = F.sequence(F.lit(0), F.lit(dimensions - 1))
    ordered = F.sort_array(F.concat(every, slots))

    def ends(bound: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(bound))
        return F.filter(places, lambda p: ~bound[p - 1].eqNullSafe(F.get(bound, p)))

    def counts(bound: Column) -> Column:
        return F.transform(bound, lambda end, d: (end - F.coalesce(F.get(bound, d - 1), F.lit(0)) - 1).cast("double"))

    return bind(bind(bind(ordered, ends), counts), _normalized)


def _normalized(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x)
    first = F.transform(counts, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0).cast("float"))
    scaled = bind(F.sqrt(total), lambda n: F.transform(counts, lambda x: (x / n).cast("float")))
    return F.when(total == 0, first).otherwise(scaled)
