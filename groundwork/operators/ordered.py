"""Order-dependent work on keys of any size.

A window over one key runs in one task. Here the order is cut into buckets first: a window runs
inside each (key, bucket), one summary row per bucket is carried on by a window over the
summaries, and the two are joined. A key that holds a third of all rows is thereby spread over
its buckets. ``bucket`` must never decrease along the order (an hour, ``id // 100000``, ...). Keys must
not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.session import settle

_BUCKET = "_bucket"


def _with_carry(
    rows: DataFrame,
    keys: Sequence[str],
    summary: Column,
    over_buckets: Callable[[Column, Window], Column],
) -> DataFrame:
    """Join to each row the ``_carry`` of the buckets before its own."""
    per_bucket = rows.groupBy(*keys, _BUCKET).agg(summary.alias("_summary"))
    before = (
        Window.partitionBy(*keys)
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_bucket.select(
        *keys, _BUCKET, over_buckets(F.col("_summary"), before).alias("_carry")
    )
    return rows.join(carried, [*keys, _BUCKET], "left")


def number_rows(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str
) -> DataFrame:
    """``row_number`` per key (per table when there are no keys)."""
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    numbered = rows.withColumn(_BUCKET, bucket).withColumn("_local", F.row_number().over(inside))
    carried = _with_carry(
        numbered, keys, F.count(F.lit(1)), lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    )
    return carried.withColumn(name, (F.col("_carry") + F.col("_local")).cast("long")).drop(
        "_local", "_carry", _BUCKET
    )


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Sum of ``value`` per key up to and including each row."""
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = (
        rows.withColumn(_BUCKET, bucket)
        .withColumn("_value", value)
        .withColumn("_local", F.sum("_value").over(inside))
    )
    carried = _with_carry(
        summed, keys, F.sum("_value"), lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    )
    return carried.withColumn(name, F.col("_carry") + F.col("_local")).drop(
        "_local", "_carry", "_value", _BUCKET
    )


def running_min(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Least ``value`` per key up to and including each row."""
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    lowest = (
        rows.withColumn(_BUCKET, bucket)
        .withColumn("_value", value)
        .withColumn("_local", F.min("_value").over(inside))
    )
    carried = _with_carry(lowest, keys, F.min("_value"), lambda c, w: F.min(c).over(w))
    return carried.withColumn(name, F.least("_local", "_carry")).drop(
        "_local", "_carry", "_value", _BUCKET
    )


def last_before(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Latest ``value`` that is not null, per key, strictly before each row."""
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = (
        rows.withColumn(_BUCKET, bucket)
        .withColumn("_value", value)
        .withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    )
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    carried = _with_carry(
        seen,
        keys,
        F.max_by("_value", position),
        lambda c, w: F.last(c, ignorenulls=True).over(w),
    )
    return carried.withColumn(name, F.coalesce("_local", "_carry")).drop(
        "_local", "_carry", "_value", _BUCKET
    )


def split_at_gaps(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    time: str,
    gap: int,
    name: str,
) -> DataFrame:
    """Split a key where its rows lie at least ``gap`` apart.

    Each part is named by its first time; ``_gap`` is the distance to the row before inside the
    part. Both steps are written down: each is read twice by what follows.
    """
    previous = last_before(rows, keys, order, bucket, F.col(time), "_previous")
    distance = F.col(time) - F.col("_previous")
    opens = F.col("_previous").isNull() | (distance >= gap)
    flagged = previous.select(
        *rows.columns,
        F.when(opens, F.col(time)).alias("_opens"),
        F.when(~opens, distance).alias("_gap"),
    )
    flagged = settle(flagged, "gaps")
    filled = last_before(flagged, keys, order, bucket, F.col("_opens"), "_running")
    parts = filled.withColumn(name, F.coalesce("_opens", "_running")).drop("_opens", "_running")
    return settle(parts, "parts")
