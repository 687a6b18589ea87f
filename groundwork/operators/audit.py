"""What the logs of an embedding job say: quota use, waits, aborted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as tx
from groundwork.operators.ordered import last_before, number_rows, running_sum
from groundwork.session import settle


def estimate_batch_tokens(batches: DataFrame) -> DataFrame:
    """Texts and estimated tokens of each batch of ``batches(batch_id, text)``."""
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(tx.estimate_tokens(F.col("text"))).alias("tokens")
    )


def quota_usage(
    sent: DataFrame, texts_per_minute: int = 90, tokens_per_minute: int = 25_000
) -> DataFrame:
    """Use of the two budgets per minute of ``sent(minute, texts, tokens)``, one row per batch.

    A batch never costs more than one minute's budget.
    """
    used = sent.groupBy("minute").agg(
        F.sum(F.least("texts", F.lit(texts_per_minute))).alias("texts"),
        F.sum(F.least("tokens", F.lit(tokens_per_minute))).alias("tokens"),
    )
    over = (F.col("texts") > texts_per_minute) | (F.col("tokens") > tokens_per_minute)
    return used.withColumn("over_budget", over)


def quota_wait_audit(
    attempts: DataFrame,
    initial_ms: int = 15_000,
    max_ms: int = 300_000,
    total_ms: int = 1_800_000,
    bucket_width: int = 10_000,
) -> DataFrame:
    """Waits of refused attempts ``(batch_id, attempt, message)``, attempts counted from 0.

    The wait a provider suggests counts at least a second; without one the wait doubles up to a
    maximum. A batch is paused at the first attempt whose wait would pass the total.
    """
    suggested = tx.retry_delay_ms(F.col("message"))
    doubled = F.lit(initial_ms) * F.pow(F.lit(2), F.least("attempt", F.lit(20)))
    wait = F.when(suggested.isNotNull(), F.greatest(suggested, F.lit(1000))).otherwise(
        F.least(doubled, F.lit(max_ms))
    )
    waits = attempts.withColumn("wait_ms", wait.cast("long"))
    bucket = F.floor(F.col("attempt") / bucket_width)
    total = running_sum(
        waits, ["batch_id"], [F.col("attempt")], bucket, F.col("wait_ms"), "waited_ms"
    )
    before = F.col("waited_ms") - F.col("wait_ms")
    return total.select(
        "batch_id",
        "attempt",
        "wait_ms",
        "waited_ms",
        F.when(F.col("waited_ms") <= total_ms, "WAIT")
        .when(before <= total_ms, "PAUSED")
        .otherwise("NOT_REACHED")
        .alias("outcome"),
    )


def failed_runs(
    log: DataFrame, limit: int = 3, bucket_width: int = 100_000
) -> DataFrame:
    """Outcome of each run of ``log(run_id, batch_no, outcome, chunks)``.

    ``limit`` failed batches in a row abort a run; batches after that point do not count. The
    batch numbers may have holes.
    """
    bucket = F.floor(F.col("batch_no") / bucket_width)
    numbered = settle(number_rows(log, ["run_id"], [F.col("batch_no")], bucket, "_rn"), "batches")
    # Distance to the last stored batch is the length of the failed streak.
    failed = F.col("outcome") == "FAILED"
    marked = last_before(
        numbered,
        ["run_id"],
        ["_rn"],
        F.floor(F.col("_rn") / bucket_width),
        F.when(~failed, F.col("_rn")),
        "_stored_at",
    )
    streak = F.when(failed, F.col("_rn") - F.coalesce("_stored_at", F.lit(0)))
    marked = settle(marked.withColumn("_streak", streak), "streaks")
    aborts = marked.groupBy("run_id").agg(
        F.min(F.when(F.col("_streak") >= limit, F.col("_rn"))).alias("_abort")
    )
    reached = marked.join(aborts, "run_id").where(
        F.col("_abort").isNull() | (F.col("_rn") <= F.col("_abort"))
    )
    totals = reached.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum(F.when(~failed, F.col("chunks")).otherwise(0)).alias("processed"),
        F.sum(F.when(failed, F.col("chunks")).otherwise(0)).alias("failed"),
        F.bool_or(F.col("_abort").isNotNull()).alias("_aborted"),
    )
    return totals.select(
        "run_id",
        F.when(F.col("_aborted"), "FAILED").otherwise("COMPLETED").alias("state"),
        "batches",
        "processed",
        "failed",
    )
