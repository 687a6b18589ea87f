"""The same limits on a live stream: state per client, dropped when it no longer matters.

Rows of one micro-batch are put in time order inside a client; a row older than the watermark is
dropped by Spark before it gets here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundwork.operators.limits import Permits, TokenBucket


def rate_limit_stream(
    requests: DataFrame, capacity: int = 20, period: int = 60_000_000, delay: str = "1 minute",
    forget_after_ms: int = 300_000,
) -> DataFrame:
    """Stream of ``event_id, client, at timestamp`` with ``accepted``.

    A client's state is forgotten five minutes after its last request; its bucket has long been
    full by then.
    """
    timed = requests.withWatermark("at", delay).withColumn("ts", F.unix_micros("at"))
    kind = dict(requests.dtypes)["event_id"]

    def decide(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        bucket = TokenBucket(capacity, period)
        if state.exists:
            bucket.full_at = state.get[0]
        rows["accepted"] = [bucket.take(int(ts)) for ts in rows["ts"]]
        state.update((bucket.full_at,))
        last_ms = int(rows["ts"].max()) // 1000
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + forget_after_ms)
        yield rows[["event_id", "client", "ts", "accepted"]]

    return timed.groupBy("client").applyInPandasWithState(
        decide,
        f"event_id {kind}, client string, ts long, accepted boolean",
        "full_at long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def inflight_limit_stream(
    log: DataFrame, limit: int = 2, ticket_ttl: int = 120_000_000, stream_timeout: int = 180_000_000,
    delay: str = "1 minute",
) -> DataFrame:
    """Stream of ``event_id, user_id, at, kind, ticket`` with ``outcome``."""
    timed = log.withWatermark("at", delay).withColumn("ts", F.unix_micros("at"))

    def decide(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        permits = Permits(limit, ticket_ttl, stream_timeout)
        if state.exists:
            tickets, lapses, redeemed = state.get
            permits.lapses = dict(zip(tickets, lapses))
            permits.redeemed = set(redeemed)
        work = zip(rows["ts"], rows["kind"], rows["ticket"])
        rows["outcome"] = [permits.handle(int(ts), kind, int(t)) for ts, kind, t in work]
        state.update((list(permits.lapses), list(permits.lapses.values()), list(permits.redeemed)))
        last_ms = (int(rows["ts"].max()) + ticket_ttl + stream_timeout) // 1000
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[["event_id", "user_id", "ts", "kind", "ticket", "outcome"]]

    return timed.groupBy("user_id").applyInPandasWithState(
        decide,
        "event_id long, user_id long, ts long, kind string, ticket long, outcome string",
        "tickets array<long>, lapses array<long>, redeemed array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def requests_per_window_stream(decided: DataFrame, delay: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Requests and refusals per client and window of a stream ``client, at, accepted``."""
    grouped = decided.withWatermark("at", delay).groupBy(F.window("at", width), "client")
    return grouped.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("accepted")).alias("refused")
    )


def stalled_sessions_stream(lines: DataFrame, delay: str = "1 minute", idle: str = "60 seconds") -> DataFrame:
    """Stretches of a stream of ``stream_id, at`` without a pause longer than ``idle``."""
    grouped = lines.withWatermark("at", delay).groupBy(F.session_window("at", idle), "stream_id")
    return grouped.agg(F.count(F.lit(1)).alias("lines"))


def quota_usage_stream(
    sent: DataFrame, texts_per_minute: int = 90, tokens_per_minute: int = 25_000, delay: str = "1 minute"
) -> DataFrame:
    """Use of the embedding budgets per minute of a stream ``at, texts, tokens``."""
    used = sent.withWatermark("at", delay).groupBy(F.window("at", "1 minute").alias("minute")).agg(
        F.sum(F.least("texts", F.lit(texts_per_minute))).alias("texts"),
        F.sum(F.least("tokens", F.lit(tokens_per_minute))).alias("tokens"),
    )
    over = (F.col("texts") > texts_per_minute) | (F.col("tokens") > tokens_per_minute)
    return used.withColumn("over_budget", over)
