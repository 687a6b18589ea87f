"""Request limits replayed over a log, and what streams went wrong.

A limiter is sequential inside one client. Its state is known again after a long enough pause, so
a client's log is first split at such pauses and the parts are replayed independently. Parts
without any real pause (an overloaded client) need no replay: there the accepted count has a
closed form over fixed time slots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.ordered import last_before, running_min, running_sum, split_at_gaps
from groundwork.session import settle

SECOND = 1_000_000
HOUR = 3600 * SECOND


def client_key(email: Column, address: Column) -> Column:
    by_address = F.concat(F.lit("ip:"), F.coalesce(address, F.lit("unknown")))
    return F.coalesce(F.concat(F.lit("user:"), F.lower(email)), by_address)


def _time_bucket(width: int) -> Column:
    return F.floor(F.col("ts") / width)


def replay(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], object],
    result: str,
    inputs: Sequence[str],
) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in order and keep what it returns.

    Rows stream through sorted partitions in Arrow batches; only the state of the current key is
    held, never a group.
    """
    laid = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    name = result.split()[0]
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), result])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            outcomes = []
            owners = frame[list(keys)].itertuples(index=False, name=None)
            for owner, row in zip(owners, frame[list(inputs)].itertuples(index=False, name=None)):
                if owner != current:
                    current, state = owner, start()
                outcomes.append(step(state, row))
            yield frame.assign(**{name: outcomes})

    return laid.mapInPandas(run, schema)


# -- token bucket --------------------------------------------------------------------------


class TokenBucket:
    """Continuous refill, kept as the time at which the bucket is full again.

    Times are multiplied by the capacity, so that one token is a whole number of units.
    """

    def __init__(self, capacity: int, period: int):
        self.capacity, self.period, self.full_at = capacity, period, None

    def take(self, ts: int) -> bool:
        now = ts * self.capacity
        if self.full_at is not None and self.full_at - now > (self.capacity - 1) * self.period:
            return False
        self.full_at = max(now, self.full_at or now) + self.period
        return True


def rate_limit(
    requests: DataFrame,
    capacity: int = 20,
    period: int = 60 * SECOND,
    bucket_width: int = HOUR,
) -> DataFrame:
    """Requests ``event_id, client, ts`` (microseconds) with ``accepted``.

    Each client has a bucket of ``capacity`` tokens that refills evenly in ``period``; a request
    takes one or is refused. After a pause of a whole period the bucket is full.
    """
    order = ["ts", "event_id"]
    base = requests.select("event_id", "client", "ts")
    split = split_at_gaps(base, ["client"], order, _time_bucket(bucket_width), "ts", period, "opened")
    # No pause as long as the time of one token: the bucket is never full again in this part.
    longest = F.coalesce(F.max("_gap"), F.lit(0))
    parts = split.groupBy("client", "opened").agg(longest.alias("_longest"))
    dense = F.lit(capacity >= 2) & (F.col("_longest") * capacity <= period)
    kinds = parts.select("client", "opened", dense.alias("_dense"))
    marked = split.drop("_gap").join(kinds, ["client", "opened"])
    busy = _accept_dense(marked.where(F.col("_dense")).drop("_dense"), capacity, period)
    calm = replay(
        marked.where(~F.col("_dense")).drop("_dense"),
        ["client", "opened"],
        order,
        lambda: TokenBucket(capacity, period),
        lambda bucket, row: bucket.take(row[0]),
        "accepted boolean",
        ["ts"],
    )
    columns = ["event_id", "client", "ts", "accepted"]
    return busy.select(*columns).unionByName(calm.select(*columns))


def _accept_dense(rows: DataFrame, capacity: int, period: int) -> DataFrame:
    """Parts that never refill: by slot ``j`` (one token long) at most ``j + capacity`` are accepted.

    With ``N(j)`` requests up to slot ``j``, accepted are ``A(j) = min(N(j), min over k <= j of
    k + capacity + N(j) - N(k))``. Slots are counted before they are moved; the requests of one
    slot are the largest group any task sees.
    """
    key = ["client", "opened"]
    slotted = rows.withColumn(
        "slot", F.floor((F.col("ts") - F.col("opened")) * capacity / period).cast("long")
    )
    counts = settle(slotted.groupBy(*key, "slot").agg(F.count(F.lit(1)).alias("n")), "slots")
    bucket = F.floor(F.col("slot") / 10_000)
    summed = running_sum(counts, key, [F.col("slot")], bucket, F.col("n"), "total")
    room = F.col("slot") + capacity - F.col("total")
    lowest = running_min(summed, key, [F.col("slot")], bucket, room, "lowest")
    accepted = F.col("total") + F.least(F.lit(0), F.col("lowest"))
    done = lowest.withColumn("_done", accepted)
    before = last_before(done, key, ["slot"], bucket, F.col("_done"), "_before")
    quota = before.select(*key, "slot", (F.col("_done") - F.coalesce("_before", F.lit(0))).alias("_quota"))
    place = F.row_number().over(Window.partitionBy(*key, "slot").orderBy("ts", "event_id"))
    placed = slotted.withColumn("_place", place).join(quota, [*key, "slot"])
    return placed.withColumn("accepted", F.col("_place") <= F.col("_quota"))


def requests_per_window(decided: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """Requests and refusals per client and window."""
    window = F.floor(F.col("ts") / width).alias("window_no")
    return decided.groupBy("client", window).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("accepted")).alias("refused")
    )


# -- permits in flight ---------------------------------------------------------------------


class Permits:
    """Permits of one user: ``ticket -> time at which it lapses``, and which are redeemed."""

    def __init__(self, limit: int, ticket_ttl: int, stream_timeout: int):
        self.limit, self.ticket_ttl, self.stream_timeout = limit, ticket_ttl, stream_timeout
        self.lapses: dict[int, int] = {}
        self.redeemed: set[int] = set()

    def handle(self, ts: int, kind: str, ticket: int) -> str:
        for held in [t for t, at in self.lapses.items() if at <= ts]:
            self._release(held)
        if kind == "issue":
            if len(self.lapses) >= self.limit:
                return "TOO_MANY"
            self.lapses[ticket] = ts + self.ticket_ttl
            return "ISSUED"
        if kind == "redeem":
            if ticket not in self.lapses or ticket in self.redeemed:
                return "NOT_FOUND"
            self.redeemed.add(ticket)
            self.lapses[ticket] = ts + self.stream_timeout
            return "STARTED"
        if ticket not in self.redeemed:
            return "IGNORED"
        self._release(ticket)
        return "ENDED"

    def _release(self, ticket: int) -> None:
        del self.lapses[ticket]
        self.redeemed.discard(ticket)


def inflight_limit(
    log: DataFrame,
    limit: int = 2,
    ticket_ttl: int = 120 * SECOND,
    stream_timeout: int = 180 * SECOND,
    bucket_width: int = HOUR,
) -> DataFrame:
    """Ticket events ``event_id, user_id, ts, kind, ticket`` with their ``outcome``.

    ``issue`` takes one of ``limit`` permits, ``redeem`` starts the stream once and only for the
    user the ticket was issued to, ``end`` gives the permit back; so does an unredeemed ticket or
    a stream that runs out of time. After a pause longer than both times nothing is in flight.
    """
    order = ["ts", "event_id"]
    base = log.select("event_id", "user_id", "ts", "kind", "ticket")
    pause = ticket_ttl + stream_timeout
    split = split_at_gaps(base, ["user_id"], order, _time_bucket(bucket_width), "ts", pause, "opened")
    return replay(
        split,
        ["user_id", "opened"],
        order,
        lambda: Permits(limit, ticket_ttl, stream_timeout),
        lambda permits, row: permits.handle(*row),
        "outcome string",
        ["ts", "kind", "ticket"],
    ).drop("opened", "_gap")


# -- streams -------------------------------------------------------------------------------


def stalled_streams(
    lines: DataFrame,
    idle: int = 60 * SECOND,
    deadline: int = 170 * SECOND,
    bucket_width: int = HOUR,
) -> DataFrame:
    """Per stream of ``stream_id, event_id, ts`` whether and when it is aborted.

    A stream is given up when no line came for longer than ``idle``, or when it is still open
    ``deadline`` after its first line.
    """
    spaced = last_before(
        lines, ["stream_id"], ["ts", "event_id"], _time_bucket(bucket_width), F.col("ts"), "_previous"
    )
    too_late = F.col("ts") - F.col("_previous") > idle
    summed = spaced.groupBy("stream_id").agg(
        F.min("ts").alias("_start"),
        F.max("ts").alias("_last"),
        F.min(F.when(too_late, F.col("_previous") + idle)).alias("_idle_at"),
    )
    late = F.when(F.col("_last") - F.col("_start") > deadline, F.col("_start") + deadline)
    staged = summed.withColumn("_late_at", late)
    idle_first = F.col("_idle_at") <= F.coalesce("_late_at", F.col("_idle_at"))
    return staged.select(
        "stream_id",
        F.least("_idle_at", "_late_at").alias("aborted_at"),
        F.when(idle_first, "IDLE").when(F.col("_late_at").isNotNull(), "DEADLINE").otherwise("OK").alias("state"),
    )


def status_asof(
    requests: DataFrame, changes: DataFrame, bucket_width: int = HOUR
) -> DataFrame:
    """Requests ``event_id, client, ts`` with the latest ``status`` of ``changes`` at that time.

    Both feeds are merged and the status is carried forward, so neither side is multiplied.
    """
    asked = requests.select(
        "event_id", "client", "ts", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_status")
    )
    told = changes.select(
        "event_id", "client", "ts", F.lit(0).alias("_kind"), F.col("status").alias("_status")
    )
    merged = last_before(
        asked.unionByName(told), ["client"], ["ts", "_kind", "event_id"], _time_bucket(bucket_width),
        F.col("_status"), "status",
    )
    return merged.where(F.col("_kind") == 1).select("event_id", "client", "ts", "status")


def status_cached(
    requests: DataFrame, changes: DataFrame, ttl: int, bucket_width: int = HOUR
) -> DataFrame:
    """Requests ``event_id, client, ts`` with the ``status`` that a cache of ``ttl`` shows them.

    ``changes(event_id, client, ts, status[, evicts])``. A request that finds no entry younger than ``ttl`` fills it
    with the status of that time; later ones see that until it is too old or a change that ``evicts`` drops it (all do
    unless the column says otherwise). A change at the time of a request comes first. Which requests fill is a chain,
    each link the first request ``ttl`` after the one before; requests behind an eviction or a pause of ``ttl`` start
    chains of their own. The links of all requests are found by one as-of pass and followed in steps that double, so
    the number of rounds is the logarithm of the longest chain and no client is walked row by row. Event ids are unique.
    """
    evicts = F.col("evicts") if "evicts" in changes.columns else F.lit(True)
    merged = requests.select("event_id", "client", "ts", F.lit(1).alias("_kind"), F.lit(False).alias("_evicts")).unionByName(
        changes.select("event_id", "client", "ts", F.lit(0).alias("_kind"), F.coalesce(evicts, F.lit(False)).alias("_evicts")))
    order, bucket = ["ts", "_kind", "event_id"], _time_bucket(bucket_width)
    place = F.struct(*order)
    merged = last_before(merged, ["client"], order, bucket, F.when(F.col("_kind") == 1, place), "_before")
    merged = last_before(merged, ["client"], order, bucket, F.when(F.col("_evicts"), place), "_dropped")
    starts = (F.col("_before").isNull() | (F.col("ts") - F.col("_before.ts") >= ttl)
              | F.coalesce(F.col("_dropped") > F.col("_before"), F.lit(False)))
    asked = merged.where("_kind = 1").select("event_id", "client", "ts", F.when(starts, F.col("event_id")).alias("_start"))
    asked = settle(asked, "cache-requests")
    chained = last_before(asked, ["client"], ["ts", "event_id"], bucket, F.col("_start"), "_chain")
    chained = settle(chained.select("event_id", "client", "ts", F.coalesce("_start", "_chain").alias("_chain")), "cache-chains")

    links = settle(_links(chained, ttl, bucket_width), "cache-links")
    fills = settle(asked.where("_start IS NOT NULL").select("event_id"), "cache-fills")
    while not links.isEmpty():
        fills = settle(fills.union(fills.join(links, "event_id").select("to")), "cache-fills")
        onward = links.select(F.col("event_id").alias("to"), F.col("to").alias("_onward"))
        links = settle(links.join(onward, "to").select("event_id", F.col("_onward").alias("to")), "cache-links")

    filling = asked.join(fills, "event_id", "left_semi").select("event_id", "client", "ts")
    filled = status_asof(filling, changes, bucket_width).select("event_id", F.struct("status").alias("_entry"))
    seen = asked.select("event_id", "client", "ts").join(filled, "event_id", "left")
    seen = last_before(seen, ["client"], ["ts", "event_id"], bucket, F.col("_entry"), "_older")
    return seen.select("event_id", "client", "ts", F.coalesce("_entry", "_older")["status"].alias("status"))


def _links(chained: DataFrame, ttl: int, bucket_width: int) -> DataFrame:
    """``event_id, to``: the first request of the same chain at least ``ttl`` after each, where there is one.

    Time runs backwards here, so that the request that follows is the last one before.
    """
    keys = ["client", "_chain"]
    rows = chained.select(*keys, "event_id", (-F.col("ts")).alias("_back"), F.lit(0).alias("_probe"), (-F.col("event_id")).alias("_id"))
    probes = chained.select(
        *keys, "event_id", (-F.col("ts") - ttl).alias("_back"), F.lit(1).alias("_probe"), (-F.col("event_id")).alias("_id"))
    found = last_before(
        rows.unionByName(probes), keys, ["_back", "_probe", "_id"], F.floor(F.col("_back") / bucket_width),
        F.when(F.col("_probe") == 0, F.col("event_id")), "to")
    return found.where("_probe = 1 AND to IS NOT NULL").select("event_id", "to")


def is_end_marker(provider: Column, line: Column) -> Column:
    openai = line == "data: [DONE]"
    claude = F.contains(line, F.lit('"message_stop"'))
    return F.when(provider == "OPENAI", openai).when(provider == "CLAUDE", claude).otherwise(line == ": end")


def complete_answers(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers whose stream ended normally. A broken one is dropped whole."""
    last = lines.groupBy("stream_id").agg(F.max_by(F.struct("provider", "line"), "seq").alias("l"))
    ended = last.where(is_end_marker(F.col("l.provider"), F.col("l.line"))).select("stream_id")
    return answers.join(ended, "stream_id", "left_semi")
