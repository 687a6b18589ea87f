"""What several operators share: written intermediate tables, identifiers, words as byte spans, word hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.session import scratch_dir

# Documents without an id sort behind all others while an operator works.
NO_ID = 2**63 - 1
# Bytes of text that one round of array work takes at a time.
ROUND_BYTES = 1 << 20


def written(table: DataFrame, purpose: str) -> DataFrame:
    """The table as files in the shared folder: cuts the lineage, survives lost executors."""
    path = scratch_dir(table.sparkSession, purpose)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def ident(name: str) -> Column:
    """The id as a long that orders null behind all others."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NO_ID))


def real_id(column: str = "doc") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, print, text). Rows equal in both id and text get equal results, so (doc, print) names a row well enough."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(ident(id_col).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key``; no task gets all rows of one frequent key.

    ``rows`` is the number of rows of ``left``, or more. Keys with over a thousandth of them are at most a thousand
    whatever the input, so these keys alone are broadcast: their rows are dealt by ``by``, and their row of ``right``
    is repeated for each part.
    """
    most = max(64, rows // 1000)
    hot = left.groupBy(key).count().where(F.col("count") > most).select(
        key, F.ceil(F.col("count") / most).cast("int").alias("__parts"))
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int"))
    copies = right.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__parts").join(copies.drop("__parts"), [key, "__part"]).drop("__part")


# -- words as spans of bytes ---------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for at most ``ROUND_BYTES`` places."""
    if len(_POWERS[0]) < n:
        size = min(1 << (n - 1).bit_length(), ROUND_BYTES)
        inverse = np.uint64(pow(int(_PRIME), -1, 2**64))
        for k, base in enumerate((_PRIME, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not in ``gap``, a table of 256 truth values."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~gap[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums over the bytes of some ``ROUND_BYTES`` at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) < ROUND_BYTES:
        return mix(_span_sums(raw, starts, ends))
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + ROUND_BYTES - 1, "right")))
        if ends[first] - low < ROUND_BYTES:
            out[first:last] = _span_sums(raw[low : ends[last - 1]], starts[first:last] - low, ends[first:last] - low)
        else:
            out[first] = _long_sum(raw[low : ends[first]])
        first = last
    return mix(out)


def _span_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def _long_sum(raw: np.ndarray) -> np.uint64:
    """The sum of one span that is longer than the tables of powers."""
    total, size = 0, ROUND_BYTES - 1
    for at in range(0, len(raw), size):
        part = raw[at : at + size]
        whole = np.array([0]), np.array([len(part)])
        total += int(_span_sums(part, *whole)[0]) * pow(int(_PRIME), at, 2**64)
    return np.uint64(total % 2**64)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = total * _PRIME + words[k : k + count]
    return mix(total)


def rounds(texts: list[bytes], size: int = ROUND_BYTES):
    """Consecutive texts, joined by a space, up to ``size`` bytes; a longer text goes alone.

    Yields the index of the first, the joined bytes, and where each text starts.
    """
    first, total = 0, 0
    for k, text in enumerate(texts):
        if total and total + len(text) > size:
            yield _joined(texts, first, k)
            first, total = k, 0
        total += len(text) + 1
    if first < len(texts):
        yield _joined(texts, first, len(texts))


def _joined(texts: list[bytes], first: int, end: int):
    part = texts[first:end]
    places = np.cumsum([0] + [len(t) + 1 for t in part])
    return first, b" ".join(part), places


def as_bytes(column) -> list[bytes]:
    """An Arrow column of strings as bytes; null as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def slices(batch, column: int, size: int = ROUND_BYTES):
    """Consecutive rows of an Arrow batch with up to ``size`` bytes of text in a column; a longer text goes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for k, length in enumerate(lengths):
        if k > first and total + length > size:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += int(length)
    if first < len(lengths):
        yield batch.slice(first)


def small(batches, column: int | str):
    """The rows of Arrow batches in batches with up to ``ROUND_BYTES`` of text in a column.

    What the work on them needed goes back to the system when they end: a Python worker serves many tasks, and what
    each stage once needed would add up in it.
    """
    for batch in batches:
        at = column if isinstance(column, int) else batch.schema.get_field_index(column)
        yield from slices(batch, at)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
