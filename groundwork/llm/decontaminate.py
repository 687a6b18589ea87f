"""Benchmark decontamination: Wu-Manber search for the windows of all test items at once.

The alphabet is words. For all windows of one length, a shift table says how far the search may jump when
it sees a block of words, the hash of a window's end selects the windows that may end there, and their
bytes are compared directly. Many places of a text are searched side by side.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import as_bytes, mix, rounds, run_hashes, small, word_hashes, word_spans

# Words are runs of ASCII digits and letters and of everything beyond ASCII; A-Z count as a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])
# Words between the starts of two searches that run side by side.
LANE = 256


class Windows:
    """All windows of one length: shift table, hashes of whole windows, and the items that hold each."""

    def __init__(self, length: int, holders: dict[bytes, set[int]]):
        self.length, self.holders = length, holders
        self.block = min(3, max(1, length // 3))
        words = []
        for window in holders:
            raw = np.frombuffer(window, np.uint8)
            words.append(word_hashes(raw, *word_spans(raw, GAP)))
        table = np.array(words, np.uint64).reshape(len(holders), length)
        self.ends = np.unique(np.concatenate([run_hashes(row, length) for row in table]))
        self.mask = np.uint64((1 << max(10, (16 * table.size).bit_length())) - 1)
        jump = length - self.block + 1
        self.shift = np.full(int(self.mask) + 1, jump, np.uint16)
        for last in range(self.block - 1, length):
            slots = (self.blocks(table, last) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slots, np.uint16(length - 1 - last))

    @classmethod
    def of(cls, state: dict) -> Windows:
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def blocks(self, table: np.ndarray, last: int) -> np.ndarray:
        total = np.zeros(len(table), np.uint64)
        for k in range(last - self.block + 1, last + 1):
            total = total * np.uint64(0x100000001B3) + table[:, k]
        return mix(total)

    def found(self, words: np.ndarray) -> np.ndarray:
        """Last words of all places that may hold a window."""
        at = np.arange(0, len(words), LANE) + self.length - 1
        stop = np.minimum(np.arange(0, len(words), LANE) + LANE + self.length - 1, len(words))
        hits = []
        while len(at):
            live = at < stop
            at, stop = at[live], stop[live]
            total = np.zeros(len(at), np.uint64)
            for k in range(self.block - 1, -1, -1):
                total = total * np.uint64(0x100000001B3) + words[at - k]
            jump = self.shift[(mix(total) & self.mask).astype(np.int64)]
            hits.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
        ends = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        total = np.zeros(len(ends), np.uint64)
        for k in range(self.length - 1, -1, -1):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[ends - k]
        return ends[np.isin(mix(total), self.ends)]


def windows_of(items: list[tuple[str, str]], length: int) -> tuple[list[str], list[Windows]]:
    """Names of the items, and their windows by length; an item of fewer words is one window."""
    names, by_length = [], defaultdict(lambda: defaultdict(set))
    for name, text in items:
        words = (text or "").encode().translate(FOLD)
        raw = np.frombuffer(words, np.uint8)
        words = [words[a:b] for a, b in zip(*word_spans(raw, GAP), strict=True)]
        size = min(length, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            by_length[size][b" ".join(words[k : k + size])].add(len(names))
        names.append("" if name is None else str(name))
    return names, [Windows(size, dict(found)) for size, found in sorted(by_length.items())]


def search(texts: list[bytes], groups: list[Windows]):
    """For each text: how many words, which of them are hit, which items occur."""
    for first, joined, places in rounds(texts):
        folded = joined.translate(FOLD)
        raw = np.frombuffer(folded, np.uint8)
        starts, ends = word_spans(raw, GAP)
        words = word_hashes(raw, starts, ends)
        bounds = np.searchsorted(starts, places)
        cover = np.zeros(len(words) + 1, np.int32)
        items = defaultdict(set)
        for group in groups:
            last = group.found(words)
            begin = last - group.length + 1
            owner = np.searchsorted(bounds, begin, "right") - 1
            inside = last < bounds[owner + 1]
            for a, b, k in zip(begin[inside].tolist(), last[inside].tolist(), owner[inside].tolist(), strict=True):
                # The direct comparison: the words themselves.
                held = group.holders.get(b" ".join(folded[starts[i] : ends[i]] for i in range(a, b + 1)))
                if held:
                    cover[a] += 1
                    cover[b + 1] -= 1
                    items[k] |= held
        hit = np.cumsum(cover[:-1]) > 0
        for k in range(len(places) - 1):
            yield hit[bounds[k] : bounds[k + 1]], items.get(k, set())


def passes(items: DataFrame, id_col: str, text_col: str, length: int, pass_bytes: int):
    """The test items in parts of about ``pass_bytes``, so that what is sent to the tasks is bounded."""
    items = items.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").alias("body"))
    items = items.where("body IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-total // pass_bytes))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("name", "body"), F.lit(parts)) == k)
        names, groups = windows_of([tuple(r) for r in part.collect()], length)
        # Plain values only, so that a task needs nothing but itself to read them.
        yield items.sparkSession.sparkContext.broadcast((names, [vars(g) for g in groups]))


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", length: int = 10,
         pass_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (names, sorted), contaminated.

    A null text has no words; an item without words has no window; items with a null id count under an
    empty name. Repeated rows are judged each. Test items of any number are searched in parts of
    ``pass_bytes`` of text, one after the other over the same stream of documents, without a shuffle.
    """
    work = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("body"),
                       F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    for shipped in passes(items, item_col, item_text, length, pass_bytes):
        work = work.mapInArrow(_scanner(shipped), work.schema)

    def total(batches):
        for batch in batches:
            bits = [np.frombuffer(x, np.uint8) for x in batch.column("hit").to_pylist()]
            yield pa.record_batch({
                "doc": batch.column("doc"), "n_words": pa.array([len(x) for x in bits], pa.int64()),
                "n_hit": pa.array([int(x.sum()) for x in bits], pa.int64()), "items": batch.column("items")})

    kind = dict(work.dtypes)["doc"]
    counted = work.select("doc", "hit", "items").mapInArrow(
        total, f"doc {kind}, n_words bigint, n_hit bigint, items array<string>")
    return counted.select(F.col("doc").alias(id_col), "n_words", "n_hit", "items",
                          (F.col("n_hit") > 0).alias("contaminated"))


def _scanner(shipped):
    def scanned(batches):
        names, states = shipped.value
        groups = [Windows.of(s) for s in states]
        for batch in small(batches, "body"):
            hits, items = [], []
            before, already = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            for k, (hit, found) in enumerate(search(as_bytes(batch.column("body")), groups)):
                seen = hit if before[k] is None else hit | (np.frombuffer(before[k], np.uint8) > 0)
                hits.append(seen.astype(np.uint8).tobytes())
                items.append(sorted({names[i] for i in found} | set(already[k] or ())))
            yield pa.record_batch({"doc": batch.column("doc"), "body": batch.column("body"),
                                   "hit": pa.array(hits, pa.binary()),
                                   "items": pa.array(items, pa.list_(pa.string()))})

    return scanned


def without_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                         item_text: str = "text", length: int = 10, pass_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no window of any test item."""
    kept = docs
    for shipped in passes(items, item_col, item_text, length, pass_bytes):
        kept = kept.mapInArrow(_sieve(shipped, docs.columns.index(text_col)), docs.schema)
    return kept


def _sieve(shipped, at: int):
    def sieved(batches):
        groups = [Windows.of(s) for s in shipped.value[1]]
        for batch in small(batches, at):
            clean = [not hit.any() for hit, _ in search(as_bytes(batch.column(at)), groups)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return sieved


def digest(items: list[str]) -> str:
    """The fingerprint of an item list, as the query reports it."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
