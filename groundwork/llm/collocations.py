"""Phrase collocations: runs of two to five words that occur together more often than their parts would by chance.

Texts are parsed into overlapping chunks that begin at words their own hash selects, so equal passages give equal chunks
wherever they stand. Equal chunks become one entry of a dictionary with its frequency. Runs of words are counted inside
the entries, weighted; a run belongs to the chunk in whose own part it starts, so the words that a chunk shares with the
next one are counted once. Runs are counted by length: words first, then pairs of frequent words by hash, then, as
strings, the runs all of whose pairs may be frequent. The filters between the steps let too much through, never too
little, and have a bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import mix, small, word_hashes, word_spans, written

# Bytes that end a piece of text; A-Z count as a-z; words are runs of what is neither space nor tab.
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in BREAKS else 32 if b == 9 else b for b in range(256))
GAP = np.zeros(256, bool)
GAP[[0x20, 0x0A]] = True
SPACES = re.compile(rb"  +").sub
# One word in so many starts a chunk, about; no chunk has more words of its own than LONGEST.
TRIGGER, LONGEST = 16, 64
# Bytes of a text parsed at a time, entries that a task holds before it hands them on, rows and hashes it holds.
PIECE, HELD, HASHES = 1 << 20, 100_000, 1 << 20
# 64-bit words of the largest filter that is sent to the tasks (32 MB), bits a key sets in it.
FILTER, BITS = 1 << 22, 3
# Rows among which the joins deal out what belongs to one part of phrases.
SALTS = 16


# -- prefix-free parsing --------------------------------------------------------------------------


def _steps(text: bytes, overlap: int, size: int) -> Iterator[tuple[bytes, int]]:
    """A folded text in steps of about ``size`` bytes: (bytes, how many of them are the step's own).

    A step ends where a piece does. One piece longer than that is cut at a space, and the step also holds the
    ``overlap`` words behind the cut.
    """
    at = 0
    while len(text) - at > size:
        end = text.rfind(b"\n", at, at + size)
        if end > at:
            yield text[at:end], end - at
            at = end
            continue
        end = text.rfind(b" ", at + 1, at + size)
        if end < 0:
            ends = [k for k in (text.find(s, at + size) for s in (b"\n", b" ")) if k >= 0]
            end = min(ends, default=len(text))
        window, behind = 256, b""
        while True:
            ahead = text[end : end + window]
            stop = ahead.find(b"\n")
            words = (ahead if stop < 0 else ahead[:stop]).split()
            if stop >= 0 or end + window >= len(text) or len(words) > overlap:
                behind = b" ".join(words[:overlap])
                break
            window *= 4
        yield text[at:end] + b" " + behind, end - at
        at = end
    yield text[at:], len(text) - at


def parse(text: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[bytes, int]]:
    """(chunk, own): the words of each chunk, one space between them, and how many of them are its own."""
    text = text.translate(FOLD)
    if b"  " in text:
        text = SPACES(b" ", text)
    for step, own_bytes in _steps(text, overlap, size):
        raw = np.frombuffer(step, np.uint8)
        starts, ends = word_spans(raw, GAP)
        own = int(np.searchsorted(starts, own_bytes))
        if not own:
            continue
        piece = np.cumsum(raw == 10)[starts]
        at = np.arange(own)
        # A word's bytes decide whether it starts a chunk, so equal passages are cut alike.
        mark = (raw[starts[:own]].astype(np.int64) * 31 + raw[ends[:own] - 1] * 7 + (ends[:own] - starts[:own])) % TRIGGER == 0
        mark |= np.concatenate([[True], piece[1:own] != piece[: own - 1]])
        since = at - np.maximum.accumulate(np.where(mark, at, 0))
        begins = np.flatnonzero(mark | (since % LONGEST == 0))
        stops = np.append(begins[1:], own)
        lasts = np.minimum(stops + overlap, np.searchsorted(piece, piece[begins], "right")) - 1
        for a, b, n in zip(starts[begins].tolist(), ends[lasts].tolist(), (stops - begins).tolist()):
            yield step[a:b], n


def _entries(held: Counter) -> pa.RecordBatch:
    langs, own, chunks = zip(*held)
    return pa.record_batch([pa.array(langs, pa.string()), pa.array(own, pa.int32()),
                            pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())],
                           names=["lang", "own", "chunk", "n"])


def _chunks(longest: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for part in small(batches, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast("binary").to_pylist()):
                held.update([(lang, own, chunk) for chunk, own in parse(text, longest - 1)])
                if len(held) >= HELD:
                    yield _entries(held)
                    held = Counter()
        if held:
            yield _entries(held)

    return chunks


# -- counting inside entries ----------------------------------------------------------------------


class _Sums:
    """Sums of weights by key columns, over Arrow tables, handed on when a task holds too many."""

    def __init__(self, keys: list[str], most: int):
        self.keys, self.most, self.tables, self.rows = keys, most, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            self.tables.append(self._summed([table]))
            self.rows += self.tables[-1].num_rows
            if self.rows > self.most:
                self.tables = [self._summed(self.tables)]
                self.rows = self.tables[0].num_rows
                if self.rows > self.most // 2:
                    yield from self.rest()

    def _summed(self, tables: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(tables).group_by(self.keys).aggregate([("a", "sum")])
        return summed.rename_columns([*self.keys, "a"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            yield from self._summed(self.tables).to_batches()
        self.tables, self.rows = [], 0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the words of the entries' own parts."""
    sums = _Sums(["lang", "phrase", "words"], 4 * HELD)
    for part in small(batches, 2):
        table = _Words(part)
        yield from sums.add(table.phrases(np.flatnonzero(table.own), 1))
    yield from sums.rest()


class _Words:
    """The words of some entries side by side: hash, place in the entry, words of the entry from there on, weight."""

    def __init__(self, part: pa.RecordBatch):
        texts = part.column(2).cast("binary").to_pylist()
        places = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.raw = np.frombuffer(b" ".join(texts), np.uint8)
        self.starts, self.ends = word_spans(self.raw, GAP)
        firsts = np.searchsorted(self.starts, places[:-1])
        counts = np.diff(np.append(firsts, len(self.starts)))
        self.entry = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(self.starts)) - firsts[self.entry]
        self.own = at < part.column(1).to_numpy()[self.entry]
        self.rest = counts[self.entry] - at
        self.weight = part.column(3).to_numpy()
        self.lang = part.column(0).dictionary_encode()
        seeds = np.array([zlib.crc32(lang.encode()) for lang in self.lang.dictionary.to_pylist()], np.uint64)
        self.codes = self.lang.indices.to_numpy()
        self.seeds = seeds[self.codes] if len(seeds) else np.zeros(0, np.uint64)

    def hashes(self) -> np.ndarray:
        return mix(word_hashes(self.raw, self.starts, self.ends) + self.seeds[self.entry])

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word with the next, and whether both lie in one entry and pass the filter of words."""
        hashes = self.hashes()
        passed = _passes(words, hashes)
        both = passed & np.roll(passed, -1) & (self.rest >= 2)
        return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.roll(hashes, -1)), both

    def phrases(self, at: np.ndarray, size: int) -> pa.Table:
        """(lang, phrase, words, a) of the runs of ``size`` words that start at the words ``at``."""
        low, high = self.starts[at], self.ends[at + size - 1]
        offsets = np.concatenate([[0], np.cumsum(high - low)])
        # Each byte's place: the run's start plus how far into the run it is.
        index = np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], high - low)
        phrases = pa.StringArray.from_buffers(
            len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.raw[index]))
        entry = self.entry[at]
        langs = pa.DictionaryArray.from_arrays(self.codes[entry], self.lang.dictionary).cast(pa.string())
        return pa.table([langs, phrases, pa.array(np.full(len(at), size, np.int32)), pa.array(self.weight[entry])],
                        names=["lang", "phrase", "words", "a"])


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each word, as ``_Words`` has it; rows are entries of one word."""
    for part in small(batches, 2):
        yield pa.record_batch([pa.array(_Words(part).hashes().view(np.int64))], names=["h"])


def _pair_counts(words):
    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights, size = [], [], 0
        for part in small(batches, 2):
            table = _Words(part)
            hashes, both = table.pairs(words.value)
            use = np.flatnonzero(both & table.own)
            held.append(hashes[use])
            weights.append(table.weight[table.entry[use]])
            size += len(use)
            if size > HASHES:
                yield _hash_sums(held, weights)
                held, weights, size = [], [], 0
        if size:
            yield _hash_sums(held, weights)

    return pair_counts


def _hash_sums(held: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    hashes, weight = np.concatenate(held), np.concatenate(weights)
    order = np.argsort(hashes)
    hashes, weight = hashes[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return pa.record_batch([pa.array(hashes[starts].view(np.int64)), pa.array(np.add.reduceat(weight, starts))],
                           names=["h", "n"])


def _run_counts(words, pairs, longest: int):
    def run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(["lang", "phrase", "words"], 4 * HELD)
        for part in small(batches, 2):
            table = _Words(part)
            hashes, both = table.pairs(words.value)
            joined = both & _passes(pairs.value, hashes)
            run = joined & table.own
            for size in range(2, longest + 1):
                if size > 2:
                    run = run & np.roll(joined, 2 - size) & (table.rest >= size)
                yield from sums.add(table.phrases(np.flatnonzero(run), size))
        yield from sums.rest()

    return run_counts


# -- filters --------------------------------------------------------------------------------------


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(hashes), np.uint64)
    for k in range(BITS):
        mask |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return table[((hashes >> np.uint64(24)) & np.uint64(len(table) - 1)).astype(np.int64)] & mask == mask


def _filter(hashes: DataFrame):
    """A bit table over the column ``h``, sent to the tasks: 16 bits a key, up to ``FILTER`` words of 64 bits.

    Beyond that the table stays as it is and lets more through, which the counts behind it remove.
    """
    keys = hashes.count()
    size = min(FILTER, max(1, 1 << (max(1, keys) // 4).bit_length()))
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned("h", 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    at = F.shiftrightunsigned("h", 24).bitwiseAND(F.lit(size - 1))
    rows = hashes.select(at.alias("at"), mask.alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("bits")).toArrow()
    table = np.zeros(size, np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


# -- collocations ---------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, *, by: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100,
                  unknown: str = "und") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of every run of up to ``longest`` words that occurs ``least`` times, and (lang, n)."""
    lang, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(d)) for c, d in ((by, unknown), (text_col, "")))
    schema = "lang string, phrase string, words int, a long"
    entries = docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(
        _chunks(longest), "lang string, own int, chunk string, n long")
    entries = written(entries.groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n")).select("lang", "own", "chunk", "n"),
                      "phrase-dictionary")
    words = entries.mapInArrow(_word_counts, schema).groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    words = written(words, "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    often = words.where(F.col("a") >= least)
    one = often.select("lang", F.lit(1).alias("own"), F.col("phrase").alias("chunk"), F.col("a").alias("n"))
    word_filter = _filter(one.mapInArrow(_word_hashes, "h long"))
    pairs = entries.mapInArrow(_pair_counts(word_filter), "h long, n long").repartition("h").groupBy("h").agg(
        F.sum("n").alias("n"))
    pair_filter = _filter(written(pairs.where(F.col("n") >= least).select("h"), "phrase-pairs"))
    runs = entries.mapInArrow(_run_counts(word_filter, pair_filter, longest), schema)
    runs = runs.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return written(often.unionByName(runs), "phrase-counts"), totals


def _score(a: Column, n: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * n / (left * right)), exactly."""
    def whole(x: Column) -> Column:
        return x.cast("decimal(19,0)")

    return F.call_function("div", whole(a * scale) * whole(n), whole(left) * whole(right))


def collocations(docs: DataFrame, *, by: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100,
                 scale: int = 1000, covered: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase has two to ``longest`` words inside one piece of text and occurs ``least`` times or more (``a``,
    overlapping occurrences count). Of its cuts in two, the one with the lowest score floor(scale * a * n / (l * r))
    counts, ties to the shorter first part; ``l`` and ``r`` are the counts of the parts, ``n`` all words of the
    language. A phrase goes if a longer one that holds it occurs in at least ``covered`` percent of its places. Ranked
    by score, then ``a``, then the phrase. A null language is ``und``, a null text empty; repeated rows count each
    time; long texts are parsed step by step; other columns are not read; an empty table gives no row.
    """
    counts, totals = phrase_counts(docs, by=by, text_col=text_col, longest=longest, least=least)
    phrases = counts.where("words > 1")

    # Both parts of every cut meet their counts in one join. A common part belongs to many phrases, so they are dealt
    # out over several copies of its row.
    cut = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left = F.expr("substring_index(phrase, ' ', k)")
    rest = F.substr("phrase", F.length(left) + 2)
    parts = cut.select("lang", "phrase", "a", "k", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"),
                       F.posexplode(F.array(left, rest)).alias("side", "part"))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = parts.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("count"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("count"))).alias("r"))
    scored = met.join(totals, "lang").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"), scale))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    split = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda first: F.array_join(F.slice(split, first, size), " "))))
    longer = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    # The best of each part of a language first, so that however many tasks there are one sees few rows of a language.
    best_first = [F.desc("cut.score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best_first)
    kept = kept.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top).drop("place")
    order = Window.partitionBy("lang").orderBy(*best_first)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
