"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing needs the lengths alone, and of those only how many pieces have each: at most
``capacity`` numbers, whatever the corpus. With them the plan is made on the driver: lengths from the longest
down, each piece into the open sequence with the least room that still fits, which a segment tree over the
remaining capacities finds in logarithmic time. Equal sequences are handled together, so the work does not
grow with the corpus, and the outcome is that of best-fit decreasing piece by piece. The plan says, for ranges of
the pieces of one length, which sequences they go to; Spark numbers the pieces of each length and joins.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import small, written

# Rows that number the pieces of one length do so within this many shares, so no length is one task.
SHARES = 512
# Words whose ids a Python worker keeps at hand.
KEPT_WORDS = 1 << 19
# How the vocabulary of a byte-level BPE writes a space and a line break.
SPACE, LINE_BREAK = "\u0120", "\u010a"
DOUBLE_SPACE = re.compile(r"\s\s").search
OTHER_SPACE = re.compile(r"[^\S \n]").search


class Room:
    """Segment tree over remaining capacities: how many groups of open sequences have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, room: int, number: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += number
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that any open sequence has."""
        at = least + self.size
        if self.counts[at]:
            return least
        while at > 1 and (at & 1 or not self.counts[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, pieces a sequence, offset): pieces from..to-1 of that length.

    Piece k of the range goes to sequence ``first + (k - from) // pieces`` at ``offset + (k - from) % pieces * length``.
    """
    room, open_at, plan, opened = Room(capacity), defaultdict(list), [], 0

    def put(length: int, done: int, first: int, sequences: int, each: int, left: int) -> None:
        plan.append((length, done, done + sequences * each, first, each, capacity - left))
        if rest := left - each * length:
            open_at[rest].append((first, sequences))
            room.add(rest, 1)

    for length in sorted(lengths, reverse=True):
        done, number = 0, lengths[length]
        while done < number:
            left = room.tightest(length)
            if left is None:
                left, (first, sequences) = capacity, (opened, -(-(number - done) // (capacity // length)))
                opened += sequences
            else:
                first, sequences = open_at[left].pop()
                room.add(left, -1)
            each = left // length
            full = min(sequences, (number - done) // each)
            if full:
                put(length, done, first, full, each, left)
                done += full * each
            if full < sequences and done < number:
                rest = number - done
                put(length, done, first + full, 1, rest, left)
                done, full = number, full + 1
            if full < sequences:
                open_at[left].append((first + full, sequences - full))
                room.add(left, 1)
    return plan


class Known(dict):
    """Ids by word, each encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word if word[:1] == "\n" else " " + word)
        return ids


class Encoder:
    """Token ids by a byte-level BPE of ``tokenizers``; ids of frequent words are kept.

    Byte-level BPE cuts a text before a space and around a line break that have no other white space beside
    them, and encodes what lies between for itself. A text with white space next to white space, or with an
    added token in it, is encoded in one go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(self.whole)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith((SPACE, LINE_BREAK))]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Keep the ids of new words, which are encoded in one go.

        Each begins with its space or line break, and no other token opens with one.
        """
        new = [w for w in filterfalse(self.known.__contains__, set(words)) if w not in ("", "\n")]
        if len(new) < 2:
            return
        joined = "".join([w if w[0] == "\n" else " " + w for w in new])
        (encoding,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(encoding.ids, "<u4")
        starts = 4 * np.flatnonzero(self.opens[ids])
        if len(starts) == len(new):
            raw, edges = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
            self.known.update(zip(new, [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text or text[0].isspace() or DOUBLE_SPACE(text) or any(token in text for token in self.added):
            return self.whole(text)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        first, *words = text.replace("\n", " \n").split(" ")
        if not OTHER_SPACE(text):
            self.learn(words)
        return self.whole(first) + b"".join(map(self.known.__getitem__, words))


def _encoder(path: str) -> Encoder:
    """One encoder for a Python worker, which serves many tasks."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches):
        encoder = _encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                first = total % capacity or capacity
                edges = [0, *range(first, total + 1, capacity)] if total > capacity else [0, total]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.column("doc").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                  ["doc", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): each document's ids and an end, cut if longer than a sequence."""
    work = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(work.dtypes)["doc"]
    return work.mapInArrow(_pieces(tokenizer, capacity, end_id),
                           f"doc {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id, so a null or empty text is one token. Longer documents are cut into
    pieces of ``capacity`` tokens, of which the first may be shorter. Rows with the same or a null id are packed
    each for itself. ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read.
    """
    spark = docs.sparkSession
    pieces = written(
        token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
        .withColumn("share", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(SHARES)).cast("int")), "pieces")
    # At most capacity x SHARES counts; where each share begins among the pieces of its length.
    counts = written(pieces.groupBy("length", "share").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = spark.createDataFrame(
        best_fit({r["length"]: r["n"] for r in totals}, capacity),
        "length bigint, begin bigint, end bigint, first bigint, each bigint, base bigint")
    within = Window.partitionBy("length", "share").orderBy("doc", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(
        F.broadcast(starts), ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan has a few rows for each of at most ``capacity`` lengths.
    ranges = F.broadcast(plan.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("begin", "end", "first", "each", "base"))).alias("ranges")))
    placed = ranked.join(ranges, "length").withColumn(
        "range", F.filter("ranges", lambda r: (r["begin"] <= F.col("rank")) & (F.col("rank") < r["end"]))[0])
    since = F.col("rank") - F.col("range.begin")
    each = F.col("range.each")
    return placed.select(
        F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("range.first") + F.floor(since / each)).cast("long").alias("sequence_id"),
        (F.col("range.base") + since % each * F.col("length")).cast("long").alias("offset"))
