"""Substring dedup: repeated runs of words are cut out of all documents but the first that holds them.

Windows of ``window`` words are partitioned as super-k-mers. A window's minimiser is the run of ``mer`` of its
words with the smallest hash; consecutive windows with the same minimiser travel as one packed string to the
bucket of that minimiser, and equal windows always meet there. Two things keep this cheap. Minimisers are
counted first, without any text: a window that occurs in two documents has a minimiser that does, so only the
super-k-mers of such minimisers are packed. And equal packed strings combine before and in the bucket, so that
a passage in a third of all documents sends one string per task; only buckets with different strings are taken
apart into windows, which are counted by their exact digest (128 bits of BLAKE2 over the words).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import SPACE, as_bytes, keyed, real_id, rounds, run_hashes, word_hashes, word_spans, written

# Windows in one packed string at most; longer runs of one minimiser are cut.
RUN = 64


def super_kmers(texts: list[bytes], window: int, mer: int):
    """(text, minimiser, first window, number of windows) as arrays, for all texts."""
    for first, joined, places in rounds(texts):
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = word_spans(raw, SPACE)
        mers = run_hashes(word_hashes(raw, starts, ends), mer)
        span = window - mer + 1
        if len(mers) < span:
            continue
        # Minimum over ``span`` neighbours, from minima over powers of two.
        low, width = mers, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        count = len(mers) - span + 1
        low = np.minimum(low[:count], low[span - width : span - width + count])
        bounds = np.searchsorted(starts, places)
        at = np.arange(count)
        owner = np.searchsorted(bounds, at, "right") - 1
        inside = at + window <= bounds[owner + 1]
        at, owner, low = at[inside], owner[inside], low[inside]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        run = np.flatnonzero(new)
        since = at - at[run][np.cumsum(new) - 1]
        begin = np.flatnonzero(since % RUN == 0)
        size = np.diff(np.append(begin, len(at)))
        yield (first + owner[begin], low[begin].view(np.int64), at[begin] - bounds[owner[begin]], size)


def _census(window: int, mer: int):
    def counted(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            prints = batch.column("print").to_numpy()
            for text, low, at, size in super_kmers(as_bytes(batch.column("text")), window, mer):
                yield pa.record_batch({"low": low, "doc": docs[text], "print": prints[text],
                                       "at": at.astype(np.int32), "n": size.astype(np.int32)})

    return counted


def _words(text: bytes) -> list[bytes]:
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw, SPACE)
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _pack(window: int):
    def batch_of(rows):
        low, doc, mark, at, n, packed = zip(*rows, strict=True)
        return pa.record_batch({
            "low": pa.array(low, pa.int64()), "doc": pa.array(doc, pa.int64()), "print": pa.array(mark, pa.int64()),
            "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int32()), "packed": pa.array(packed, pa.binary())})

    def packed(batches):
        rows = []
        for batch in batches:
            for doc, mark, text, runs in zip(batch.column("doc").to_pylist(), batch.column("print").to_pylist(),
                                             as_bytes(batch.column("text")), batch.column("runs").to_pylist(),
                                             strict=True):
                words = _words(text)
                for r in runs:
                    rows.append((r["low"], doc, mark, r["at"], r["n"],
                                 b" ".join(words[r["at"] : r["at"] + r["n"] + window - 1])))
                    if len(rows) == 8192:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return packed


def _take_apart(window: int):
    def windows(batches):
        for batch in batches:
            tags, places, keys, docs = [], [], [], []
            for packed, tag, doc in zip(batch.column("packed").to_pylist(), batch.column("tag").to_pylist(),
                                        batch.column("low_doc").to_pylist(), strict=True):
                edges = [-1, *(k for k, b in enumerate(packed) if b == 0x20), len(packed)]
                for k in range(len(edges) - window):
                    tags.append(tag)
                    places.append(k)
                    docs.append(doc)
                    keys.append(hashlib.blake2b(packed[edges[k] + 1 : edges[k + window]], digest_size=16).digest())
            yield pa.record_batch({"tag": pa.array(tags, pa.binary()), "place": pa.array(places, pa.int32()),
                                   "key": pa.array(keys, pa.binary()), "doc": pa.array(docs, pa.int64())})

    return windows


def covered_runs(docs: DataFrame, window: int = 50, mer: int = 8) -> DataFrame:
    """(doc, print, runs): the runs [from, to) of words to remove, over ``keyed`` documents."""
    runs = written(docs.mapInArrow(_census(window, mer), "low bigint, doc bigint, print bigint, at int, n int"),
                   "super-kmers")
    shared = written(runs.groupBy("low").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
                     .where("a < b").select("low"), "shared-minimisers")
    travel = runs.join(shared, "low").groupBy("doc", "print").agg(
        F.collect_set(F.struct("low", "at", "n")).alias("runs"))
    packed = written(
        docs.join(travel, ["doc", "print"]).select("doc", "print", "text", "runs").mapInArrow(
            _pack(window), "low bigint, doc bigint, print bigint, at int, n int, packed binary")
        .withColumn("tag", F.unhex(F.md5("packed"))), "packed-super-kmers")
    # Equal strings meet; the same bucket may hold different ones.
    strings = written(packed.groupBy("low", "packed", "tag").agg(F.min("doc").alias("low_doc")), "bucket-strings")
    several = written(strings.groupBy("low").agg(F.count("*").alias("n")).where("n > 1").select("low"), "buckets")
    parts = written(strings.join(several, "low").select("packed", "tag", "low_doc").mapInArrow(
        _take_apart(window), "tag binary, place int, key binary, doc bigint"), "windows")
    firsts = written(parts.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                     .where("first < last").select("key", "first"), "first-documents")
    inner = parts.join(firsts, "key").where("doc > first").groupBy("tag").agg(
        F.sort_array(F.collect_set("place")).alias("places"))
    judged = written(strings.select("tag", "low_doc").join(inner, "tag", "left"), "judged-strings")
    # A string first seen in a smaller document is covered whole; else its windows that begin in smaller documents.
    covered = packed.select("tag", "doc", "print", "at", "n").join(judged, "tag").where(
        "doc > low_doc OR places IS NOT NULL")
    width = F.lit(window)
    whole = F.array(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("n") + width - 1).alias("to")))
    single = F.transform("places", lambda p: F.struct((F.col("at") + p).alias("from"),
                                                      (F.col("at") + p + width).alias("to")))
    spans = covered.select("doc", "print", F.when(F.col("doc") > F.col("low_doc"), whole).otherwise(single).alias("s"))
    return spans.groupBy("doc", "print").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("runs"))


def _cut(batches):
    for batch in batches:
        totals, removed, kept = [], [], []
        for text, runs in zip(as_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            words = _words(text)
            if runs:
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, [r["from"] for r in runs], 1)
                np.add.at(cover, [r["to"] for r in runs], -1)
                keep = np.cumsum(cover[:-1]) == 0
                left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            else:
                left = words
            totals.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.record_batch({"doc": batch.column("doc"), "n_words": pa.array(totals, pa.int64()),
                               "n_removed": pa.array(removed, pa.int64()),
                               "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                     mer: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (words joined by a space).

    A word goes if it lies in a window of ``window`` consecutive words whose words also begin somewhere in a
    document with a smaller id. A null text is empty; a null id counts as larger than all others; rows with
    the same id never remove each other's words; texts shorter than a window stay whole.
    """
    base = keyed(docs, id_col, text_col)
    runs = written(covered_runs(base, window, min(mer, window)), "covered-runs")
    cut = base.join(runs, ["doc", "print"], "left").select("doc", "text", "runs").mapInArrow(
        _cut, "doc bigint, n_words bigint, n_removed bigint, kept string")
    return cut.select(real_id().alias(id_col), "n_words", "n_removed", "kept")
