"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming distance, components.

Two fingerprints that differ in at most two bits agree on at least two of four 16-bit blocks, so close pairs
share one of six keys made of two blocks. Equal fingerprints are one row before that. A bucket of more than
``BUCKET`` fingerprints is split once more: outside the two shared blocks, the differing bits lie in two of
eight 4-bit blocks, so the members get 28 longer keys each, and a bucket of those can hold no more than 256
fingerprints. Inside a bucket, which so is always small, the distance of every pair is checked and only a
spanning forest of the links leaves it: no group ever puts out all of its pairs, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import SPACE, as_bytes, ident, real_id, word_spans, written
from groundwork.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUCKET = 256
# Shingles hashed before their bits are counted.
PART = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    low = text.translate(LOWER)
    starts, ends = word_spans(np.frombuffer(low, np.uint8), SPACE)
    n = len(starts)
    if not n:
        return 0
    line = b" ".join([low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    size = min(shingle, n)
    froms, tos = begin[: n - size + 1].tolist(), (begin[size:] - 1).tolist()
    counts, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(froms), PART):
        part = np.array([hashed(line[a:b], 42) for a, b in zip(froms[k : k + PART], tos[k : k + PART], strict=True)],
                        np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(froms)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, also: list[str] = ()) -> DataFrame:
    """(doc, fp) and the columns ``also``: fingerprints as signed 64-bit numbers."""
    def made(batches):
        for batch in batches:
            marks = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.record_batch({"doc": batch.column("doc"), "fp": marks.view(np.int64),
                                   **{c: batch.column(c) for c in also}})

    work = docs.select(ident(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), *also)
    return work.mapInArrow(made, ", ".join(["doc bigint", "fp bigint", *[f"{c} {k}" for c, k in docs.select(*also).dtypes]]))


def _masked(column, masks: list[int]):
    """An array of (which mask, the bits under it)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(k).alias("k"), column.bitwiseAND(F.lit(m)).alias("bits"))
                     for k, m in enumerate(signed)])


def _forest(distance: int):
    """Links of every bucket as a spanning forest: smallest reachable fingerprint for each member."""
    def linked(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                marks = np.array(sorted(members), np.int64)
                bits = marks.view(np.uint64)
                close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
                root = np.arange(len(marks))
                while True:
                    low = np.where(close, root[None, :], len(marks)).min(axis=1)
                    if (low == root).all():
                        break
                    root = low
                moved = root < np.arange(len(marks))
                a += marks[root[moved]].tolist()
                b += marks[moved].tolist()
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


def links(marks: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` to connect all that are close."""
    if distance > 2:
        raise ValueError("the blocks are cut for at most two differing bits")
    halves = [sum(0xFFFF << (16 * k) for k in pair) for pair in combinations(range(4), 2)]
    keys = marks.select("fp", F.explode(_masked(F.col("fp"), halves)).alias("key")).select("fp", "key.*")
    sizes = written(keys.groupBy("k", "bits").agg(F.count("*").alias("size")).where("size > 1"), "blocks")
    shared = written(keys.join(sizes, ["k", "bits"]), "shared-blocks")
    small = shared.where(F.col("size") <= BUCKET).groupBy("k", "bits").agg(F.collect_list("fp").alias("members"))
    fine = None
    for k, half in enumerate(halves):
        rest = [m for m in (0xF << (4 * i) for i in range(16)) if not half & m]
        masks = [(1 << 64) - 1 - a - b for a, b in combinations(rest, 2)]
        part = shared.where((F.col("k") == k) & (F.col("size") > BUCKET)).select(
            "fp", F.explode(_masked(F.col("fp"), masks)).alias("key")).select(
            "fp", (F.col("key.k") + 100 * (k + 1)).alias("k"), "key.bits")
        fine = part if fine is None else fine.union(part)
    fine = fine.groupBy("k", "bits").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return small.select("members").union(fine.select("members")).mapInArrow(_forest(distance), "a bigint, b bigint")


def _rooted(found: DataFrame, distance: int) -> DataFrame:
    """(fp, first, root) of each fingerprint: the smallest id that has it, the smallest fingerprint it can reach."""
    marks = written(found.groupBy("fp").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    roots = written(components(links(marks, distance), "fingerprint-links"), "fingerprint-roots")
    return written(marks.join(roots, marks.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 2, also: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id, the columns ``also``.

    component_id is the smallest id reachable over links of at most ``distance`` differing bits. Texts without
    words, null texts among them, have fingerprint zero and are linked like any other. Null ids are larger than
    all others and come back as null, so component_id does not tell components without an id apart; repeated rows
    are repeated.
    """
    found = written(fingerprints(docs, id_col, text_col, shingle, also), "fingerprints")
    joined = _rooted(found, distance)
    lowest = written(joined.groupBy("root").agg(F.min("first").alias("component")), "components")
    named = written(joined.join(lowest, "root").select("fp", "component"), "named-fingerprints")
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(named, "fp").select(real_id().alias(id_col), hex_digits.alias("fingerprint"),
                                          real_id("component").alias("component_id"), *also)


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                            distance: int = 2) -> DataFrame:
    """One row of ``docs``, all columns as they are, for each component: the one with the smallest id.

    Components are those of the links, whatever ids their rows have: rows without an id, or with one id, whose texts
    are not linked all stay. Of rows with that same id the one with the smallest hash of its text stays; rows equal
    in both are one.
    """
    marked = docs.withColumn("__doc", ident(id_col)).withColumn(
        "__print", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    work = marked.select("__doc", "__print", F.col(f"`{text_col}`").alias("__text"))
    found = written(fingerprints(work, "__doc", "__text", shingle, ["__print"]), "fingerprints")
    first = found.groupBy("fp").agg(F.min(F.struct("doc", "__print")).alias("stays"))
    stay = first.join(_rooted(found, distance), "fp").groupBy("root").agg(F.min("stays").alias("stays"))
    stay = written(stay.select(F.col("stays.doc").alias("__stay_doc"), F.col("stays.__print").alias("__stay_print")),
                   "one-of-each")
    kept = marked.join(stay, (F.col("__doc") == F.col("__stay_doc")) & (F.col("__print") == F.col("__stay_print")))
    return kept.dropDuplicates(["__doc", "__print"]).select(*[F.col(f"`{c}`") for c in docs.columns])
