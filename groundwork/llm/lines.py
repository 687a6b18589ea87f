"""Fuzzy line dedup by MinHash: signatures, banding, exact Jaccard similarity, distributed union-find.

A line's shingles are all runs of ten characters of it (a shorter line is one shingle). One 64-bit hash of each
shingle falls into one of 24 bins, and a bin's smallest value is one MinHash (one-permutation hashing, empty bins
filled from the next). Lines whose values agree in all four bins of one of ten bands are candidates. The bins of a line
of few shingles are no independent draws, so lines of fewer than ``SHORT`` different shingles have 48 independent hash
functions in twelve bands of four instead; lines of nearly so many have both, for no pair of similar lines is to stand
on two sides. A pair with Jaccard similarity 0.8 becomes a candidate with a probability of 0.998 if it is short and of
about 0.99 else, one with 0.1 hardly ever. Every candidate is
verified by exact Jaccard similarity over the shingles themselves, links go through a distributed union-find, and of
each component one line stays, the first. Before that, bitmaps refuse pairs that cannot be similar: every bit that
only one of two lines has set stands for at least one shingle that only it has.

Equal lines are one row before all this. No bucket puts out all of its pairs: its members are first compared with
two of them, and only what is still apart after a union-find is compared in full, tile by tile. Members of one large component have tiles of their own, which do not meet each
other; two tiles put out no more links than connect them.

Spark partitions, shuffles and joins; hashing and comparing shingles is array and set work over Arrow batches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm import minhash
from groundwork.llm.bloom import bloom_filter, may_hold
from groundwork.llm.common import as_bytes, ident, mix, real_id, small, written
from groundwork.llm.components import components

SHINGLE = 10
BINS = 24
# Bins of each band: the columns of a grid of four rows of six, and four of its diagonals.
BANDS = [[c + 6 * r for r in range(4)] for c in range(6)] + [[(c + r) % 6 + 6 * r for r in range(4)] for c in range(4)]
# Different shingles from which bins are used alone, and the lines that have both kinds of bands: a line that is similar
# to one of SHORT shingles has at least so many.
SHORT = 64
BOTH = SHORT * 4 // 5
SHORT_ROWS, SHORT_BANDS = 4, 12
SEEN = 1 << 10
BAND_COLUMNS = [f"band{j}" for j in range(len(BANDS) + SHORT_BANDS)]
# 64-bit words of a line's bitmap of shingles.
WORDS = 24
# Lines and characters of a bucket in one tile, as dealt by hash.
TILE = 512
TILE_CHARS = 1 << 21
# Shingles that are hashed, and bitmaps that are filled, at a time.
PART = 1 << 19
ROWS = 1 << 11

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(1 << 32)
_BY = minhash.factors(SHORT_ROWS * SHORT_BANDS)
KEY = pa.struct([("k1", pa.int64()), ("k2", pa.int64())])


def text_print(text_col: str) -> Column:
    """A hash of the text, which tells rows of one id, or of none, apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, print, at, line, k1, k2) for the lines that are not blank; k1 and k2 are 128 bits of hash."""
    work = docs.select(ident(id_col).alias("doc"), text_print(text_col).alias("print"),
                       F.col(f"`{text_col}`").cast("string").alias("body"))
    rows = work.select("doc", "print", F.posexplode(F.split("body", "\n", -1)).alias("at", "line"))
    rows = rows.select("doc", "print", "at", F.btrim("line", F.lit(" \t\r")).alias("line")).where("line <> ''")
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def as_texts(column) -> list[str]:
    return [t.decode("utf-8", "replace") for t in as_bytes(column)]


def shingle_count(line: str) -> int:
    return max(len(line) - SHINGLE + 1, 1)


def shingle_hashes(lines: list[str]):
    """Yields (numbers of lines, hashes), one element per shingle, some ``PART`` shingles at a time."""
    # A line too short for a shingle is padded to one.
    codes = np.frombuffer("".join([t.ljust(SHINGLE, "\0") for t in lines]).encode("utf-32-le", "replace"), np.uint32)
    counts = np.array([shingle_count(t) for t in lines], np.int64)
    ends = np.cumsum(counts + SHINGLE - 1)
    for k in range(0, len(codes), PART):
        part = codes[k : k + PART + SHINGLE - 1].astype(np.uint64)
        two = part[:-1] * _FACTOR + part[1:]
        four = two[:-2] * _FACTOR**2 + two[2:]
        eight = four[:-4] * _FACTOR**4 + four[4:]
        # The last two characters stand after the first eight.
        hashed = eight[:-2] * _FACTOR**2 + two[8:]
        place = np.arange(k, k + len(hashed))
        of = np.searchsorted(ends, place, side="right")
        real = place + SHINGLE <= ends[of]
        yield of[real], mix(hashed[real])


def band_keys(lines: list[str]) -> np.ndarray:
    """One row per line, one key per band; 0 for the bands that a line is too short or too long for."""
    least = np.full(len(lines) * BINS, _NONE)
    seen = np.zeros((len(lines), SEEN), bool)
    for of, hashed in shingle_hashes(lines):
        np.minimum.at(least, of * BINS + (hashed % np.uint64(BINS)).astype(np.int64), hashed >> np.uint64(32))
        seen[of, (hashed % np.uint64(SEEN)).astype(np.int64)] = True
    # So many different shingles at least; where that leaves it open they are counted.
    many = np.minimum(seen.sum(axis=1), SHORT)
    for k in np.flatnonzero(many < SHORT).tolist():
        many[k] = min(len(shingle_set(lines[k])), SHORT) if len(lines[k]) >= BOTH else many[k]
    short = np.flatnonzero(many < SHORT)
    own = np.full((len(lines), len(_BY)), np.uint64(2**64 - 1))
    for of, hashed in shingle_hashes([lines[k] for k in short.tolist()]):
        minhash.lower(own, short[of], hashed, _BY)
    least = least.reshape(-1, BINS)
    for _ in range(BINS - 1):
        if not (least == _NONE).any():
            break
        least = np.where(least == _NONE, np.roll(least, -1, axis=1), least)
    keys = np.empty((len(lines), len(BAND_COLUMNS)), np.uint64)
    for j, band in enumerate(BANDS):
        total = np.full(len(lines), j, np.uint64)
        for b in band:
            total = mix(total * _FACTOR + least[:, b])
        keys[:, j] = total
    keys[:, len(BANDS) :] = minhash.keys_of(own, SHORT_ROWS, len(BANDS))
    keys[many < BOTH, : len(BANDS)] = 0
    keys[many >= SHORT, len(BANDS) :] = 0
    return keys.view(np.int64)


def _signed(batches):
    for batch in small(batches, "line"):
        keys = band_keys(as_texts(batch.column("line")))
        yield pa.record_batch({"k1": batch.column("k1"), "k2": batch.column("k2"), "doc": batch.column("doc"),
                               **{c: pa.array(keys[:, j], mask=keys[:, j] == 0) for j, c in enumerate(BAND_COLUMNS)}})


def signatures(lines: DataFrame) -> DataFrame:
    """(k1, k2, doc, n, band0..): of each different line the first document, the occurrences, and the band keys."""
    kinds = ", ".join(f"{c} bigint" for c in ["k1", "k2", "doc", *BAND_COLUMNS])
    each = lines.select("k1", "k2", "doc", "line").mapInArrow(_signed, kinds)
    return each.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count("*").alias("n"),
                                        *[F.min(c).alias(c) for c in BAND_COLUMNS])


def bitmap_words(lines: list[str]) -> np.ndarray:
    """One row per line, in which each shingle sets one of 64 * WORDS bits."""
    marks = np.zeros((len(lines), 64 * WORDS), np.uint8)
    for of, hashed in shingle_hashes(lines):
        marks[of, (hashed % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(marks, axis=1, bitorder="little").view(np.int64)


def _mapped(batches):
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            texts = as_texts(batch.column("line"))
            words = bitmap_words(texts)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * WORDS
            yield pa.record_batch({
                "k1": batch.column("k1"), "k2": batch.column("k2"), "line": batch.column("line"),
                "size": pa.array([shingle_count(t) for t in texts], pa.int32()),
                "bits": pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel()))})


def with_bitmaps(texts: DataFrame) -> DataFrame:
    """(k1, k2, line, size, bits): how many shingles a line has room for, and a bit for each of them."""
    return texts.select("k1", "k2", "line").mapInArrow(
        _mapped, "k1 bigint, k2 bigint, line string, size int, bits array<bigint>")


def shingle_set(line: str) -> frozenset[str]:
    return frozenset([line[k : k + SHINGLE] for k in range(shingle_count(line))])


def _alike(one: frozenset[str], two: frozenset[str], least: float) -> bool:
    both = len(one & two)
    return both >= least * (len(one) + len(two) - both)


def _room(size_x: Column, size_y: Column, least: float) -> Column:
    """With S shingles in all and d in one line only, the similarity is (S - d) / (S + d): the largest d allowed."""
    return (size_x + size_y) * ((1 - least) / (1 + least)) + 1e-9


def possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) of k1 whose bitmaps do not rule that similarity out."""
    one = texts.select(F.col("k1").alias("x"), F.col("size").alias("size_x"), F.col("bits").alias("bits_x"))
    two = texts.select(F.col("k1").alias("y"), F.col("size").alias("size_y"), F.col("bits").alias("bits_y"))
    apart = sum((F.bit_count(F.col("bits_x")[w].bitwiseXOR(F.col("bits_y")[w])) for w in range(WORDS)), F.lit(0))
    room = _room(F.col("size_x"), F.col("size_y"), least)
    return pairs.join(one, "x").join(two, "y").where(apart <= room).select("x", "y").distinct()


def similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (k1 of one line, k1 of another) whose lines have at least that Jaccard similarity."""
    one = texts.select(F.col("k1").alias("x"), F.struct("k1", "k2").alias("a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("k1").alias("y"), F.struct("k1", "k2").alias("b"), F.col("line").alias("line_b"))

    def verified(batches):
        # A line that many others are compared with comes again and again.
        known = lru_cache(4)(shingle_set)
        for batch in small(batches, "line_a"):
            sides = zip(as_texts(batch.column("line_a")), as_texts(batch.column("line_b")), strict=True)
            same = pa.array([_alike(known(x), shingle_set(y), least) for x, y in sides], pa.bool_())
            yield batch.select(["a", "b"]).filter(same)

    node = "struct<k1: bigint, k2: bigint>"
    return pairs.join(two, "y").join(one, "x").select("a", "b", "line_a", "line_b").mapInArrow(
        verified, f"a {node}, b {node}")


def labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, k1, label) of the buckets whose members are in several components."""
    label = roots.select(F.col("node.k1").alias("k1"), F.col("root.k1").alias("label"))
    named = written(members.join(label, "k1", "left").select(
        "band", "k1", F.coalesce("label", "k1").alias("label")), "line-labels")
    mixed = named.groupBy("band").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count("*").alias("size"))
    return named.join(mixed.where("p < q AND size > 2").select("band"), "band")


def _forest(one: dict, two: dict | None, least: float) -> list[tuple[int, int]]:
    """Links of lines in different components, as positions in one tile or in two, one behind the other.

    Enough of them to connect all lines that are similar; components that lines had before count as connected.
    """
    columns = {c: (one[c] + two[c] if two else one[c]) for c in one}
    bits = np.array(columns["bits"], np.int64).reshape(-1, WORDS).view(np.uint64)
    size = np.array(columns["size"], np.float64)
    _, label = np.unique(np.array(columns["label"], np.int64), return_inverse=True)
    cut = len(one["line"]) if two else 0
    rows, others = np.arange(cut or len(size)), np.arange(cut, len(size))
    apart = np.zeros((len(rows), len(others)), np.uint16)
    for w in range(WORDS):
        apart += np.bitwise_count(bits[rows, w][:, None] ^ bits[others, w][None, :])
    maybe = apart <= (size[rows][:, None] + size[others][None, :]) * ((1 - least) / (1 + least)) + 1e-9
    maybe &= label[rows][:, None] != label[others][None, :]
    if not two:
        maybe = np.triu(maybe)
    root = np.arange(label.max() + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    known, found = lru_cache(TILE)(lambda k: shingle_set(columns["line"][k])), []
    for i in np.flatnonzero(maybe.any(axis=1)).tolist():
        for j in np.flatnonzero(maybe[i]).tolist():
            x, y = find(label[i]), find(label[j + cut])
            if x != y and _alike(known(i), known(j + cut), least):
                root[max(x, y)] = min(x, y)
                found.append((i, j + cut))
    return found


def links_apart(apart: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links between lines of one bucket in different components, enough to connect all that are similar.

    A component that fills a tile has tiles of its own, which never meet one another; other lines share tiles.
    """
    sized = apart.select("band", "k1", "label").join(
        texts.select("k1", "k2", "line", F.col("size").alias("room"), "bits"), "k1")
    sized = written(sized.withColumn("weight", F.greatest(
        F.lit(1 / TILE), F.length("line") / TILE_CHARS)), "lines-to-tile")
    own = sized.groupBy("band", "label").agg(F.sum("weight").alias("filled"))
    counted = written(own.select("band", "label", "filled", F.when(F.col("filled") >= 1, F.col("label")).alias("owner")),
                      "components-of-buckets")
    parts = written(counted.groupBy("band", "owner").agg(F.ceil(F.sum("filled")).cast("int").alias("tiles")), "tile-counts")
    plan = written(counted.alias("c").join(parts.alias("p"), (F.col("c.band") == F.col("p.band"))
                                           & F.col("c.owner").eqNullSafe(F.col("p.owner"))).select(
        "c.band", "c.label", "c.owner", "p.tiles"), "tile-plan")
    line = F.struct("k1", "k2", "label", F.col("room").alias("size"), "bits", "line")
    tile = F.pmod(F.xxhash64("k1"), F.col("tiles")).cast("int")
    tiles = written(sized.join(plan, ["band", "label"]).groupBy("band", "owner", tile.alias("tile")).agg(
        F.collect_list(line).alias("rows")), "line-tiles")
    names = written(tiles.select("band", "owner", "tile"), "tile-names")
    order = F.struct(F.col("owner").isNotNull(), F.coalesce("owner", F.lit(0)), "tile")
    left, right = [names.select("band", F.col("owner").alias(f"owner_{s}"), F.col("tile").alias(f"tile_{s}"),
                                order.alias(f"order_{s}")) for s in "lr"]
    met = left.join(right, "band").where("order_l <= order_r AND (owner_l IS NULL OR owner_r IS NULL OR owner_l <> owner_r)")
    for s in "lr":
        side = tiles.select(F.col("band").alias("b"), F.col("owner").alias("o"), F.col("tile").alias("t"), F.col("rows").alias(f"rows_{s}"))
        same = (met.band == side.b) & met[f"owner_{s}"].eqNullSafe(side.o) & (met[f"tile_{s}"] == side.t)
        met = met.join(side, same).drop("b", "o", "t")
    pairs = met.select((F.col("order_l") == F.col("order_r")).alias("same"), "rows_l", "rows_r")

    def linked(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for name in ("rows_l", "rows_r"):
                    rows = batch.column(name)[k].values
                    tile = {c: rows.field(c).to_pylist() for c in ("k1", "k2", "label", "size")}
                    tile |= {"line": as_texts(rows.field("line")), "bits": rows.field("bits").flatten().to_numpy().tolist()}
                    sides.append(tile)
                one, two = sides[0], None if batch.column("same")[k].as_py() else sides[1]
                keys = [{"k1": x, "k2": y} for tile in (sides if two else sides[:1])
                        for x, y in zip(tile["k1"], tile["k2"], strict=True)]
                found = _forest({c: one[c] for c in ("label", "size", "bits", "line")}, two, least)
                yield pa.record_batch({"a": pa.array([keys[i] for i, _ in found], KEY),
                                       "b": pa.array([keys[j] for _, j in found], KEY)})

    node = "struct<k1: bigint, k2: bigint>"
    return pairs.mapInArrow(linked, f"a {node}, b {node}")


def line_components(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """(k1, k2, root, doc, n): the lines that have a copy or a near copy, their component, its first document."""
    marks = written(signatures(lines), "line-signatures")
    bands = marks.select("k1", F.explode(F.array_compact(F.array(*BAND_COLUMNS))).alias("band"))
    buckets = written(bands.groupBy("band").agg(F.min("k1").alias("low"), F.count("*").alias("size"))
                      .where("size > 1").select("band", "low"), "line-buckets")
    members = written(bands.join(buckets, "band"), "line-members")
    wanted = written(members.select("k1").distinct(), "line-candidates")
    # Only the lines that are candidates travel: a filter of fixed size keeps most others where they are.
    bloom = written(bloom_filter(wanted, "k1"), "line-bloom")
    near = may_hold(lines.select("k1", "k2", "line"), bloom, "k1").where("bloom_hit").groupBy("k1", "k2", "line").agg(
        F.count("*").alias("n"))
    texts = written(with_bitmaps(near.join(wanted, "k1", "left_semi")), "candidate-lines")
    # Every member meets two of its bucket, the one with the smallest and the one with the largest hash.
    ends = members.join(members.groupBy("band").agg(F.max("k1").alias("high")), "band").where("k1 <> low")
    pivots = F.when(F.col("k1") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    met = ends.select(F.explode(pivots).alias("x"), F.col("k1").alias("y")).distinct()
    links = written(similar(possible(met, texts, least), texts, least), "line-links")
    roots = written(components(links, "line-components"), "line-roots")
    # What is then still apart within a bucket is compared in full.
    rest = written(links_apart(labelled(members, roots), texts, least), "line-links")
    roots = written(components(links.unionByName(rest), "line-components"), "line-roots")
    joined = marks.select(F.struct("k1", "k2").alias("node"), "doc", "n").join(roots, "node", "left")
    joined = written(joined.where("n > 1 OR root IS NOT NULL").select(
        "node", F.coalesce("root", "node").alias("root"), "doc"), "repeated-lines")
    firsts = written(joined.groupBy("root").agg(F.min("doc").alias("first")), "first-lines")
    return joined.join(firsts, "root").select("node.k1", "node.k2", "root", "first")


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(doc, print, removed): for each document the numbers of the lines that repeat an earlier one, sorted."""
    lines = line_rows(docs, id_col, text_col)
    repeated = written(line_components(lines, least), "line-decisions")
    seen = written(lines.select("doc", "print", "at", "k1", "k2").join(repeated, ["k1", "k2"]).select(
        "doc", "print", "at", "root", "first"), "repeated-places")
    # Among the rows with the first id the one with the smallest print comes first, and in it the first of its lines.
    own = seen.where("doc = first").withColumn("place", F.struct("print", "at"))
    stay = written(own.groupBy("root").agg(F.min("place").alias("stays")), "lines-that-stay")
    gone = seen.where("doc > first").select("doc", "print", "at").union(
        own.join(stay, "root").where("place > stays").select("doc", "print", "at"))
    return gone.groupBy("doc", "print").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def judge_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, removed (line numbers from 0, joined by commas).

    Of every component of equal or similar lines the one in the document with the smallest id stays, and in that
    document the first. Blank lines are never compared or removed; blanks at the ends of a line do not count. A null
    text has no line. Null ids come last. Rows that share an id, or have none, are documents of their own, in the order
    of a hash of their texts; rows equal in both id and text count as one document and get equal results.
    """
    gone = written(removed_lines(docs, id_col=id_col, text_col=text_col, least=least), "removed-lines")
    text = F.col(f"`{text_col}`").cast("string")
    count = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    rows = docs.select(ident(id_col).alias("doc"), text_print(text_col).alias("print"), count.alias("n_lines")).join(
        gone, ["doc", "print"], "left")
    mine = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select(real_id().alias(id_col), F.col("n_lines").cast("long").alias("n_lines"),
                       F.size(mine).cast("long").alias("n_removed"), F.array_join(mine.cast("array<string>"), ",").alias("removed"))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                           least: float = 0.8) -> DataFrame:
    """``docs``, all other columns as they are, with the repeated lines cut out of the text.

    A document of which no line that says something is left goes; one that was blank or null before stays as it is.
    Rows are told apart as in ``judge_lines``.
    """
    gone = written(removed_lines(docs, id_col=id_col, text_col=text_col, least=least), "removed-lines")
    gone = gone.select(F.col("doc").alias("__doc"), F.col("print").alias("__own"), F.col("removed").alias("__removed"))
    lines = F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains("__removed", at)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(f"`{text_col}`")).otherwise(left)
    same = (ident(id_col) == F.col("__doc")) & (text_print(text_col) == F.col("__own"))
    cut = docs.join(gone, same, "left").withColumn(text_col, text)
    return cut.where(F.col("__removed").isNull() | (F.btrim(text_col, F.lit(" \t\r\n")) != "")).select(
        *[F.col(f"`{c}`") for c in docs.columns])
