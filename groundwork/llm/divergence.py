"""Source divergence audit: which sources of a language use words unlike each other, and which words those are.

Every document becomes a sparse vector of term counts, the vectors of a (language, source) group are summed inside
the tasks, and the sums are merged by term, as a count vectorizer with a minimum document frequency and no limit on the
vocabulary and a vector summarizer would give them. The vocabulary stays a table: nothing bounds it, so it never
becomes an array of the driver. Pairs of sources are then compared cell by cell, a cell being some sources by some
terms, and only where one of the two has the term; terms that both lack all add the same, so they are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import slices, written

# Terms are runs of ASCII letters and of everything beyond ASCII; A-Z count as a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Entries that a task sums before it hands them on, and bytes of one text that it splits at a time.
HELD, PIECE = 200_000, 1 << 20
# Sources and terms of a cell, about.
SOURCES, TERMS = 256, 2048


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end at spaces."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b" ", at, at + size)
        if end <= at:
            end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def term_counts(text: bytes) -> Counter:
    """The sparse vector of a document."""
    counts = Counter()
    for piece in pieces(text.translate(FOLD)):
        counts.update(piece.split())
    return counts


def _sums(held: dict) -> pa.RecordBatch:
    columns = [[], [], [], [], []]
    for (lang, source), (df, n) in held.items():
        columns[0] += [lang] * len(n)
        columns[1] += [source] * len(n)
        columns[2] += n.keys()
        columns[3] += [df[t] for t in n]
        columns[4] += n.values()
    terms = pa.array([None if t == b"" else t for t in columns[2]], pa.binary()).cast(pa.string())
    return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), terms,
                            pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                           names=["lang", "source", "term", "df", "n"])


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each group, and one row with a null term for the group itself."""
    held, size = {}, 0
    for batch in batches:
        for part in slices(batch, 2):
            langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, part.column(2).cast("binary").to_pylist()):
                if (lang, source) not in held:
                    held[lang, source] = Counter({b"": 1}), Counter({b"": 0})
                    size += 1
                df, n = held[lang, source]
                counts, before = term_counts(text), len(n)
                n.update(counts)
                df.update(counts.keys())
                size += len(n) - before
                if size > HELD:
                    yield _sums(held)
                    held, size = {}, 0
    if held:
        yield _sums(held)


def _share(count: Column, total: Column, size: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + size)); null where nothing is counted."""
    high = F.lit(scale).cast("decimal(19,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", high, F.nullif(total + size, F.lit(0)).cast("decimal(19,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of a cell for each ordered pair of its sources, and the number of terms that either has.

    Every source of the cell has a row without a term, its terms have one each.
    """
    group, part, p, zero = (table.column(c).to_numpy() for c in ("gid", "part", "p", "p_none"))
    term = pc.fill_null(table.column("term_id"), -1).to_numpy()
    order = np.lexsort((term, group))
    group, part, term, p, zero = group[order], part[order], term[order], p[order], zero[order]
    terms, place = np.unique(term, return_inverse=True)
    low, high = (k.as_py() for k in key[-2:])

    def side(rows: np.ndarray) -> tuple:
        """Sources, their share of a term they lack, the edges of their entries, and place and share of each entry."""
        heads = rows[term[rows] < 0]
        entries = rows[term[rows] >= 0]
        edges = np.append(np.searchsorted(entries, heads), len(entries))
        return group[heads], zero[heads], edges, place[entries], p[entries]

    def summed(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[edges[1:]] - total[edges[:-1]]

    sides = {k: side(np.flatnonzero(part == k)) for k in {low, high}}
    out = [], [], [], []
    for one, other in {(low, high), (high, low)}:
        ids, none, edges, at, mine = sides[one]
        their_ids, their_none, their_edges, their_at, theirs = sides[other]
        dense = np.repeat(their_none[:, None], len(terms), axis=1)
        dense[np.repeat(np.arange(len(their_ids)), np.diff(their_edges)), their_at] = theirs
        for k, (begin, end) in enumerate(zip(edges, edges[1:])):
            q = dense[:, at[begin:end]]
            has = np.zeros(len(terms), bool)
            has[at[begin:end]] = True
            alone = ~has[their_at]
            value = ((mine[None, begin:end] - q) ** 2 // q).sum(axis=1) + summed(
                np.where(alone, (none[k] - theirs) ** 2 // theirs, 0), their_edges)
            met = summed(alone.astype(np.int64), their_edges) + (end - begin)
            keep = their_ids != ids[k]
            for column, found in zip(out, (np.full(keep.sum(), ids[k]), their_ids[keep], value[keep], met[keep])):
                column.append(found)
    columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
    return pa.table(columns, names=["gid", "other", "value", "met"])


def audit(docs: DataFrame, *, by: str = "lang", group: str = "source", text_col: str = "text", min_df: int = 3,
          scale: int = 10**9, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and by which words.

    Each language keeps the terms that at least ``min_df`` of its documents (rows) hold. A share is p = 1 +
    floor(scale * (count + 1) / (all counts + kept terms)), the distance of two shares floor((p - q)**2 / q), in
    whole numbers throughout. ``pair`` rows rank all other sources of the language by the distance summed over all
    kept terms, ``term`` rows the ``top`` kept terms that the source uses more than the language does. Ties rank by
    item. Null language, source and text are empty; a group without terms still has its ``pair`` rows; repeated rows
    are documents each; long texts are split piece by piece; other columns are not read; an empty table gives no row.
    Counts up to about 9 * 10**18 / ``scale`` squared stay exact; sums of distances must fit a long.
    """
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (by, group, text_col)]
    sums = docs.select(text[0].alias("lang"), text[1].alias("source"), text[2].alias("text")).mapInArrow(
        _group_sums, "lang string, source string, term string, df long, n long")
    # One shuffle: whatever follows up to the vocabulary stays inside (language, term).
    of_term = Window.partitionBy("lang", "term")
    counts = sums.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    counts = counts.withColumn("row", F.monotonically_increasing_id()).select(
        "lang", "term", "source", "n", "row", F.sum("df").over(of_term).alias("df"), F.sum("n").over(of_term).alias("lang_n"),
        F.min("row").over(of_term).alias("term_id"))
    kept = written(counts.where((F.col("df") >= min_df) | F.col("term").isNull()), "divergence-counts")
    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count_if(F.col("term").isNotNull() & (F.col("row") == F.col("term_id"))).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("size"),
                                       F.count("*").alias("sources"))
    groups = written(groups.join(langs, "lang").withColumn("gid", F.monotonically_increasing_id()).withColumn(
        "p_none", F.coalesce(_share(F.lit(0), F.col("total"), F.col("size"), scale), F.lit(1))), "divergence-groups")

    used = kept.where("term IS NOT NULL").join(groups, ["lang", "source"]).withColumn(
        "p", _share(F.col("n"), F.col("total"), F.col("size"), scale))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("size"), scale)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = used.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # Rows of a cell: each entry, and each source once more, as it may have none there.
    blocks = F.ceil(F.col("size") / TERMS).cast("long")
    entries = used.select("lang", F.pmod(F.xxhash64("term_id"), blocks).alias("block"), "gid", "term_id", "p", "p_none", "sources")
    heads = groups.where("size > 0").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "gid",
        F.lit(None).cast("long").alias("term_id"), F.lit(0).cast("long").alias("p"), "p_none", "sources")
    parts = F.ceil(F.col("sources") / SOURCES).cast("int")
    cells = entries.unionByName(heads).select(
        "lang", "block", "gid", "term_id", "p", "p_none", F.pmod(F.xxhash64("gid"), parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    cells = cells.withColumn("low", F.least("part", "with")).withColumn("high", F.greatest("part", "with")).drop("with")
    met = cells.groupBy("lang", "block", "low", "high").applyInArrow(_cell, "gid long, other long, value long, met long")
    met = met.groupBy("gid", "other").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    mine = groups.select("lang", "source", "gid", "size", "p_none")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"), F.col("p_none").alias("q_none"))
    pairs = mine.join(theirs, "lang").where("gid <> other").join(met, ["gid", "other"], "left")
    both_none = (F.col("size") - F.coalesce("met", F.lit(0))) * _apart(F.col("p_none"), F.col("q_none"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                         (F.coalesce("value", F.lit(0)) + both_none).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(words)
