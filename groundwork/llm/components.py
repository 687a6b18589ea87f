"""Connected components by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import written


def _print(edges: DataFrame) -> tuple:
    """The number of edges and 128 bits of hash over them, whatever their order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))).first())


def _with_lowest(rows: DataFrame, key: str, lowest: DataFrame, edges: int) -> DataFrame:
    """``rows`` (a, b) with ``low`` of the node in ``key``.

    ``lowest`` (key, low, degree) sums up at most ``2 * edges`` rows, so at most 2,000 nodes have a degree over
    ``edges / 1000``: theirs is sent to all tasks, and no such node's rows meet in one.
    """
    most = max(64, edges // 1000)
    hot = lowest.where(F.col("degree") > most).select(key, F.col("low").alias("hot_low"))
    marked = rows.join(F.broadcast(hot), key, "left")
    calm = marked.where("hot_low IS NULL").join(lowest.where(F.col("degree") <= most), key).select("a", "b", "low")
    return calm.union(marked.where("hot_low IS NOT NULL").select("a", "b", "hot_low"))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node it can reach.

    Every round each node hooks to the smallest parent among its neighbours and then halves its path
    (large-star, small-star), so long chains shrink fast. A hub never gathers its neighbours in one
    task: minima combine before the shuffle, and the minima of hubs go to their neighbours instead.
    Rounds go on until nothing changes. Null nodes and loops are ignored.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = written(edges, purpose)
    before = _print(edges)
    while True:
        # Large star: the larger neighbours of a node go to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("degree"))
        large = written(_with_lowest(both.where("b > a"), "a", low, before[0]).select(F.col("low").alias("a"), "b")
                        .where("a < b").distinct(), purpose)
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("degree"))
        large = _with_lowest(large, "b", low, before[0])
        edges = written(
            large.select(F.col("low").alias("a"), "b").union(large.select(F.col("low"), F.col("a")))
            .where("a < b").distinct(), purpose)
        after = _print(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select("a", "a").distinct())
