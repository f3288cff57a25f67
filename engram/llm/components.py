"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _with_lowest(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with the m that low (u, m, c) has for u, of which there are c.

    Nodes with more than a thousandth of all links, of which there are 2000 at most, are broadcast: their links stay where they are.
    """
    most = max(100, total // 1000)
    hot = low.filter(F.col("c") > most).select("u", "m")
    if hot.isEmpty():
        return edges.join(low.drop("c"), "u")
    cold = edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(low.filter(F.col("c") <= most).drop("c"), "u")
    return edges.join(F.broadcast(hot), "u").unionByName(cold)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(u, v): each node that has an edge to another, and the smallest node of its component (also for that node itself).

    Edges of (u, v) may come in any direction and repeat. Each round replaces a node's links by links to the smallest node it sees,
    so the number of links never grows and the number of rounds is logarithmic. A node with many links takes part in
    aggregations, which count and compare before they shuffle, and in joins that leave its links where they are. Edges with a null end,
    and from a node to itself, are ignored; no edges give no rows.
    """
    state = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _summary(state)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("c"))
        large = _with_lowest(both.filter("v > u"), low, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _with_lowest(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), before[0])
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        state = cut(small.filter("u <> v").distinct())
        if (now := _summary(state)) == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select("v").distinct().select(F.col("v").alias("u"), "v")
    return state.select("u", "v").unionByName(roots)
