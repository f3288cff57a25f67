"""Graph operators over edges (src, dst, edge_type, weight, seq); an edge is unique per (src, dst, edge_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settled

DIRECTIONS = ("outgoing", "incoming", "both")


def oriented(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if direction == "outgoing":
        return edges
    turned = edges.withColumnsRenamed({"src": "_to", "dst": "_from"}).withColumnsRenamed({"_to": "dst", "_from": "src"}).select(*edges.columns)
    return turned if direction == "incoming" else edges.unionByName(turned)


def add_edges(edges: DataFrame, new: DataFrame, undirected: bool = False) -> DataFrame:
    """Upsert: the newest row (by seq) of each (src, dst, edge_type) stays. A missing type is '', a missing weight 1."""
    new = new.withColumn("edge_type", F.coalesce("edge_type", F.lit(""))).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    new = oriented(new, "both") if undirected else new
    rest = [c for c in edges.columns if c not in ("src", "dst", "edge_type")]
    newest = edges.unionByName(new.select(*edges.columns)).groupBy("src", "dst", "edge_type").agg(F.max_by(F.struct(*rest), "seq").alias("e"))
    return newest.select("src", "dst", "edge_type", *(F.col(f"e.{c}").alias(c) for c in rest)).select(*edges.columns)


def remove_edges(edges: DataFrame, pairs: DataFrame, undirected: bool = False) -> DataFrame:
    """Drop the edges of all types between each (src, dst)."""
    pairs = oriented(pairs.select("src", "dst"), "both") if undirected else pairs
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def edges_of(edges: DataFrame, node) -> DataFrame:
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def remove_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop the edges into and out of each (node)."""
    gone = nodes.select("node").distinct()
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def neighbors(edges: DataFrame, node, edge_type: str | None = None, direction: str = "outgoing") -> DataFrame:
    found = oriented(edges, direction).filter(F.col("src") == node)
    return found if edge_type is None else found.filter(F.col("edge_type") == edge_type)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def nodes(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    found = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return (found if isolated is None else found.unionByName(isolated.select("node"))).distinct()


def has_edge(edges: DataFrame, src, dst) -> bool:
    return not edges.filter((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def contains_node(edges: DataFrame, node, isolated: DataFrame | None = None) -> bool:
    inside = not edges_of(edges, node).isEmpty()
    return inside or (isolated is not None and not isolated.filter(F.col("node") == node).isEmpty())


def counts(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    return nodes(edges, isolated).agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))


def bfs(edges: DataFrame, start, max_depth: int, edge_types: list[str] | None = None, direction: str = "outgoing") -> DataFrame:
    """node, depth and the edge (parent, edge_type, weight) that first reached it, of all nodes within max_depth hops.

    The start has depth 0 and no edge; a start that no edge knows gives no rows. Of the edges that reach a node at its depth, the
    one of the smallest (parent, seq, edge_type) counts. Each hop is one join of the frontier with the edges and one anti-join with the
    nodes seen; a small frontier meets the edges where they are, a large one is materialised. The loop ends when a frontier is empty.
    """
    all_edges = oriented(edges, direction)
    known = edges_of(edges, start).select(F.lit(start).alias("node")).limit(1)
    kind = edges.schema["src"].dataType
    usable = all_edges.filter(F.col("edge_type").isin(edge_types)) if edge_types else all_edges
    frontier = known.select(
        F.col("node").cast(kind).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"),
        F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("double").alias("weight"),
    )
    frontier, empty = settled(frontier)
    seen = frontier
    for depth in range(1, max_depth + 1):
        if empty:
            break
        step = frontier.select(F.col("node").alias("src")).join(usable, "src")
        step = step.groupBy("dst").agg(F.min(F.struct("src", "seq", "edge_type", "weight")).alias("e"))
        step = step.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        step = step.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("e.src").alias("parent"), F.col("e.edge_type").alias("edge_type"), F.col("e.weight").alias("weight"))
        frontier, empty = settled(step)
        seen = seen.unionByName(frontier)
    return seen


def finalize(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Adjacency rows (node, part, links): the outgoing edges of each node in order of dst, type and seq, at most about `most` to a
    row, so a node of any degree is spread over rows and tasks. Written clustered by node, a neighbour look-up reads one file."""
    parts = edges.groupBy("src").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = edges.join(parts, "src").withColumn("part", F.pmod(F.xxhash64("dst", "edge_type"), F.col("parts")).cast("int"))
    link = F.struct("dst", "edge_type", "seq", "weight")
    return dealt.groupBy(F.col("src").alias("node"), "part").agg(F.sort_array(F.collect_list(link)).alias("links"))


def unfinalize(adjacency: DataFrame) -> DataFrame:
    """The edges of adjacency rows."""
    rows = adjacency.select(F.col("node").alias("src"), F.explode("links").alias("l"))
    return rows.select("src", "l.dst", "l.edge_type", "l.weight", "l.seq")


def paths(edges: DataFrame, start, most_hops: int, edge_type: str | None = None) -> DataFrame:
    """node and hops of what a walk of 1 to `most_hops` edges from the start can end on, as path patterns of a graph database have it: a
    type need only occur somewhere on the walk, and the start counts when a walk comes back to it. `hops` is the shortest such walk.

    States are a node and whether the type has occurred; each is visited once, at its fewest hops.
    """
    typed = edges.select("src", "dst", (F.lit(True) if edge_type is None else F.col("edge_type") == edge_type).alias("typed")).distinct()
    kind = edges.schema["src"].dataType
    begin = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(False).alias("seen"), F.lit(0).alias("hops"))
    frontier, reached = begin, None
    for hops in range(1, most_hops + 1):
        step = frontier.withColumnRenamed("node", "src").join(typed, "src").select(F.col("dst").alias("node"), (F.col("seen") | F.col("typed")).alias("seen")).distinct()
        if reached is not None:
            step = step.join(reached, ["node", "seen"], "left_anti")
        frontier, empty = settled(step.select("node", "seen", F.lit(hops).alias("hops")))
        if empty:
            break
        reached = frontier if reached is None else reached.unionByName(frontier)
    reached = begin.limit(0) if reached is None else reached
    return reached.filter("seen").groupBy("node").agg(F.min("hops").alias("hops"))
