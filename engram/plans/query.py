"""Query objects and their plan: each part becomes a ranked branch, several branches are fused."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, search, tags, timeline
from ..operators.ann import ClusteredIndex
from ..operators.filters import conjunction
from ..sources.fixtures import Tables

MERGES = ("rrf", "weighted", "intersection", "union")


@dataclass(frozen=True)
class VectorQuery:
    vector: Sequence[float]
    k: int = 10
    ef: int | None = None  # how much an approximate index looks at; an exact search ignores it
    filters: tuple[Column, ...] = ()


@dataclass(frozen=True)
class GraphQuery:
    start: Any
    max_depth: int = 1
    edge_types: tuple[str, ...] = ()
    direction: str = "outgoing"
    limit: int = 10


@dataclass(frozen=True)
class TimeRangeQuery:
    start: int
    end: int
    limit: int = 10
    descending: bool = False
    legacy_order: bool = False


@dataclass(frozen=True)
class TagQuery:
    tags: tuple[str, ...]
    match_all: bool = False
    limit: int = 10


@dataclass(frozen=True)
class HybridQuery:
    """At least one part; a time range is a ranked source like the others, not a filter."""

    vector: VectorQuery | None = None
    tag: TagQuery | None = None
    graph: GraphQuery | None = None
    time_range: TimeRangeQuery | None = None
    merge: str = "rrf"
    limit: int = 10
    rrf_k: int = fusion.RRF_K
    weights: dict[str, float] = field(default_factory=dict)


Query = VectorQuery | GraphQuery | TimeRangeQuery | TagQuery | HybridQuery


def branch(tables: Tables, query: Query, index: ClusteredIndex | None = None) -> tuple[str, DataFrame]:
    """The source name and the ranked list (key, score) of a simple query. A vector query without filters uses the index, if there is one."""
    match query:
        case VectorQuery():
            vectors = tables.vectors
            if query.filters:
                ids = tables.memories.filter(conjunction(query.filters)).select("id")
                vectors = vectors.join(ids, "id", "left_semi")
            elif index is not None:
                found = index.search(query.vector, query.k, query.ef)
                return "vector", found.select(F.col("id").alias("key"), "score")
            return "vector", search.vector_branch(vectors, query.vector, query.k)
        case GraphQuery():
            return "graph", search.graph_branch(tables.edges, query.start, query.max_depth, query.limit, list(query.edge_types), query.direction)
        case TimeRangeQuery():
            rows = timeline.scan(tables.timeline, query.start, query.end, query.limit, query.descending, query.legacy_order)
            return "time", rows.select("key", "score")
        case TagQuery():
            return "tag", tags.tag_step(tags.tag_postings(tables.memories), list(query.tags), query.match_all, query.limit).select("key", "score")
    raise TypeError(f"no branch for {type(query).__name__}")


def execute(tables: Tables, query: Query, index: ClusteredIndex | None = None) -> DataFrame:
    """key, score and source, best first. One part alone is not merged."""
    if not isinstance(query, HybridQuery):
        source, rows = branch(tables, query, index)
        return rows.withColumn("source", F.lit(source)).orderBy(F.desc("score"), "key")
    parts = [p for p in (query.vector, query.tag, query.graph, query.time_range) if p is not None]
    if not parts:
        raise ValueError("a hybrid query needs a part")
    if query.merge not in MERGES:
        raise ValueError(f"merge must be one of {MERGES}")
    lists = dict(branch(tables, p, index) for p in parts)
    if len(lists) == 1:
        ((source, rows),) = lists.items()
        return rows.withColumn("source", F.lit(source)).orderBy(F.desc("score"), "key").limit(query.limit)
    if query.merge == "rrf":
        out = fusion.rrf(lists, query.limit, query.rrf_k)
    elif query.merge == "weighted":
        out = fusion.weighted(lists, query.limit, query.weights)
    else:
        out = {"intersection": fusion.intersection, "union": fusion.union}[query.merge](lists, query.limit)
    return out.select("key", "score", "source")
