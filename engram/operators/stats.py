"""Statistics of records and of the derived indexes, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .connections import live_edges
from .filters import live
from .graph import nodes
from .tags import tag_postings


def system_stats(memories: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = live(memories).agg(
        F.count("*").alias("total_memories"),
        F.count_if(F.col("memory_type") == "short_term").alias("short_term"),
        F.count_if(F.col("memory_type") == "long_term").alias("long_term"),
        F.round(F.coalesce(F.avg("importance"), F.lit(0.0)), 6).alias("avg_importance"),
    )
    return kinds.crossJoin(live_edges(edges, memories).agg(F.count("*").alias("total_connections")))


def index_counts(memories: DataFrame, edges: DataFrame, vectors: DataFrame, timeline: DataFrame) -> DataFrame:
    postings = tag_postings(memories)
    parts = [
        vectors.agg(F.count("*").alias("vectors")),
        nodes(edges).agg(F.count("*").alias("nodes")),
        edges.agg(F.count("*").alias("edges")),
        timeline.agg(F.count("*").alias("time_entries")),
        postings.agg(F.countDistinct("key").alias("tag_docs"), F.countDistinct("token").alias("tokens")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out
