"""Rank fusion of scored lists (key, score), each with a source name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
# Weights of weighted fusion by source; other sources weigh 1.
WEIGHTS = {"vector": 1.0, "tag": 1.0, "graph": 0.5}


def concat(lists: dict[str, DataFrame]) -> DataFrame:
    """source, key and score of all lists, without merging."""
    parts = [df.select(F.lit(name).alias("source"), "key", "score") for name, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def ranked(lists: dict[str, DataFrame]) -> DataFrame:
    """The same with the place of each row in its list, from 1: by score, ties by key. The lists are bounded by their limits."""
    place = Window.partitionBy("source").orderBy(F.desc("score"), "key")
    return concat(lists).withColumn("rank", F.row_number().over(place))


def _attributed(merged: DataFrame, limit: int | None) -> DataFrame:
    """hybrid for keys of several sources."""
    named = merged.withColumn("source", F.when(F.size("sources") > 1, F.lit("hybrid")).otherwise(F.get("sources", F.lit(0)))).drop("sources")
    ordered = named.orderBy(F.desc("score"), "key")
    return ordered if limit is None else ordered.limit(limit)


def _sources():
    return F.collect_set("source").alias("sources")


def rrf(lists: dict[str, DataFrame], limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """key, score = sum of 1 / (k + rank), best original score, and source."""
    merged = ranked(lists).groupBy("key").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.max("score").alias("best_score"), _sources())
    return _attributed(merged.withColumn("score", F.round("score", 9)), limit)


def max_normalized(scored: DataFrame) -> DataFrame:
    """Scores over their maximum; unchanged if that is not above 0."""
    top = F.max("score").over(Window.partitionBy("source"))
    return scored.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def min_max_normalized(scored: DataFrame) -> DataFrame:
    """Scores from 0 to 1 in each source; a constant list becomes 1."""
    low, high = (f("score").over(Window.partitionBy("source")) for f in (F.min, F.max))
    return scored.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def weighted(lists: dict[str, DataFrame], limit: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the normalised scores over the sources that have the key."""
    used = WEIGHTS | (weights or {})
    w = F.lit(1.0)
    for name, value in used.items():
        w = F.when(F.col("source") == name, F.lit(float(value))).otherwise(w)
    rows = min_max_normalized(concat(lists)).withColumn("w", w)
    merged = rows.groupBy("key").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"), _sources())
    return _attributed(merged.withColumn("score", F.round("score", 9)), limit)


def intersection(lists: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Keys of all lists, with their mean score."""
    merged = concat(lists).groupBy("key").agg(F.avg("score").alias("score"), _sources()).filter(F.size("sources") == len(lists))
    return _attributed(merged.withColumn("score", F.round("score", 9)), limit)


def union(lists: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Keys of any list, with their largest score."""
    return _attributed(concat(lists).groupBy("key").agg(F.max("score").alias("score"), _sources()), limit)
