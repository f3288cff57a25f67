"""Record filters. All bounds are inclusive."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.col("archived"))


def has_all(tags: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(True)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def record_filter(memory_type: str | None = None, min_importance: float | None = None, max_importance: float | None = None, created_after: int | None = None, created_before: int | None = None, tags: list[str] | None = None) -> Column:
    """The AND of the conditions that are given; tags match exactly and all must be there."""
    conditions = []
    if memory_type is not None:
        conditions.append(F.col("memory_type") == memory_type)
    if min_importance is not None:
        conditions.append(F.col("importance") >= min_importance)
    if max_importance is not None:
        conditions.append(F.col("importance") <= max_importance)
    if created_after is not None:
        conditions.append(F.col("created_at") >= created_after)
    if created_before is not None:
        conditions.append(F.col("created_at") <= created_before)
    if tags:
        conditions.append(has_all(F.col("tags"), tags))
    return conjunction(conditions)


def conjunction(conditions: Iterable[Column]) -> Column:
    """No condition passes all rows."""
    return reduce(and_, conditions, F.lit(True))


def has_tags(tags: list[str], column: str = "index_tags") -> Column:
    return has_all(F.col(column), tags)


def has_any_tag(tags: list[str], column: str = "index_tags") -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags))) if tags else F.lit(False)


def time_range(start: int, end: int, column: str = "created_at") -> Column:
    """Rows without a time pass."""
    return F.col(column).isNull() | F.col(column).between(start, end)


def key_prefix(prefix: str, column: str = "id") -> Column:
    return F.col(column).cast("string").startswith(prefix)


def metadata_equals(key: str, value: str, column: str = "metadata") -> Column:
    return F.coalesce(F.col(column)[key] == value, F.lit(False))


def related_to(rows: DataFrame, reached: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key a traversal (node, ...) reached; the start node counts."""
    return rows.join(reached.select(F.col("node").alias(key)).distinct(), key, "left_semi")


def existing(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, found): whether each of some ids has a live record."""
    there = live(memories).select("id").distinct().withColumn("_there", F.lit(True))
    return ids.select("id").distinct().join(there, "id", "left").select("id", F.col("_there").isNotNull().alias("found"))
