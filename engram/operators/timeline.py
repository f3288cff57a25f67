"""Time index operators over (key, ts), one time per key. Ties are ordered by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The most rows of a ranked list: one partition ranks them.
MAX_LIMIT = 10_000


def upsert(timeline: DataFrame, changes: DataFrame) -> DataFrame:
    """A key that comes again moves to its new time."""
    return timeline.join(changes.select("key"), "key", "left_anti").unionByName(changes.select("key", "ts"))


def remove(timeline: DataFrame, keys: DataFrame) -> DataFrame:
    return timeline.join(keys.select("key"), "key", "left_anti")


def between(timeline: DataFrame, start: int, end: int, limit: int | None = None) -> DataFrame:
    """Inclusive at both ends, ascending."""
    rows = timeline.filter(F.col("ts").between(start, end)).orderBy("ts", "key")
    return rows if limit is None else rows.limit(limit)


def before(timeline: DataFrame, ts: int, n: int) -> DataFrame:
    return timeline.filter(F.col("ts") < ts).orderBy(F.desc("ts"), "key").limit(n)


def after(timeline: DataFrame, ts: int, n: int) -> DataFrame:
    return timeline.filter(F.col("ts") > ts).orderBy("ts", "key").limit(n)


def latest(timeline: DataFrame, n: int) -> DataFrame:
    return timeline.orderBy(F.desc("ts"), "key").limit(n)


def oldest(timeline: DataFrame, n: int) -> DataFrame:
    return timeline.orderBy("ts", "key").limit(n)


def at(timeline: DataFrame, ts: int) -> DataFrame:
    return timeline.filter(F.col("ts") == ts).select("key")


def timestamp_of(timeline: DataFrame, key) -> DataFrame:
    return timeline.filter(F.col("key") == key).select("ts")


def bounds(timeline: DataFrame) -> DataFrame:
    """One row: first and last time (null if empty), distinct times, entries."""
    return timeline.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.countDistinct("ts").alias("distinct_ts"), F.count("*").alias("entries"))


def scan(timeline: DataFrame, start: int, end: int, limit: int, descending: bool = False, legacy_order: bool = False) -> DataFrame:
    """Ranked source of at most `limit` rows with recency score 1 / position.

    Descending takes the newest rows; with `legacy_order` it takes the oldest ones and reverses them.
    """
    limit = min(limit, MAX_LIMIT)
    rows = timeline.filter(F.col("ts").between(start, end))
    newest = descending and not legacy_order
    rows = rows.orderBy(F.desc("ts") if newest else F.asc("ts"), "key").limit(limit)
    order = F.desc("ts") if descending else F.asc("ts")
    # At most `limit` rows are left, so one partition ranks them.
    place = F.row_number().over(Window.orderBy(order, "key"))
    return rows.select("key", "ts", (F.lit(1.0) / place).alias("score"), place.alias("rank"))
