"""State as a fold over an append-only log: rows (key, seq, op, payload), op `put` or `delete`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changelog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest row of each key with its op, deletions included. Partial aggregation keeps one row per key and task."""
    keys = keys or ["key"]
    rest = [c for c in changelog.columns if c not in (*keys, "seq", "op")]
    # Of equal seq a put comes after a delete, and the larger payload last, so a repeated fold gives the same state.
    order = F.struct("seq", "op", *(F.col(c) for c in rest))
    last = changelog.groupBy(*keys).agg(F.max(order).alias("r"))
    return last.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in changelog.columns))


def live_rows(changes: DataFrame) -> DataFrame:
    """The newest rows (of `latest` or `merge`) without deletions and op."""
    return changes.filter(F.col("op") != "delete").drop("op")


def fold(changelog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The state: the newest row of each key, by seq, unless it deletes it."""
    keys = keys or ["key"]
    state = live_rows(latest(changelog, keys))
    return state.select(*keys, "seq", *(c for c in state.columns if c not in (*keys, "seq")))


def merge(*levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Levels of changes, each (keys, seq, op, payload...), as one: the newest row of each key. An older change never overwrites
    a newer one, whatever level it is in, and a deletion stays as a row, so an older put that comes later finds it; read with `live_rows`."""
    return latest(reduce(DataFrame.unionByName, levels), keys)


def puts(rows: DataFrame, seq, keys: list[str]) -> DataFrame:
    """A state as changes."""
    return rows.withColumn("seq", seq).withColumn("op", F.lit("put")).select(*keys, "seq", "op", *(c for c in rows.columns if c not in keys))


def deletes(keyed: DataFrame, seq, keys: list[str], like: DataFrame) -> DataFrame:
    """Deletions of keys, in the columns of a changelog."""
    rows = keyed.select(*keys).distinct().withColumn("seq", seq).withColumn("op", F.lit("delete"))
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def get(key, *levels: DataFrame) -> DataFrame:
    """The live row of a key over several levels; the filter reaches each level's scan."""
    return fold(reduce(DataFrame.unionByName, (level.filter(F.col("key") == key) for level in levels)))


def ordered(changelog: DataFrame, after: int | None = None) -> DataFrame:
    """The changes in order of seq, from those after one on."""
    rows = changelog if after is None else changelog.filter(F.col("seq") > after)
    return rows.orderBy("seq", "key", "op")


def trim(changelog: DataFrame, seq: int) -> DataFrame:
    """What a checkpoint up to `seq` leaves of the log."""
    return changelog.filter(F.col("seq") > seq)
