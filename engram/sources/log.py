"""The append-only log as files: one folder a segment, committed by a small file that says which seqs it holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


def append(changes: DataFrame, root: str) -> dict | None:
    """Write a batch of changes as one segment: all of it is in the log, or nothing. An empty batch adds none."""
    spark, name = changes.sparkSession, uuid.uuid4().hex
    changes.write.option("compression", "zstd").parquet(f"{root}/segments/{name}")
    held = spark.read.schema(changes.schema).parquet(f"{root}/segments/{name}").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("rows")).first().asDict()
    if not held["rows"]:
        files.delete(spark, f"{root}/segments/{name}")
        return None
    entry = held | {"segment": name}
    files.commit(spark, f"{root}/commits/{held['last']:020}-{name}.json", json.dumps(entry))
    return entry


def segments(spark: SparkSession, root: str) -> list[dict]:
    """What the committed segments hold, in order of their last seq."""
    return [json.loads(files.read_text(spark, f"{root}/commits/{n}")) for n in files.names(spark, f"{root}/commits") if n.endswith(".json")]


def read(spark: SparkSession, root: str, schema: T.StructType | str, after: int | None = None) -> DataFrame:
    """Changes of committed segments, those after a seq only; segments that end before it are not read."""
    wanted = [f"{root}/segments/{s['segment']}" for s in segments(spark, root) if after is None or s["last"] > after]
    rows = spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)
    return rows if after is None else rows.filter(F.col("seq") > after)


def truncate(spark: SparkSession, root: str, seq: int) -> int:
    """Drop the segments that end at or before a seq, after a checkpoint up to it; returns how many."""
    old = [s for s in segments(spark, root) if s["last"] <= seq]
    for s in old:  # the commit goes first, so that no reader is sent to a folder that is going
        files.delete(spark, f"{root}/commits/{s['last']:020}-{s['segment']}.json")
        files.delete(spark, f"{root}/segments/{s['segment']}")
    return len(old)


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete segments that were never committed; to be called by the log's only writer, before it writes."""
    known = {s["segment"] for s in segments(spark, root)}
    gone = [n for n in files.names(spark, f"{root}/segments") if n not in known]
    for n in gone:
        files.delete(spark, f"{root}/segments/{n}")
    files.sweep(spark, f"{root}/commits", 0.0)
    return gone
