"""Materialised intermediate results, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; set an own one only in local mode without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if shared := sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="engram-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")


def materialized(df: DataFrame) -> DataFrame:
    """df as written to the checkpoint folder: what comes after doesn't compute it again, also when an executor is lost.

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go when no one refers to the result any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, most: int = 50_000) -> tuple[DataFrame, bool]:
    """df computed once, and whether it is empty: at most `most` rows, counted as they come, are kept in the plan itself, where joins
    know their size; more are materialised."""
    rows = df.limit(most + 1).toArrow()
    if len(rows) > most:
        return materialized(df), False
    return df.sparkSession.createDataFrame(rows, df.schema), len(rows) == 0


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: for costly expressions over a scan of few files or row groups, whose
    rows would otherwise keep one core busy. A scan with partitions enough, as any large one has, and a result of a shuffle stay as they are."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString():  # counting its partitions would run it
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
