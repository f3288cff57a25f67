"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir, materialized

#: Words are runs of characters other than these ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
#: Words in a shingle, and the similarity from which two documents are near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation of what came before."""
    return materialized(df)


#: Rows of numbers (some 32 bytes each) up to which a counted table is broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """Of a materialised table of numbers: marked for a broadcast if it has at most `most` (BROADCAST_ROWS) rows, as it is otherwise."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def matched(df: DataFrame, ids: DataFrame, key, how: str, most: int | None = None) -> DataFrame:
    """Semi or anti join with a materialised table of keys, by names or a condition. At most `most` (BROADCAST_ROWS) keys, counted first, are
    broadcast, so that df is not shuffled; more are not."""
    n = ids.count()
    if n == 0:
        return df if how == "left_anti" else df.limit(0)
    return df.join(F.broadcast(ids) if n <= (BROADCAST_ROWS if most is None else most) else ids, key, how)


def written(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Write as Parquet to the shared checkpoint folder and read again; a table written so before, if given, is deleted."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in before.inputFiles()[:1] if before is not None else ():
        folder = spark._jvm.org.apache.hadoop.fs.Path(old).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
