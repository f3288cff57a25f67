"""Readers and writers: JSON ingest, record decoding, versioned snapshots, task history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CREATE, MEMORY
from . import files
from .fixtures import Tables

TASK_RUNS = "task string, started_at bigint, finished_at bigint, status string, affected bigint, error string"
POINTER, COMMITS = "CURRENT", "_commits"


def read_create_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON bodies of create requests, one a line."""
    return spark.read.schema(CREATE).json(path)


def stream_create_requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream; the number of files a trigger takes is the back-pressure."""
    return spark.readStream.schema(CREATE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def decode(rows: DataFrame, column: str = "value", schema: T.StructType = MEMORY, strict: bool = False) -> DataFrame:
    """Records out of JSON values. Undecodable ones are skipped, or raise an error if `strict`."""
    parsed = F.from_json(F.col(column), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    out = rows.select(parsed.alias("r")).filter("r is not null")
    if not strict:
        out = out.filter("r.id is not null")
    return out.select("r.*")


def encode(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, value) rows with JSON values."""
    return records.select(F.concat(F.lit("memory:"), F.col(key).cast("string")).alias("key"), F.to_json(F.struct("*")).alias("value"))


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions. Each has a file of its own that says so, so there is no pointer to swing or to lose."""
    found = [int(n) for n in files.names(spark, f"{root}/{COMMITS}") if n.isdigit()]
    return sorted(found) or [v for v in [_legacy_version(spark, root)] if v is not None]


def _legacy_version(spark: SparkSession, root: str) -> int | None:
    """What the pointer file of the first layout names."""
    return int(files.read_text(spark, f"{root}/{POINTER}")) if POINTER in files.names(spark, root) else None


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version; None without a snapshot."""
    return max(versions(spark, root), default=None)


def migrate_snapshot(spark: SparkSession, root: str) -> int | None:
    """Bring a snapshot of the first layout, with a pointer file, to this one; returns its version. Done again it changes nothing."""
    old = _legacy_version(spark, root)
    if old is not None:
        if str(old) not in files.names(spark, f"{root}/{COMMITS}"):
            files.commit(spark, f"{root}/{COMMITS}/{old}", "")
        files.delete(spark, f"{root}/{POINTER}")
    return current_version(spark, root)


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None, bloom: list[str] | None = None, cluster_by: list[str] | None = None, n_files: int | None = None) -> int:
    """Write a new version, then commit it: readers see the newest whole one, at any moment.

    The number comes from all folders, those of interrupted writes too, so nothing is written over. With `cluster_by` rows are range
    partitioned and sorted, into `n_files` files or as many as their size asks for, so that the files' statistics let a point or range read skip most of them; `bloom` columns get Bloom filters.
    """
    spark = df.sparkSession
    taken = [int(n[2:]) for n in files.names(spark, root) if n.startswith("v=")] + versions(spark, root)
    version = max(taken, default=0) + 1
    if cluster_by:
        df = df.repartitionByRange(*([n_files] if n_files else []), *cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    for column in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(f"{root}/v={version}")
    files.commit(spark, f"{root}/{COMMITS}/{version}", "")
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = current_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(f"{root}/v={version}")


def compact_snapshot(spark: SparkSession, root: str, rows_per_file: int = 1_000_000) -> int:
    """Rewrite the current version into files of about `rows_per_file` rows; returns the new version."""
    rows = read_snapshot(spark, root)
    return write_snapshot(rows.coalesce(max(1, -(-rows.count() // rows_per_file))), root)


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest `keep` versions, and what interrupted writes left below them; returns the numbers."""
    newest = versions(spark, root)[-keep:]
    folders = [int(n[2:]) for n in files.names(spark, root) if n.startswith("v=")]
    old = sorted(v for v in folders if newest and v < newest[0])
    for v in old:  # the commit goes first, so that no reader is sent to a folder that is going
        files.delete(spark, f"{root}/{COMMITS}/{v}")
        files.delete(spark, f"{root}/v={v}")
    files.sweep(spark, f"{root}/{COMMITS}")
    return old


def clear_snapshot(spark: SparkSession, root: str) -> None:
    """Remove all versions."""
    for folder in (COMMITS, *(n for n in files.names(spark, root) if n.startswith("v="))):
        files.delete(spark, f"{root}/{folder}")


def storage_stats(spark: SparkSession, root: str) -> list[dict]:
    """Files and bytes of every committed version."""
    found = []
    for v in versions(spark, root):
        n, size = files.size_of(spark, f"{root}/v={v}")
        found.append({"version": v, "files": n, "bytes": size})
    return found


def save_tables(tables: Tables, root: str) -> dict[str, int]:
    """All tables of a store as snapshots, clustered by what they are looked up by; returns the versions."""
    by = {"memories": ["id"], "edges": ["src"], "vectors": ["id"], "timeline": ["ts"]}
    return {name: write_snapshot(getattr(tables, name), f"{root}/{name}", cluster_by=keys) for name, keys in by.items()}


def load_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(**{name: read_snapshot(spark, f"{root}/{name}") for name in ("memories", "edges", "vectors", "timeline")})


def backup(spark: SparkSession, root: str, target: str) -> int:
    """Copy the current version to another place; returns its number of rows."""
    rows = read_snapshot(spark, root)
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target).count()


def append_task_run(spark: SparkSession, path: str, run: dict) -> None:
    spark.createDataFrame([run], TASK_RUNS).write.mode("append").json(path)


def read_task_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_RUNS).json(path)
