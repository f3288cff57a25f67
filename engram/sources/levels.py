"""A keyed table that takes appends: runs of changes, merged into a base bucket by bucket.

A change is a row (keys..., seq, op, payload...), op `put` or `delete`. An append writes one run of the newest change per key. A
compaction merges the runs into the base, and rewrites only the buckets that the runs touch; the others keep their files. Every
step ends with the commit of a numbered manifest that lists the runs and, for each bucket, the folder of its base, so
a reader sees the state before or after it. Deletions stay as rows, so that a change that comes late never brings a deleted key back; those
older than `forget_before` (a seq before which no change can come any more) are dropped by compactions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackpressureError
from ..operators.changelog import latest, live_rows
from . import files

BUCKET = "_bucket"


class LevelStore:
    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, buckets: int = 16, trigger: int = 4):
        self.spark, self.root, self.keys, self.trigger = spark, root.rstrip("/"), keys or ["key"], trigger
        self.buckets = self.manifest().get("buckets", buckets)

    # Manifests.

    def version(self) -> int:
        return max((int(n[:-5]) for n in files.names(self.spark, f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(files.read_text(self.spark, f"{self.root}/manifests/{version:08}.json")) if version else {"version": 0, "runs": [], "base": {}, "batch": None}

    def _commit(self, seen: dict, **new) -> dict:
        """The manifest after `seen`; another writer's manifest of that number is a conflict."""
        done = seen | new | {"version": seen["version"] + 1, "buckets": self.buckets}
        files.commit(self.spark, f"{self.root}/manifests/{done['version']:08}.json", json.dumps(done))
        return done

    # Writing.

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A folder per bucket, each sorted by key; rows are dealt by bucket first, so each bucket is one file."""
        run = f"runs/{uuid.uuid4().hex}"
        rows = rows.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, *self.keys)
        rows.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.root}/{run}")
        return run, sorted(int(n.split("=")[1]) for n in files.names(self.spark, f"{self.root}/{run}") if n.startswith(f"{BUCKET}="))

    def append(self, changes: DataFrame, batch: int | None = None) -> dict:
        """Add a run; a numbered batch that was added before is left out, so it may come again."""
        seen = self.manifest()
        if batch is not None and seen["batch"] is not None and batch <= seen["batch"]:
            return seen
        run, touched = self._write(latest(changes, self.keys))
        runs = [*seen["runs"], {"run": run, "buckets": touched}] if touched else seen["runs"]
        return self._commit(seen, runs=runs, batch=seen["batch"] if batch is None else batch)

    def dirty(self) -> list[int]:
        """Buckets that a compaction would rewrite."""
        return sorted({b for r in self.manifest()["runs"] for b in r["buckets"]})

    def due(self) -> bool:
        return len(self.manifest()["runs"]) >= self.trigger

    def compact(self, forget_before: int | None = None) -> list[int]:
        """Merge all runs into the base; returns the buckets rewritten."""
        seen, touched = self.manifest(), self.dirty()
        if not touched:
            return []
        rows = latest(self._read(seen, touched), self.keys)
        if forget_before is not None:
            rows = rows.filter((F.col("op") != "delete") | (F.col("seq") >= forget_before))
        run, written = self._write(rows)
        base = {b: r for b, r in seen["base"].items() if int(b) not in touched} | {str(b): run for b in written}
        self._commit(seen, runs=[], base=base)
        return touched

    # Reading.

    def _folders(self, manifest: dict, buckets: list[int] | None) -> list[str]:
        wanted = lambda b: buckets is None or b in buckets
        pairs = [(r["run"], b) for r in manifest["runs"] for b in r["buckets"] if wanted(b)]
        pairs += [(r, int(b)) for b, r in manifest["base"].items() if wanted(int(b))]
        return [f"{self.root}/{run}/{BUCKET}={b}" for run, b in pairs]

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = self._folders(manifest, buckets)
        if not folders:
            known = self._folders(manifest, None)
            if not known:
                raise FileNotFoundError(f"nothing under {self.root}")
            return self.spark.read.parquet(known[0]).limit(0)
        return self.spark.read.parquet(*folders)

    def changes(self) -> DataFrame:
        """The newest change of each key, deletions included."""
        return latest(self._read(self.manifest()), self.keys)

    def read(self) -> DataFrame:
        """The live rows."""
        return live_rows(self.changes())

    def get(self, *key) -> DataFrame:
        """The live row of one key: only its bucket is read, and statistics of the sorted files skip most of that."""
        match = F.lit(True)
        manifest = self.manifest()
        types = self._read(manifest).schema
        values = [F.lit(v).cast(types[k].dataType) for k, v in zip(self.keys, key)]
        for k, v in zip(self.keys, values):
            match = match & (F.col(k) == v)
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*values), F.lit(self.buckets))).first()[0]
        return live_rows(latest(self._read(manifest, [bucket]).filter(match), self.keys))

    # Upkeep.

    def stats(self) -> list[dict]:
        """Runs, files and bytes of each level: 0 holds the runs, 1 the base."""
        manifest = self.manifest()
        found = []
        for level, folders in ((0, self._folders(manifest | {"base": {}}, None)), (1, self._folders(manifest | {"runs": []}, None))):
            sizes = [files.size_of(self.spark, f) for f in folders]
            found.append({"level": level, "runs": len(manifest["runs"]) if level == 0 else int(bool(folders)), "files": sum(n for n, _ in sizes), "bytes": sum(b for _, b in sizes)})
        return found

    def sweep(self, keep: int = 2, older_than_s: float = 3600.0) -> list[str]:
        """Delete manifests but the newest `keep`, the runs that none of those names, and what interrupted commits left aside."""
        newest = self.version()
        kept = [self.manifest(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        named = {r["run"] for m in kept for r in m["runs"]} | {r for m in kept for r in m["base"].values()}
        for n in files.names(self.spark, f"{self.root}/manifests"):
            if n.endswith(".json") and n[:-5].isdigit() and int(n[:-5]) <= newest - keep:
                files.delete(self.spark, f"{self.root}/manifests/{n}")
        gone = [f"runs/{n}" for n in files.names(self.spark, f"{self.root}/runs") if f"runs/{n}" not in named]
        for run in gone:
            files.delete(self.spark, f"{self.root}/{run}")
        files.sweep(self.spark, f"{self.root}/manifests", older_than_s)
        return gone


class WriteBuffer:
    """Changes held by a writer until there are enough for a run.

    A full buffer is frozen and a new one begun; at most `backlog` frozen buffers wait, and a write beyond that is refused, so a
    writer that is faster than its table notices. A read sees frozen and open buffers over the table.
    """

    def __init__(self, store: LevelStore, schema: str, most: int = 10_000, backlog: int = 4):
        self.store, self.schema, self.most, self.backlog = store, schema, most, backlog
        self.open: list[tuple] = []
        self.frozen: list[list[tuple]] = []

    def write(self, row: tuple) -> None:
        if len(self.open) >= self.most:
            if len(self.frozen) >= self.backlog:
                raise BackpressureError(f"{len(self.frozen)} buffers wait to be written")
            self.frozen.append(self.open)
            self.open = []
        self.open.append(row)

    def rows(self) -> DataFrame:
        """All changes held; a bounded number."""
        return self.store.spark.createDataFrame([r for part in (*self.frozen, self.open) for r in part], self.schema)

    def read(self) -> DataFrame:
        """The live rows of the table with the buffers over it."""
        held, manifest = self.rows(), self.store.manifest()
        table = self.store._read(manifest).select(*held.columns) if manifest["runs"] or manifest["base"] else held.limit(0)
        return live_rows(latest(table.unionByName(held), self.store.keys))

    def flush(self) -> int:
        """Write all buffers as one run; returns the number of changes."""
        n = sum(map(len, self.frozen)) + len(self.open)
        if n:
            self.store.append(self.rows())
            self.frozen, self.open = [], []
        return n

    def close(self) -> None:
        """Write what is held, and merge the runs if that is due."""
        self.flush()
        if self.store.due():
            self.store.compact()
