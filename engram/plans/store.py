"""A facade over one set of tables: what callers of a memory service can ask for, as DataFrames."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..errors import NotFoundError, ValidationError
from ..functions.embedding import Embedder, QueryEmbedder, embed, hashed_embeddings
from ..operators import connections, lifecycle, search, stats, vector
from ..operators.ann import ClusteredIndex
from ..operators.filters import live, record_filter
from ..operators.graph import add_edges, neighbors, remove_edges
from ..schema import SearchType, api_rows, created, validated
from ..sources.fixtures import Tables
from ..streaming.changelog import DiscoveryQueue
from .query import Query, execute


class KeyedLocks:
    """A lock per key, made when it is wanted and dropped when no one holds or awaits it."""

    def __init__(self):
        self._guard, self._held = threading.Lock(), {}

    @contextmanager
    def of(self, key):
        with self._guard:
            lock, n = self._held.get(key, (threading.Lock(), 0))
            self._held[key] = lock, n + 1
        try:
            with lock:
                yield
        finally:
            with self._guard:
                lock, n = self._held[key]
                if n == 1:
                    del self._held[key]
                else:
                    self._held[key] = lock, n - 1


class MemoryStore:
    """Reads are DataFrames over the current tables; writes replace the tables by derived ones. Callers persist them as snapshots.

    Writers of one record wait for each other, and so do those that replace a table, so a read-modify-write is whole.
    """

    def __init__(self, tables: Tables, config: Config | None = None, embedder: Embedder | None = None, index: ClusteredIndex | None = None):
        self.tables, self.config, self.index = tables, (config or Config()).validated(), index
        self.embedder = embedder or partial(hashed_embeddings, dim=self.config.dimension)
        self.embed_query = QueryEmbedder(self.embedder)
        self.locks, self._write = KeyedLocks(), threading.RLock()
        self.queue = DiscoveryQueue(self.discover, self.config.queue_size)

    def _kind(self) -> T.DataType:
        return self.tables.memories.schema["id"].dataType

    def _is(self, id_, column: str = "id"):
        return F.col(column) == F.lit(id_).cast(self._kind())

    # Reads.

    def exists(self, id_) -> bool:
        """Whether there is a live record."""
        return not live(self.tables.memories).filter(self._is(id_)).isEmpty()

    def get(self, id_) -> DataFrame:
        found = live(self.tables.memories).filter(self._is(id_))
        if found.isEmpty():
            raise NotFoundError(f"no record {id_}")
        return api_rows(connections.nest_connections(found, self.tables.edges))

    def list(self, offset: int = 0, limit: int = 10, order: str = "asc", **filters) -> tuple[DataFrame, DataFrame]:
        page, total = search.list_memories(self.tables.memories, record_filter(**filters), offset, limit, order)
        return api_rows(page), total

    def search(self, query: str, kind: SearchType = SearchType.HYBRID, vector: Sequence[float] | None = None, related_to=None, limit: int = 10, **filters) -> DataFrame:
        if not query.strip():
            raise ValidationError("a query needs a word")
        where, t = record_filter(**filters), self.tables
        if kind == SearchType.KEYWORD:
            return search.keyword(t.memories, query, where, limit)
        vector = self.embed_query(query) if vector is None else vector
        if kind == SearchType.HYBRID:
            return search.hybrid(t.memories, t.vectors, t.edges, vector, query, related_to, where, limit, self.config.rrf_k)
        if related_to is not None:
            return search.semantic_with_context(t.memories, t.vectors, t.edges, vector, related_to, where, limit)
        return search.semantic(t.memories, t.vectors, vector, where, limit)

    def query(self, query: Query) -> DataFrame:
        return execute(self.tables, query, self.index)

    def related(self, id_, depth: int = 1, edge_types: list[str] | None = None, limit: int = 20) -> DataFrame:
        return connections.find_related(self.tables.edges, self.tables.memories, id_, depth, edge_types, limit)

    def connections(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return connections.list_connections(self.tables.edges, self.tables.memories, offset, limit)

    def connections_of(self, id_) -> DataFrame:
        return neighbors(self.tables.edges, id_)

    def recent(self, limit: int = 20) -> DataFrame:
        return search.recent(self.tables.memories, limit)

    def important(self, limit: int = 20) -> DataFrame:
        return search.important(self.tables.memories, limit)

    def stats(self) -> DataFrame:
        return stats.system_stats(self.tables.memories, self.tables.edges)

    def index_counts(self) -> DataFrame:
        t = self.tables
        return stats.index_counts(t.memories, t.edges, t.vectors, t.timeline)

    def health(self, deep: bool = False) -> dict:
        """Whether the store answers; deep: the seconds that each of its tables takes to give a row, and the discovery queue."""
        found: dict = {"status": "ok", "checks": {}}
        for name in ("memories", "edges", "vectors", "timeline") if deep else ("memories",):
            began = time.perf_counter()
            try:
                getattr(self.tables, name).limit(1).collect()
                found["checks"][name] = {"status": "ok", "seconds": round(time.perf_counter() - began, 3)}
            except Exception as e:
                found["status"] = "failed"
                found["checks"][name] = {"status": "failed", "error": str(e)[:200]}
        return found | ({"queue": self.queue.counters()} if deep else {})

    # Writes.

    def create(self, requests: DataFrame, now_ms: int) -> DataFrame:
        """Add records for valid requests (see schema.CREATE), or put them in the place of records of the same ids; returns the others with
        their errors. A record, its vector (its own, else that of its content), its time and its tags change together, and entities
        become records like others. Of requests of one id the largest counts.

        Ids must be given, or the requests be materialised: a generated id differs each time it is computed.
        """
        # Vectors of a request are held to the dimension of the store, which its settings name.
        given = requests if "embedding" in requests.columns else requests.withColumn("embedding", F.lit(None).cast("array<float>"))
        good, bad = validated(given, self.config.dimension)
        if not isinstance(self._kind(), T.StringType) and not good.filter(F.size("graph_extraction.entities") > 0).isEmpty():
            raise ValidationError("entities need string ids, see Tables.with_string_ids")
        kept = [c for c in good.columns if c != "id"]
        good = good.groupBy("id").agg(F.max(F.struct(*kept)).alias("r")).select("id", "r.*")
        records = created(good, now_ms)
        entities, edges = connections.extract_graph(good, now_ms)
        entities = entities.select("*", *(F.lit(now_ms).alias(c) for c in ("updated_at", "accessed_at")))
        own = good.filter("embedding is not null").select("id", "embedding")
        records = records.unionByName(entities, allowMissingColumns=True).fillna({"archived": False, "access_count": 0, "health": 100.0, "emotional_valence": 0.0, "arousal": 0.0})
        contents = records.join(own.select("id"), "id", "left_anti")
        vectors = own.unionByName(contents.select("id", embed(F.col("content"), self.embedder).alias("embedding")))
        with self._write:
            t = self.tables
            self.tables = replace(
                t,
                memories=_replaced(t.memories, records, "id"),
                vectors=_replaced(t.vectors, vectors, "id"),
                timeline=_replaced(t.timeline, records.select(F.col("id").alias("key"), F.col("created_at").alias("ts")), "key"),
                edges=_aligned(t.edges, edges.withColumn("seq", F.lit(now_ms))),
            )
        return bad

    def update(self, patches: DataFrame, now_ms: int) -> None:
        """See lifecycle.update; new content of a live record also gets a new vector."""
        with self._write:
            t = self.tables
            memories, edges = lifecycle.update(t.memories, t.edges, patches, now_ms)
            vectors = t.vectors
            if "content" in patches.columns:
                new = lifecycle.rewritten(t.memories, patches)
                vectors = _replaced(vectors, new.select("id", embed(F.col("content"), self.embedder).alias("embedding")), "id")
            self.tables = replace(t, memories=memories, edges=edges, vectors=vectors)

    def recall(self, id_, now_ms: int) -> None:
        with self.locks.of(id_), self._write:
            self.tables = replace(self.tables, memories=lifecycle.recall(self.tables.memories, now_ms, self._is(id_)).drop("changed"))

    def promote(self, id_, now_ms: int) -> None:
        with self.locks.of(id_), self._write:
            if not self.exists(id_):
                raise NotFoundError(f"no record {id_}")
            self.tables = replace(self.tables, memories=lifecycle.promote(self.tables.memories, now_ms, self._is(id_)).drop("changed"))

    def delete(self, ids: DataFrame, now_ms: int, hard: bool = False) -> None:
        """Soft: the record stays, archived, and its vector with it, which searches skip. Hard: it goes from every table."""
        with self._write:
            memories, edges = lifecycle.delete(self.tables.memories, self.tables.edges, ids, now_ms, hard)
            vectors, timeline = self.tables.vectors, self.tables.timeline
            if hard:
                vectors = vector.remove(vectors, ids)
                timeline = timeline.join(ids.select(F.col("id").alias("key")).distinct(), "key", "left_anti")
            self.tables = replace(self.tables, memories=memories, edges=edges, vectors=vectors, timeline=timeline)

    def connect(self, requests: DataFrame, now_ms: int) -> DataFrame:
        """Upsert valid connections (src, dst, edge_type, weight); returns the others with their error."""
        with self._write:
            good, bad = connections.checked_connections(requests, self.tables.memories)
            self.tables = replace(self.tables, edges=add_edges(self.tables.edges, good.withColumn("seq", F.lit(now_ms).cast("long"))))
            return bad

    def disconnect(self, pairs: DataFrame) -> None:
        with self._write:
            self.tables = replace(self.tables, edges=remove_edges(self.tables.edges, pairs))

    def discover(self, ids: list, now_ms: int | None = None) -> int:
        """Link some records with their nearest neighbours; returns the number of new edges. The store's queue calls it for ids offered."""
        c, now = self.config, int(time.time() * 1000) if now_ms is None else now_ms
        with self._write:
            t = self.tables
            found = connections.discover_for(ids, t.memories, t.vectors, t.edges, c.discovery_threshold, c.discovery_neighbors)
            n = found.count()
            if n:
                self.tables = replace(t, edges=add_edges(t.edges, found.withColumn("seq", F.lit(now).cast("long"))))
            return n


def _aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union in the old table's columns and types; columns that the new rows lack are null."""
    cols = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema]
    return old.unionByName(new.select(*cols))


def _replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in the place of those of the same keys."""
    return _aligned(old.join(new.select(F.col(key).cast(old.schema[key].dataType).alias(key)), key, "left_anti").select(*old.columns), new)


def _lifecycle_tasks(store: MemoryStore) -> dict[str, Callable[[int], dict[str, int]]]:
    """The tasks by name: a function of the time that runs one and counts what it did."""
    c = store.config

    def sweep(rule: Callable[[DataFrame, int], DataFrame]) -> Callable[[int], dict[str, int]]:
        def run(now: int) -> dict[str, int]:
            with store._write:
                before = store.tables.memories
                swept = rule(before, now)
                is_archived, n = F.col("changed") & F.col("archived"), before.count()
                seen = swept.agg(F.count("*").alias("left"), F.count_if("changed").alias("updated"), F.count_if(is_archived).alias("archived")).first()
                store.tables = replace(store.tables, memories=swept.drop("changed"))
                gone = n - seen["left"]
                return {"handled": n, "updated": seen["updated"], "archived": seen["archived"], "deleted": gone, "affected": seen["updated"] + gone}

        return run

    def cleanup(now: int) -> dict[str, int]:
        with store._write:
            old = store.tables.memories
            gone = old.select("id").join(lifecycle.cleanup_archived(old, now, c.retention_days).select("id"), "id", "left_anti")
            n = gone.count()
            store.delete(gone, now, hard=True)
            return {"deleted": n, "affected": n}

    def discover(now: int) -> dict[str, int]:
        with store._write:
            t = store.tables
            found = connections.discover_connections(t.memories, t.vectors, t.edges, c.discovery_threshold, c.discovery_neighbors)
            n = found.count()
            store.tables = replace(t, edges=add_edges(t.edges, found.withColumn("seq", F.lit(now).cast("long"))))
            return {"found": n, "affected": n}

    return {
        "expire_short_term": sweep(lambda m, now: lifecycle.expire_short_term(m, now, c.promote_accesses)),
        "importance_decay": sweep(lambda m, now: lifecycle.importance_decay(m, now, c.decay_per_day)),
        "active_forgetting": sweep(lambda m, now: lifecycle.active_forgetting(m, now, c.hard_forget)),
        "consolidate_similar": lambda now: {"affected": lifecycle.consolidate_similar(store.tables.memories)[1]},
        "cleanup_archived": cleanup,
        "discover_connections": discover,
        "stats": lambda now: {"affected": store.stats().first()["total_memories"]},
    }
