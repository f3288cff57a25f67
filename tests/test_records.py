import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.config import Config
from engram.errors import BackpressureError, ConflictError, NotFoundError, ValidationError
from engram.functions.embedding import hashed_embeddings
from engram.operators import changelog, connections, lifecycle, search
from engram.operators.filters import record_filter
from engram.plans.query import GraphQuery, HybridQuery, TagQuery, TimeRangeQuery, VectorQuery, execute
from engram.plans import tools
from engram.plans.cache import TableCache, estimated_bytes
from engram.plans.store import KeyedLocks, MemoryStore
from engram.plans.tasks import Scheduler, TaskRegistry
from engram.schema import CREATE, DAY_MS, SearchType, created, validated
from engram.sources import files
from engram.sources import log as wal
from engram.sources import tables as S
from engram.sources.fixtures import NOW_MS, load
from engram.sources.levels import LevelStore, WriteBuffer
from engram.streaming import changelog as stream
from engram.streaming.changelog import DiscoveryQueue

COLUMNS = "id long, memory_type string, ttl long, created_at long, updated_at long, accessed_at long, access_count int, last_recalled_at long, flashbulb_until long, health double, importance double, last_decay_at long, last_health_check_at long, archived boolean, tags array<string>, content string"
HOUR = 3_600_000


def memory(spark, **new):
    row = {
        "id": 1, "memory_type": "short_term", "ttl": None, "created_at": 0, "updated_at": 0, "accessed_at": 0, "access_count": 0, "last_recalled_at": None,
        "flashbulb_until": None, "health": 100.0, "importance": 0.5, "last_decay_at": None, "last_health_check_at": None, "archived": False, "tags": ["a"], "content": "test content",
    }
    return spark.createDataFrame([row | new], COLUMNS)


@pytest.mark.parametrize(
    ("new", "expired"),
    [
        ({"memory_type": "long_term"}, False),
        ({"memory_type": "long_term", "ttl": 1}, False),
        ({"ttl": 3600, "created_at": NOW_MS}, False),
        ({"ttl": 3600, "created_at": NOW_MS - 2 * HOUR}, True),
        ({"ttl": 3600, "created_at": NOW_MS - HOUR}, True),
        ({}, False),
    ],
)
def test_expiry(spark, new, expired):
    assert memory(spark, **new).select(lifecycle.is_expired(NOW_MS).alias("x")).first()["x"] is expired


def test_expire_promotes_or_archives(spark):
    used = lifecycle.expire_short_term(memory(spark, ttl=1, access_count=5), NOW_MS).first()
    assert (used["memory_type"], used["ttl"], used["archived"], used["changed"]) == ("long_term", None, False, True)
    unused = lifecycle.expire_short_term(memory(spark, ttl=1), NOW_MS).first()
    assert (unused["memory_type"], unused["archived"]) == ("short_term", True)


def test_decay_and_forgetting_keep_their_own_clocks(spark):
    old = memory(spark, memory_type="long_term", importance=0.9)
    now = 10 * DAY_MS
    decayed = lifecycle.importance_decay(old, now)
    assert decayed.first()["importance"] == pytest.approx(0.9 * 0.995**10)
    forgotten = lifecycle.active_forgetting(decayed.drop("changed"), now).first()
    assert (forgotten["health"], forgotten["last_health_check_at"]) == (80.0, now)
    again = lifecycle.importance_decay(decayed.drop("changed"), now)
    assert not again.first()["changed"]


def test_forgetting_archives_or_drops(spark):
    weak = memory(spark, health=1.0)
    assert lifecycle.active_forgetting(weak, NOW_MS).first()["archived"]
    assert lifecycle.active_forgetting(weak, NOW_MS, hard=True).count() == 0
    safe = memory(spark, health=1.0, flashbulb_until=NOW_MS + 1)
    assert not lifecycle.active_forgetting(safe, NOW_MS).first()["changed"]
    assert lifecycle.active_forgetting(memory(spark, health=1.0, flashbulb_until=NOW_MS), NOW_MS).first()["changed"]


def test_recall_cleanup_promote(spark):
    touched = lifecycle.recall(memory(spark, health=95.0), NOW_MS, F.lit(True)).first()
    assert (touched["health"], touched["access_count"], touched["last_recalled_at"]) == (100.0, 1, NOW_MS)
    edge = memory(spark, archived=True, updated_at=NOW_MS - 30 * DAY_MS)
    assert lifecycle.cleanup_archived(edge, NOW_MS).count() == 0
    assert lifecycle.cleanup_archived(edge, NOW_MS - 1).count() == 1
    assert not lifecycle.promote(memory(spark, archived=True), NOW_MS).first()["changed"]
    assert lifecycle.consolidate_similar(edge)[1] == 0


@pytest.mark.parametrize(("conditions", "passes"), [({"min_importance": 0.5}, True), ({"max_importance": 0.49}, False), ({"memory_type": "long_term"}, False), ({"tags": ["a"]}, True), ({"tags": ["A"]}, False), ({"created_after": 1}, False), ({"created_before": 0}, True), ({}, True)])
def test_record_filter(spark, conditions, passes):
    assert (memory(spark).filter(record_filter(**conditions)).count() == 1) is passes


def requests(spark, *bodies):
    return spark.read.schema(CREATE).json(spark.sparkContext.parallelize([json.dumps(b) for b in bodies]))


def test_create(spark):
    good, bad = validated(requests(spark, {"id": "1", "content": "x", "importance": 7, "arousal": 0.9}, {"id": "2", "content": "  "}, {"id": "3", "content": "é" * 50_001}, {"id": "4", "content": "x", "tags": ["t"] * 51}, {"id": "5", "content": "y", "memory_type": "Short"}))
    assert {r["id"]: r["errors"] for r in bad.collect()} == {"2": ["content_blank"], "3": ["content_too_long"], "4": ["too_many_tags"], "5": ["memory_type_unknown"]}
    row = created(good, NOW_MS).first()
    assert (row["memory_type"], row["importance"], row["ttl"], row["flashbulb_until"], row["tags"]) == ("long_term", 1.0, None, NOW_MS + 30 * DAY_MS, [])
    short = created(requests(spark, {"id": "6", "content": "z"}), NOW_MS).first()
    assert (short["memory_type"], short["ttl"], short["importance"], short["health"]) == ("short_term", 3600, 0.5, 100.0)


def test_graph_extraction(spark):
    graph = {"entities": [{"name": "Ada", "entity_type": "Person"}, {"name": " ada ", "entity_type": "Person", "description": " d "}, {"name": "  "}, {"name": "Bob", "description": " "}], "relationships": [{"source": "ADA", "target": "nobody"}, {"source": "Ada", "target": "Ada"}, {"source": " ADA", "target": "bob", "relationship_type": "odd", "strength": 3.0}]}
    records, edges = connections.extract_graph(requests(spark, {"id": "m", "content": "c", "graph_extraction": graph}), NOW_MS)
    assert [r["content"] for r in records.orderBy("id").collect()] == ["Entity: Ada\nType: Person", "Entity: ada\nType: Person\nDescription: d", "Entity: Bob\nType: entity"]
    got = {(r["src"], r["dst"], r["edge_type"], r["weight"]) for r in edges.collect()}
    assert got == {*(("m", f"m:entity:{i}", "references", 1.0) for i in (0, 1, 3)), ("m:entity:1", "m:entity:3", "related_to", 1.0)}


def test_connection_checks(spark):
    people = memory(spark).unionByName(memory(spark, id=2)).unionByName(memory(spark, id=3, archived=True))
    asked = spark.createDataFrame([(1, 2, "supports", 1.5), (1, 1, "supports", 1.0), (1, 3, "supports", 1.0), (9, 1, "supports", 1.0), (1, 2, "odd", 1.0)], "src long, dst long, edge_type string, weight double")
    good, bad = connections.checked_connections(asked, people)
    assert [tuple(r) for r in good.collect()] == [(1, 2, "supports", 1.0)]
    assert sorted(r["error"] for r in bad.collect()) == ["self_loop", "source_missing", "target_missing", "type_unknown"]


def test_existing_neighbours_are_left_out(spark):
    edges = spark.createDataFrame([("A", "B", "supports")], "src string, dst string, edge_type string")
    found = spark.createDataFrame([("A", "B", 0.9), ("A", "C", 0.85)], "src string, dst string, score double")
    assert [r["dst"] for r in connections.without_linked(found, edges).collect()] == ["C"]


def test_decode(spark):
    rows = spark.createDataFrame([('{"id": "a", "content": "x"}',), ("not json",)], "value string")
    assert [r["id"] for r in S.decode(rows).collect()] == ["a"]
    with pytest.raises(Exception):
        S.decode(rows, strict=True).collect()
    assert S.encode(memory(spark)).first()["key"] == "memory:1"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, seq long, op string, payload string")


def test_fold(spark):
    changes = log(spark, ("a", 1, "put", "x"), ("a", 3, "put", "z"), ("a", 2, "put", "y"), ("b", 1, "put", "x"), ("b", 2, "delete", None))
    assert [tuple(r) for r in changelog.fold(changes).collect()] == [("a", 3, "z")]
    merged = changelog.merge(changelog.latest(changes), log(spark, ("a", 2, "put", "late"), ("c", 9, "put", "c")))
    assert sorted(tuple(r) for r in changelog.live_rows(merged).collect()) == [("a", 3, "z"), ("c", 9, "c")]
    assert changelog.get("b", changes).count() == 0 and changelog.trim(changes, 2).count() == 1
    assert [tuple(r) for r in changelog.get("a", log(spark, ("a", 2, "put", "y")), changes).collect()] == [("a", 3, "z")]
    assert [r["seq"] for r in changelog.ordered(changes, 1).collect()] == [2, 2, 3]


def test_a_late_put_does_not_bring_a_deleted_key_back(spark):
    snapshot = changelog.merge(log(spark, ("a", 1, "put", "x")), log(spark, ("a", 5, "delete", None)))
    assert [r["op"] for r in snapshot.collect()] == ["delete"]
    late = changelog.merge(snapshot, log(spark, ("a", 3, "put", "late"), ("b", 1, "put", "y")))
    assert [tuple(r) for r in changelog.live_rows(late).collect()] == [("b", 1, "y")]
    gone = changelog.deletes(spark.createDataFrame([("b",), ("b",)], "key string"), F.lit(9), ["key"], late)
    assert changelog.live_rows(changelog.merge(late, gone)).count() == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, root)
    assert S.write_snapshot(spark.range(3), root, bloom=["id"]) == 1
    assert S.write_snapshot(spark.range(5), root) == 2
    assert S.read_snapshot(spark, root).count() == 5 and S.read_snapshot(spark, root, 1).count() == 3
    assert S.backup(spark, root, str(tmp_path / "copy")) == 5
    assert S.compact_snapshot(spark, root) == 3 and S.read_snapshot(spark, root).count() == 5
    assert [s["version"] for s in S.storage_stats(spark, root)] == [1, 2, 3] and all(s["files"] and s["bytes"] for s in S.storage_stats(spark, root))
    assert S.drop_versions(spark, root) == [1] and S.current_version(spark, root) == 3
    S.clear_snapshot(spark, root)
    assert S.current_version(spark, root) is None
    S.append_task_run(spark, str(tmp_path / "runs"), {"task": "t", "started_at": 1, "finished_at": 2, "status": "ok", "affected": 3, "error": None})
    assert S.read_task_runs(spark, str(tmp_path / "runs")).first()["affected"] == 3


def test_an_interrupted_write_loses_nothing(spark, tmp_path):
    root = str(tmp_path / "snap")
    S.write_snapshot(spark.range(100), root)
    # A writer that died before its commit: a folder without one, and a file aside.
    spark.range(7).write.parquet(f"{root}/v=2")
    (tmp_path / "snap" / "_commits" / ".tmp-2-dead").write_text("")
    assert S.current_version(spark, root) == 1 and S.read_snapshot(spark, root).count() == 100
    assert S.write_snapshot(spark.range(3), root) == 3 and S.read_snapshot(spark, root).count() == 3
    assert files.sweep(spark, f"{root}/_commits") == [] and files.sweep(spark, f"{root}/_commits", -1.0) == [".tmp-2-dead"]
    assert S.drop_versions(spark, root, keep=1) == [1, 2] and S.read_snapshot(spark, root).count() == 3
    with pytest.raises(ConflictError):
        files.commit(spark, f"{root}/_commits/3", "")


def test_the_first_layout_is_read_and_migrated(spark, tmp_path):
    root = str(tmp_path / "old")
    spark.range(4).write.parquet(f"{root}/v=6")
    (tmp_path / "old" / "CURRENT").write_text("6")
    assert S.read_snapshot(spark, root).count() == 4
    assert S.migrate_snapshot(spark, root) == 6 and not (tmp_path / "old" / "CURRENT").exists()
    assert S.migrate_snapshot(spark, root) == 6 and S.write_snapshot(spark.range(1), root) == 7


def test_clustered_snapshots_skip_files(spark, tmp_path):
    root = str(tmp_path / "times")
    S.write_snapshot(spark.range(4000).selectExpr("id as key", "id * 10 as ts"), root, cluster_by=["ts"], bloom=["key"], n_files=5)
    rows = S.read_snapshot(spark, root).withColumn("f", F.input_file_name())
    ranges = sorted((r["a"], r["b"]) for r in rows.groupBy("f").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect())
    assert len(ranges) == 5 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))


def test_tables_are_saved_and_loaded(spark, data, tmp_path):
    t = load(spark, data)
    assert set(S.save_tables(t, str(tmp_path / "all")).values()) == {1}
    again = S.load_tables(spark, str(tmp_path / "all"))
    assert all(getattr(again, n).count() == getattr(t, n).count() and getattr(again, n).dtypes == getattr(t, n).dtypes for n in ("memories", "edges", "vectors", "timeline"))


CHANGE = "key string, seq long, op string, payload string"


def test_level_store(spark, tmp_path):
    table = LevelStore(spark, str(tmp_path / "table"), buckets=4, trigger=3)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(log(spark, *((f"k{i}", 1, "put", "x") for i in range(40))), batch=0)
    table.append(log(spark, ("k1", 2, "delete", None), ("k2", 2, "put", "y")), batch=1)
    assert table.append(log(spark, ("k9", 9, "put", "again")), batch=1)["batch"] == 1  # came before: left out
    assert table.read().count() == 39 and [r["payload"] for r in table.get("k2").collect()] == ["y"] and table.get("k1").count() == 0
    assert not table.due() and table.dirty() == [0, 1, 2, 3]
    assert table.compact() == [0, 1, 2, 3] and table.dirty() == []
    before = dict(table.manifest()["base"])
    table.append(log(spark, ("k1", 1, "put", "late"), ("k3", 3, "put", "z")))
    touched = table.dirty()
    assert table.get("k1").count() == 0 and table.compact() == touched and len(touched) < 4
    after = table.manifest()["base"]
    assert {b for b in before if before[b] != after[b]} == {str(b) for b in touched}
    assert table.read().count() == 39 and [s["level"] for s in table.stats()] == [0, 1] and table.stats()[1]["bytes"] > 0
    assert len(table.sweep(keep=1)) >= 2 and table.read().count() == 39
    table.append(log(spark, ("k5", 7, "delete", None)))
    table.compact(forget_before=8)
    assert table.changes().filter("op = 'delete' and key = 'k5'").count() == 0 and table.read().count() == 38


def test_level_store_takes_one_writer_at_a_time(spark, tmp_path):
    table = LevelStore(spark, str(tmp_path / "table"))
    table.append(log(spark, ("a", 1, "put", "x")))
    stale = table.manifest()
    table.append(log(spark, ("b", 1, "put", "x")))
    with pytest.raises(ConflictError):
        table._commit(stale)


def test_write_buffer(spark, tmp_path):
    buffer = WriteBuffer(LevelStore(spark, str(tmp_path / "table"), trigger=2), CHANGE, most=2, backlog=2)
    for i in range(6):
        buffer.write((f"k{i}", i, "put", "x"))
    with pytest.raises(BackpressureError):
        buffer.write(("more", 9, "put", "x"))
    assert buffer.read().count() == 6 and buffer.flush() == 6 and buffer.flush() == 0
    buffer.write(("k0", 9, "delete", None))
    assert buffer.read().count() == 5
    buffer.close()
    assert buffer.store.read().count() == 5 and not buffer.store.due()


def test_log_segments(spark, tmp_path):
    root = str(tmp_path / "log")
    assert wal.append(log(spark, ("a", 1, "put", "x"), ("a", 2, "put", "y")), root)["last"] == 2
    assert wal.append(log(spark, ("b", 5, "put", "z")), root)["rows"] == 1
    assert wal.append(log(spark, ("b", 5, "put", "z")).limit(0), root) is None
    # A segment that was never committed is not in the log.
    log(spark, ("c", 6, "put", "lost")).write.parquet(f"{root}/segments/dead")
    assert wal.read(spark, root, CHANGE).count() == 3 and wal.read(spark, root, CHANGE, after=2).count() == 1
    assert wal.sweep(spark, root) == ["dead"] and wal.truncate(spark, root, 2) == 1
    assert [r["key"] for r in changelog.fold(wal.read(spark, root, CHANGE)).collect()] == ["b"]
    assert wal.read(spark, str(tmp_path / "none"), CHANGE).count() == 0


def test_stream_folds_into_a_snapshot(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("log", "state", "checkpoint"))
    schema = "key string, seq long, op string, payload string"
    log(spark, ("a", 1, "put", "x"), ("b", 2, "put", "y")).write.parquet(source)
    stream.start_fold(stream.read_changelog(spark, source, schema), root, checkpoint).awaitTermination()
    log(spark, ("a", 5, "delete", None), ("c", 6, "put", "z")).write.mode("append").parquet(source)
    stream.start_fold(stream.read_changelog(spark, source, schema), root, checkpoint).awaitTermination()
    log(spark, ("a", 3, "put", "late")).write.mode("append").parquet(source)
    stream.start_fold(stream.read_changelog(spark, source, schema), root, checkpoint).awaitTermination()
    assert sorted(r["key"] for r in stream.current_state(spark, root).collect()) == ["b", "c"]


def test_supervised_restarts():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("lost")

    left, slept = [True, True, False], []
    assert stream.supervise(lambda: Query(left.pop(0)), sleep=slept.append) == 2 and slept == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        stream.supervise(lambda: Query(True), retries=1, sleep=slept.append)


@pytest.fixture(scope="module")
def store(spark, data):
    return MemoryStore(load(spark, data), Config(discovery_threshold=0.45, dimension=64))


def test_store_reads(store):
    probe = list(store.tables.vectors.filter("id = 7").first()["embedding"])
    assert store.get(8).count() == 1
    with pytest.raises(NotFoundError):
        store.get(-5)
    for kind in SearchType:
        rows = store.search("en src1 b3", kind, vector=probe, limit=5).collect()
        assert 0 < len(rows) <= 5 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert store.search("en", SearchType.SEMANTIC, vector=probe, related_to=5).count() > 0
    with pytest.raises(ValidationError):
        store.search("  ")
    page, total = store.list(limit=5, memory_type="long_term")
    assert page.count() == 5 and total.first()["total"] > 5
    assert store.related(5, 2).count() >= 0 and store.connections(limit=7).count() == 7 and store.recent(3).count() == 3


def test_query_plans(store):
    probe = list(store.tables.vectors.filter("id = 7").first()["embedding"])
    vector, tag, graph, time = VectorQuery(probe, 10, ef=5), TagQuery(("en", "src1")), GraphQuery(5, 2), TimeRangeQuery(0, 2**60)
    for q in (vector, tag, time, VectorQuery(probe, 3, filters=(F.col("importance") > 0.5,))):
        assert 0 < store.query(q).count() <= 10
    for merge in ("rrf", "weighted", "union"):
        assert 0 < store.query(HybridQuery(vector, tag, graph, time, merge=merge)).count() <= 10
    assert store.query(HybridQuery(vector)).count() == 10
    assert store.query(HybridQuery(vector, tag, merge="intersection")).count() >= 0
    with pytest.raises(ValueError):
        store.query(HybridQuery())
    with pytest.raises(ValueError):
        execute(store.tables, HybridQuery(vector, tag, merge="odd"))


def test_store_writes_and_tasks(spark, data):
    store = MemoryStore(load(spark, data), Config(discovery_threshold=0.45, dimension=64))
    before = store.tables.memories.count()
    bad = store.create(requests(spark, {"id": "900001", "content": "new one", "tags": ["x"]}, {"id": "900002", "content": " "}, {"id": "900003", "content": "odd", "embedding": [1.0]}), NOW_MS)
    assert {r["id"]: r["errors"] for r in bad.collect()} == {"900002": ["content_blank"], "900003": ["embedding_dimension"]}
    assert store.tables.memories.count() == before + 1 and store.exists(900001) and not store.exists(900002)
    store.recall(8, NOW_MS)
    assert store.tables.memories.filter("id = 8").first()["last_recalled_at"] == NOW_MS
    store.update(spark.createDataFrame([(8, "other words")], "id long, content string"), NOW_MS)
    assert store.connections_of(8).count() == 0
    assert store.connect(spark.createDataFrame([(8, 9, "supports", 0.4), (8, 8, "supports", 0.4)], "src long, dst long, edge_type string, weight double"), NOW_MS).count() == 1
    assert store.connections_of(8).count() == 1
    store.disconnect(spark.createDataFrame([(8, 9)], "src long, dst long"))
    assert store.connections_of(8).count() == 0
    store.delete(spark.createDataFrame([(8,)], "id long"), NOW_MS)
    with pytest.raises(NotFoundError):
        store.get(8)
    assert store.health(deep=True)["status"] == "ok" and store.health(deep=True)["queue"]["waiting"] == 0
    tasks = TaskRegistry(store)
    first, second = tasks.run("expire_short_term", NOW_MS), tasks.run("expire_short_term", NOW_MS)
    assert first["status"] == "ok" and first["affected"] > 0 and second["affected"] == 0
    assert first["counters"]["updated"] == first["affected"] and first["counters"]["archived"] > 0 and first["counters"]["handled"] == before + 1
    tasks.pause("stats")
    assert tasks.run("stats", NOW_MS)["status"] == "skipped"
    tasks.resume("stats")
    assert tasks.run("stats", NOW_MS)["affected"] > 0
    tasks.running.add("stats")
    with pytest.raises(ConflictError):
        tasks.run("stats", NOW_MS)
    for wrong in (lambda: tasks.run("nothing", NOW_MS), lambda: tasks.pause("nothing")):
        with pytest.raises(NotFoundError):
            wrong()
    tasks.tasks["importance_decay"] = lambda now: 1 / 0
    failed = tasks.run("importance_decay", NOW_MS)
    assert (failed["status"], failed["affected"]) == ("failed", -1)
    status = {s["task"]: s for s in tasks.status()}
    assert status["importance_decay"]["totals"]["failures"] == 1 and status["expire_short_term"]["totals"]["runs"] == 2
    assert status["expire_short_term"]["totals"]["affected"] == first["affected"] and status["stats"]["last"]["status"] == "ok"


def test_create_replaces_and_links_entities(spark, data):
    store = MemoryStore(load(spark, data).with_string_ids(), Config(dimension=64))
    n, vectors, times = store.tables.memories.count(), store.tables.vectors.count(), store.tables.timeline.count()
    own = [float(i) for i in range(64)]
    graph = {"entities": [{"name": "Ada"}, {"name": "Bob"}], "relationships": [{"source": "ada", "target": "bob"}]}
    bad = store.create(requests(spark, {"id": "8", "content": "first"}, {"id": "8", "content": "second", "embedding": own}, {"id": "new", "content": "third", "graph_extraction": graph}), NOW_MS)
    assert bad.count() == 0 and store.tables.memories.count() == n + 3
    assert [r["content"] for r in store.tables.memories.filter("id = '8'").collect()] == ["second"]
    assert [list(r["embedding"]) for r in store.tables.vectors.filter("id = '8'").collect()] == [own]
    assert store.tables.vectors.count() == vectors + 3 and store.tables.timeline.filter("key in ('8', 'new')").count() == 2
    assert store.tables.timeline.count() >= times + 3
    entity = store.tables.vectors.filter("id = 'new:entity:0'").first()["embedding"]
    assert np.allclose(entity, hashed_embeddings(["Entity: Ada\nType: entity"], 64)[0])
    assert {r["dst"] for r in store.connections_of("new").collect()} == {"new:entity:0", "new:entity:1"}
    with pytest.raises(ValidationError):
        MemoryStore(load(spark, data), Config(dimension=64)).create(requests(spark, {"id": "1", "content": "c", "graph_extraction": graph}), NOW_MS)


def test_updates(spark, data):
    store = MemoryStore(load(spark, data), Config(dimension=64))
    n, vectors, old = store.tables.memories.count(), store.tables.vectors.count(), store.tables.memories.filter("archived").first()["id"]
    patches = spark.createDataFrame([(8, "one", None, 1), (8, "two", 0.9, 2), (8, None, None, 3), (777777, "unknown", 0.1, 1), (old, "archived", 0.1, 1)], "id long, content string, importance double, seq long")
    store.update(patches, NOW_MS)
    rows = store.tables.memories.filter("id = 8").collect()
    assert [(r["content"], round(r["importance"], 6), r["updated_at"]) for r in rows] == [("two", 0.9, NOW_MS)]
    assert store.tables.memories.count() == n and store.tables.vectors.count() == vectors and store.tables.memories.filter("content = 'archived'").count() == 0
    assert np.allclose(store.tables.vectors.filter("id = 8").first()["embedding"], hashed_embeddings(["two"], 64)[0])


def test_locks():
    locks, seen = KeyedLocks(), []

    def work(name):
        with locks.of("k"):
            seen.append((name, "in"))
            time.sleep(0.02)
            seen.append((name, "out"))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(a[0] == b[0] and (a[1], b[1]) == ("in", "out") for a, b in zip(seen[::2], seen[1::2])) and not locks._held


def test_scheduler():
    class Registry:
        def __init__(self):
            self.ran = []

        def run(self, name, now):
            if name == "busy":
                raise ConflictError("running")
            self.ran.append((name, now))

    flushed = []
    clock = Scheduler(Registry(), {"stats": 10, "busy": 5}, {"flush": (2, flushed.append), "odd": (3, lambda now: 1 / 0)})
    assert clock.tick(0) == [] and clock.tick(2_000) == ["flush"] and clock.tick(5_000) == ["flush"]
    assert set(clock.failures) == {"odd"} and flushed == [2_000, 5_000]
    assert set(clock.tick(10_000)) == {"flush", "stats"} and clock.registry.ran == [("stats", 10_000)]
    assert "expire_short_term" in clock.tick(400_000)
    clock.intervals = {"flush": 0.01}
    clock.start(0.01)
    time.sleep(0.2)
    clock.stop()
    assert len(flushed) > 4


def test_discovery_queue():
    fails, slept = [True, True, False], []

    def discover(ids):
        if fails and fails.pop(0):
            raise RuntimeError("lost")
        return len(ids) * 2

    queue = DiscoveryQueue(discover, most=5, batch=3, sleep=slept.append)
    assert [queue.offer(i) for i in range(7)] == [True] * 5 + [False] * 2
    queue.drain()
    assert queue.counters() == {"waiting": 0, "dropped": 2, "done": 5, "failed": 0, "restarts": 2, "found": 10} and slept == [1.0, 2.0]
    lost = DiscoveryQueue(lambda ids: 1 / 0, retries=1, sleep=slept.append)
    lost.offer(1)
    lost.drain()
    assert lost.counters()["failed"] == 1
    queue.start(workers=2, idle_s=0.01)
    for i in range(4):
        queue.offer(i)
    deadline = time.time() + 5
    while queue.counters()["done"] < 9 and time.time() < deadline:
        time.sleep(0.01)
    queue.stop()
    assert queue.counters()["done"] == 9


def test_discovery_of_queued_records(spark, data):
    store = MemoryStore(load(spark, data), Config(discovery_threshold=0.4, dimension=64))
    live = [r["id"] for r in store.tables.memories.filter("not archived").orderBy("id").limit(6).collect()]
    before = store.tables.edges.count()
    for i in live:
        store.queue.offer(i)
    store.queue.drain()
    counters = store.queue.counters()
    assert counters["done"] == len(live) and store.tables.edges.count() == before + counters["found"]


def test_table_cache(spark):
    one, two = spark.range(1000), spark.range(2000)
    cache = TableCache(estimated_bytes(two) + estimated_bytes(one) // 2)
    assert cache.get("one", one) is one and cache.get("one", two) is one
    cache.get("two", two)
    assert cache.stats() == {"tables": 1, "bytes": estimated_bytes(two), "hits": 1, "misses": 2, "evictions": 1}
    assert not one.is_cached and two.is_cached
    assert not cache.get("big", spark.range(10**9)).is_cached
    cache.drop("two")
    assert not two.is_cached and cache.bytes == 0


def test_tools(spark, data):
    store = MemoryStore(load(spark, data).with_string_ids(), Config(dimension=64))
    kept = tools.call(store, "store_memory", {"content": "the en word", "tags": ["en"], "importance": 0.7, "health": 50}, NOW_MS)
    assert kept["success"] and store.queue.counters()["waiting"] == 1
    id_ = kept["memory_id"]
    assert tools.call(store, "get_memory", {"memory_id": id_}, NOW_MS)["memory"]["content"] == "the en word"
    assert tools.call(store, "update_memory", {"memory_id": id_, "tags": ["zz9"], "importance": 0.9}, NOW_MS)["updated_fields"] == ["importance", "tags"]
    found = tools.call(store, "search_memories", {"query": "zz9 en", "search_type": "keyword", "limit": 3, "filters": {"importance_min": 0.9, "tags": ["zz9"]}}, NOW_MS)
    assert [r["id"] for r in found["results"]] == [id_] and found["results"][0]["preview"] == "the en word"
    assert tools.call(store, "promote_to_longterm", {"memory_id": id_}, NOW_MS)["success"]
    assert tools.call(store, "list_recent_memories", {"limit": 2, "memory_type": "long_term"}, NOW_MS)["count"] == 2
    assert tools.call(store, "find_related", {"memory_id": "5", "depth": 2}, NOW_MS)["results_count"] > 0
    assert tools.call(store, "delete_memory", {"memory_id": id_}, NOW_MS)["deleted"] == "soft"
    errors = [tools.call(store, *x) for x in (("get_memory", {"memory_id": id_}), ("update_memory", {"memory_id": "5"}), ("store_memory", {}), ("store_memory", {"content": " "}), ("search_memories", {"query": "x", "limit": "3"}), ("search_memories", {"query": "x", "odd": 1}), ("list_recent_memories", {"memory_type": "odd"}), ("nothing", {}))]
    assert [e["status"] for e in errors] == [404, 400, 400, 400, 400, 400, 400, 404]
    assert tools.read(store, "memory://stats")["total_memories"] > 0
    page = tools.read(store, "memory://collections/important?limit=3&offset=2")
    assert page["pagination"] == {"limit": 3, "offset": 2, "count": 3} and len(tools.read(store, "memory://graph/5?depth=1")["related"]) > 0
    ask = lambda method, **params: tools.handle(store, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert len(ask("tools/list")["result"]["tools"]) == 8 and len(ask("resources/list")["result"]["resources"]) == 3 and ask("ping")["result"] == {}
    assert json.loads(ask("tools/call", name="nothing")["result"]["content"][0]["text"])["success"] is False
    assert ask("odd")["error"]["code"] == -32601 and ask("resources/read", uri="memory://odd")["error"]["code"] == -32603
    assert ask("resources/read", uri="memory://stats?limit=x")["error"]["code"] == -32602
    assert tools.handle(store, {"jsonrpc": "2.0", "method": "ping"}) is None


def test_gate():
    now = [0.0]
    gate = tools.Gate("secret", per_s=2, burst=2, clock=lambda: now[0])
    assert gate.admit("a", "wrong") == "unauthorized" and gate.admit("a") == "unauthorized"
    assert [gate.admit("a", "secret") for _ in range(3)] == [None, None, "rate_limited"] and gate.admit("b", "secret") is None
    now[0] = 0.5
    assert gate.admit("a", "secret") is None and gate.admit("a", "secret") == "rate_limited"


def test_sweeps_are_idempotent(spark, data):
    memories = load(spark, data).memories
    for rule in (lifecycle.expire_short_term, lifecycle.importance_decay, lifecycle.active_forgetting):
        once = rule(memories, NOW_MS).drop("changed")
        assert rule(once, NOW_MS).filter("changed").count() == 0


def test_config(tmp_path):
    for wrong in ({"odd": 1}, {"discovery_threshold": 2}, {"rrf_k": "many"}, {"rrf_k": True}, {"production": True}, {"workers": 0}, {"hard_forget": "perhaps"}):
        with pytest.raises(ValueError):
            Config.of(wrong)
    assert Config.of({"rrf_k": 10}).rrf_k == 10
    path = tmp_path / "engram.toml"
    path.write_text("rrf_k = 20\nretention_days = 7\nhard_forget = true\n")
    got = Config.load(str(path), {"ENGRAM_RETENTION_DAYS": "9", "ENGRAM_OTHER": "x", "ENGRAM_HARD_FORGET": "false"}, dimension=64)
    assert (got.rrf_k, got.retention_days, got.hard_forget, got.dimension) == (20, 9, False, 64)
    assert Config.load(env={"ENGRAM_PRODUCTION": "1", "ENGRAM_CHECKPOINT_DIR": "hdfs:///c"}).production


def test_empty_keyword_search(spark, data):
    t = load(spark, data)
    assert search.keyword(t.memories.limit(0), "en").count() == 0
