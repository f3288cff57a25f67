"""What only larger tables than the smallest ones hold: long texts, and more rows than one block, group or batch has."""

import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram import catalogue
from engram.operators import search, vector

from .oracle import assert_same


@pytest.fixture(scope="module")
def long_texts(data, tmp_path_factory):
    """The driver's tables with a text of over 100,000 bytes in every 11th document."""
    folder = str(tmp_path_factory.mktemp("long"))
    for name in os.listdir(data):
        if name != "documents.parquet":
            os.symlink(f"{data}/{name}", f"{folder}/{name}")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 11 = 1 THEN repeat('é ', 40_000) ELSE text END AS text) FROM '{data}/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder


def test_create_errors_of_long_texts(spark, long_texts):
    assert assert_same(catalogue.QUERIES["create_errors"](spark, long_texts), catalogue.ORACLE_SQL["create_errors"], long_texts)


def test_create_records_of_long_texts(spark, long_texts):
    assert assert_same(catalogue.QUERIES["create_records"](spark, long_texts), catalogue.ORACLE_SQL["create_records"], long_texts)


def rows_made(df, kind):
    """Rows out of the plan's operators of a kind, each, once df is collected."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        elif name.endswith("QueryStageExec"):
            plan = plan.plan()
        else:
            if kind in name:
                yield plan.metrics().apply("numOutputRows").value()
            children = plan.children()
            for i in range(children.size()):
                yield from walk(children.apply(i))
            return
        yield from walk(plan)

    return list(walk(df._jdf.queryExecution().executedPlan()))


def records(spark, n):
    tags = F.array(F.concat(F.lit("a"), F.col("id") % 3), F.concat(F.lit("b"), F.col("id") % 5), F.concat(F.lit("c"), F.col("id") % 2))
    return spark.range(n).select("id", tags.cast("array<string>").alias("tags"), F.lit("long_term").alias("memory_type"), F.lit(None).cast("long").alias("flashbulb_until"), (F.col("id") % 7 == 0).alias("archived"))


def points(n, dim=8):
    return np.random.RandomState(n).normal(size=(n, dim)).astype(np.float32)


def vectors(spark, found):
    return spark.createDataFrame(pa.table({"id": np.arange(len(found)), "embedding": pa.array(list(found), pa.list_(pa.float32()))}))


def test_words_of_many_queries_do_not_meet_every_record(spark):
    found = vectors(spark, points(2000))
    asked = found.filter("id < 300").select(F.col("id").alias("qid"), "embedding", F.when(F.col("id") % 2 == 0, "a1 b2 c0").otherwise("b3 A0 a0").alias("text"))
    made = rows_made(search.hybrid_batch(records(spark, 2000), found, asked, 10), "Join")
    assert max(made) <= 300 * 60  # a list for each query; words met 400,000 records


def test_tag_lists_are_the_best_records_of_each_query(spark):
    memories, k = records(spark, 90), 7
    texts = {1: ["a1", "b2"], 2: ["b2", "a1"], 3: ["c0", "c0", "a2"], 4: ["none"], 5: ["__type:long_term"], 6: ["b4", "c1", "a0", "__archived__"]}
    words = spark.createDataFrame([(q, t, float(own.count(t))) for q, own in texts.items() for t in set(own)], "qid long, token string, times double")
    want = set()
    for q, own in texts.items():
        scores = {i: sum(t in (f"a{i % 3}", f"b{i % 5}", f"c{i % 2}", "__type:long_term", "__archived__" if i % 7 == 0 else "") for t in own) for i in range(90)}
        best = sorted((-s, i) for i, s in scores.items() if s)[:k]
        want |= {(q, i, float(-s), r + 1) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in search.tag_lists(memories, words, k).select("qid", "key", "score", "rank").collect()} == want


def test_cells_are_few_copies_of_each_vector(spark):
    made = [sum(rows_made(vector.knn_batch(t, t, 3, block=5), "Generate")) for t in (vectors(spark, points(n)) for n in (500, 1500))]
    assert made[1] <= 3.1 * made[0]  # grew with the square: nine-fold


@pytest.mark.parametrize("copies", [1, 40])
@pytest.mark.parametrize("skip_self", [True, False])
def test_nearest_in_tiles(copies, skip_self, monkeypatch):
    """As brute force, whatever the tiles, the order and the number of equal vectors."""
    for name, n in {"STRIP": 50, "TILE": 70, "FIRST": 30, "PAIRS": 500}.items():
        monkeypatch.setattr(vector, name, n)
    rng = np.random.RandomState(copies)
    others, keys = points(400)[rng.randint(0, 400 // copies, 400)], rng.permutation(400)
    for least in (0.0, 0.12):
        best = vector.Nearest(keys[:90], others[:90], 6, least, skip_self)
        for a in range(0, 400, 130):
            best.add(keys[a : a + 130], others[a : a + 130])
        want = []
        for i, p in zip(keys[:90], others[:90].astype(float)):
            score = np.round(1 / (1 + ((others - p) ** 2).sum(1)), 6)
            near = sorted((-s, j) for s, j in zip(score, keys) if s >= least and not (skip_self and i == j))[:6]
            want += [(i, j, -s) for s, j in near]
        assert sorted(zip(*(c.to_pylist() for c in best.batch().columns))) == sorted(want)


def test_a_cell_of_full_blocks_takes_little_memory(spark, monkeypatch):
    step = {}
    few = vectors(spark, points(10))
    kind = type(few.groupBy("id"))
    monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema, run=kind.applyInArrow: step.update(f=f) or run(self, f, schema))
    vector.similarity_join(few, 0.45, 5)
    n = 16_384
    table = pa.table({"blk": pa.array(np.zeros(n, np.int32)), "id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(points(n, 16).ravel()), 16).cast(pa.list_(pa.float32()))})
    tracemalloc.start()
    step["f"]((pa.scalar(0), pa.scalar(0)), table)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60
