import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import vectors as V
from engram.functions.embedding import QueryEmbedder, embed, hashed_embeddings, with_vectors
from engram.operators import vector
from engram.operators.ann import ClusteredIndex
from engram.schema import Metric


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*v):
    return V.literal(v)


def test_distances(spark):
    a, b = lit(1, 2, 3), lit(4, 5, 6)
    assert value(spark, V.l2_squared(a, b)) == 27
    assert value(spark, V.dot_product(a, b)) == 32
    assert value(spark, V.magnitude(lit(3, 4, 0))) == 5
    assert value(spark, V.magnitude_squared(lit(3, 4, 0))) == 25
    assert value(spark, V.l2(a, b)) == pytest.approx(math.sqrt(27))


@pytest.mark.parametrize(("b", "cosine"), [((1, 0), 1.0), ((0, 1), 0.0), ((-1, 0), -1.0), ((0, 0), 0.0)])
def test_cosine(spark, b, cosine):
    assert value(spark, V.cosine_similarity(lit(1, 0), lit(*b))) == cosine
    assert value(spark, V.cosine_distance(lit(1, 0), lit(*b))) == 1 - cosine


def test_normalize(spark):
    assert value(spark, V.normalize(lit(3, 4))) == [0.6, 0.8]
    assert value(spark, V.normalize(lit(0, 0))) == [0.0, 0.0]


def test_conversions(spark):
    assert value(spark, V.distance_to_score(F.lit(0.0))) == 1.0
    assert value(spark, V.to_similarity(Metric.COSINE, F.lit(0.25))) == 0.75
    assert value(spark, V.to_similarity(Metric.DOT, F.lit(-3.0))) == 3.0
    assert value(spark, V.to_distance(Metric.L2, F.lit(0.5))) == 0.5
    assert value(spark, V.depth_score(F.lit(3))) == 0.25


def table(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>")


def test_top_k(spark):
    line = table(spark, [(i, 0, 0, 0) for i in range(100)])
    got = [r["id"] for r in vector.top_k(line, [50, 0, 0, 0], 5).collect()]
    assert got == [50, 49, 51, 48, 52]
    trio = table(spark, [(1, 0, 0), (0, 1, 0), (0.707, 0.707, 0)])
    assert [r["id"] for r in vector.top_k(trio, [1, 0, 0], 3, Metric.COSINE).collect()] == [0, 2, 1]


def test_dimension(spark):
    with pytest.raises(ValueError):
        vector.check_dimension(table(spark, [(1, 2)]), [1, 2, 3])
    vector.check_dimension(table(spark, [(1, 2)]), [1, 2])


def brute(points, ids, k, threshold=-1.0):
    out = set()
    for i in ids:
        score = np.round(1 / (1 + ((points - points[i]) ** 2).sum(1)), 6)
        best = sorted((-s, j) for j, s in enumerate(score) if j != i and s >= threshold)[:k]
        out |= {(i, j, rank + 1) for rank, (_, j) in enumerate(best)}
    return out


def test_knn_batch_and_join(spark):
    points = np.random.RandomState(1).rand(120, 8).astype(np.float32).astype(np.float64)
    t = table(spark, points)
    got = vector.knn_batch(t, t.filter("id % 7 = 0"), 4, block=5)
    assert {(r["src"], r["dst"], r["rank"]) for r in got.collect()} == brute(points, range(0, 120, 7), 4)
    for block in (40, 1000):
        got = vector.similarity_join(t, 0.5, 3, block)
        assert {(r["src"], r["dst"], r["rank"]) for r in got.collect()} == brute(points, range(120), 3, 0.5)


def test_knn_without_rows(spark):
    t = table(spark, [(1, 2)])
    assert vector.knn_batch(t, t.limit(0), 3).count() == 0
    assert vector.similarity_join(t.limit(0), 0.5, 3).count() == 0


def test_dimensions_are_checked_while_searching(spark):
    two = table(spark, [(1, 2), (3, 4)])
    for run in (lambda: vector.top_k(two, [1, 2, 3], 1), lambda: vector.knn_batch(two, table(spark, [(1, 2, 3)]), 1), lambda: vector.upsert(two, table(spark, [(1, 2, 3)]), 2)):
        with pytest.raises(Exception, match="dimensions"):
            run().collect()
    null = two.unionByName(spark.createDataFrame([(9, None)], two.schema))
    assert vector.top_k(null, [1, 2], 5).count() == 2 and vector.knn_batch(null, null, 5, skip_self=False).count() == 4


def test_vectors_are_replaced_and_removed(spark):
    t = table(spark, [(1, 2), (3, 4)])
    new = spark.createDataFrame([(1, [9.0, 9.0]), (5, [5.0, 5.0])], t.schema)
    assert {r["id"]: list(r["embedding"]) for r in vector.upsert(t, new).collect()} == {0: [1, 2], 1: [9, 9], 5: [5, 5]}
    assert [r["id"] for r in vector.remove(t, new).collect()] == [0]
    records = spark.createDataFrame([(0, "zero")], "id long, content string")
    assert [(r["id"], r["content"]) for r in vector.top_k_with_values(t, records, [1, 2], 5).collect()] == [(0, "zero")]


def test_every_metric_ranks_as_its_expression(spark):
    points = np.random.RandomState(5).normal(size=(50, 6)).astype(np.float32).astype(np.float64)
    t, q = table(spark, [*points, [0.0] * 6]), points[3].tolist()
    for metric in Metric:
        d = V.distance(metric, V.doubles("embedding"), V.literal(q))
        want = {r["id"]: r["d"] for r in t.select("id", d.alias("d")).collect()}
        assert {r["id"]: r["distance"] for r in vector.scored(t, q, metric).collect()} == pytest.approx(want)
        assert [r["id"] for r in vector.top_k(t, q, 7, metric).collect()] == [r["id"] for r in vector.scored(t, q, metric).orderBy(F.desc("score"), "id").limit(7).collect()]


def recall(exact, found):
    want = {(r["src"], r["dst"]) for r in exact.collect()}
    return len(want & {(r["src"], r["dst"]) for r in found.collect()}) / len(want)


def test_clustered_index_recall(spark, tmp_path):
    points = np.random.RandomState(2).normal(size=(1000, 32))
    t = table(spark, points)
    index = ClusteredIndex.build(t)
    asks = t.filter("id < 10")
    exact = vector.knn_batch(t, asks, 10, skip_self=False)
    assert recall(exact, index.knn(asks, 10, skip_self=False)) > 0.9
    assert recall(exact, index.knn(asks, 10, ef=1000, skip_self=False, block=100)) == 1
    one = {r["id"] for r in index.search(points[3].tolist(), 10).collect()}
    assert one == {r["dst"] for r in index.knn(t.filter("id = 3"), 10, skip_self=False).collect()}
    index.save(str(tmp_path / "index"))
    again = ClusteredIndex.load(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and {r["id"] for r in again.search(points[3].tolist(), 10).collect()} == one
    with pytest.raises(ValueError):
        again.search([1.0, 2.0], 3)


def test_clustered_links(spark):
    rng = np.random.RandomState(3)
    base = rng.normal(size=(40, 16)) * 3
    points = (base[rng.randint(0, 40, 800)] + rng.normal(size=(800, 16)) * 0.1).astype(np.float32).astype(np.float64)
    t = table(spark, points)
    exact, found = vector.similarity_join(t, 0.7, 5), ClusteredIndex.build(t).links(0.7, 5)
    assert exact.count() > 1000 and recall(exact, found) > 0.95 and found.filter("score < 0.7 or src = dst or rank > 5").count() == 0
    few = ClusteredIndex.build(t.limit(0))
    assert few.search([0.0] * 16, 3).count() == 0 and few.links(0.5, 3).count() == 0


def test_embedding(spark):
    red, none, same = hashed_embeddings(["red green blue", None, "RED  green\nblue"])
    assert red @ red == pytest.approx(1) and not none.any() and (red == same).all()
    records = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id long, content string")
    stored = spark.createDataFrame([(2, [1.0, 0.0])], "id long, embedding array<float>")
    got = {r["id"]: list(r["embedding"]) for r in with_vectors(records, stored).collect()}
    assert got[2] == [1.0, 0.0] and not any(got[3])
    assert np.allclose(got[1], hashed_embeddings(["a b"])[0])


def test_texts_are_embedded_in_batches(spark):
    def sizes(texts):
        return np.full((len(texts), 1), len(texts))

    rows = spark.range(70).coalesce(1).select(embed(F.col("id").cast("string"), sizes).alias("v"))
    assert sorted(r["v"][0] for r in rows.collect()) == [6.0] * 6 + [32.0] * 64
    ask = QueryEmbedder(most=2)
    for text in ("a", "b", "a", "c", "b"):
        ask(text)
    assert (ask.hits, ask.misses) == (1, 4)
