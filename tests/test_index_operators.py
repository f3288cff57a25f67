import pytest

from pyspark.sql import functions as F

from engram.functions import tokens as T
from engram.operators import fusion, graph, tags, timeline


def keys(df, column="key"):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [("doc1", "rust"), ("doc1", "programming"), ("doc2", "rust"), ("doc2", "web"), ("doc3", "programming")]
    return spark.createDataFrame([(k, t, 1.0) for k, t in rows], "key string, token string, score double")


def test_tag_and_or(tagged):
    assert keys(tags.search_and(tagged, ["rust", "programming"])) == ["doc1"]
    assert keys(tags.search_and(tagged, ["rust", "nothing"])) == []
    assert keys(tags.search_and(tagged, [])) == []
    assert sorted(keys(tags.search_or(tagged, ["web", "PROGRAMMING"]))) == ["doc1", "doc2", "doc3"]
    assert sorted(keys(tags.search(tagged, "RUST"))) == ["doc1", "doc2"]
    assert tags.has_token(tagged, "doc1", "Rust") and not tags.contains_key(tagged, "doc9")


def test_tag_scores(tagged):
    got = {r["key"]: r["score"] for r in tags.search_or_scored(tagged, ["rust", "rust", "web"]).collect()}
    assert got == {"doc1": 2.0, "doc2": 3.0}
    step = {r["key"]: (r["score"], r["tags"]) for r in tags.tag_step(tagged, ["rust", "web"]).collect()}
    assert step == {"doc1": (0.5, ["rust"]), "doc2": (1.0, ["rust", "web"])}
    assert {r["score"] for r in tags.tag_step(tagged, ["rust"], match_all=True).collect()} == {1.0}


def test_text_postings(spark):
    texts = spark.createDataFrame([("a", "rust rust programming"), ("b", "Rust, programming!"), ("c", "a ab abc abcd snake_case")], "key string, text string")
    p = tags.text_postings(texts)
    assert keys(tags.search_scored(p, "rust")) == ["a", "b"]
    assert sorted(r["token"] for r in tags.tokens_of(tags.text_postings(texts, min_bytes=3), "c").collect()) == ["abc", "abcd", "snake_case"]
    assert {r["token"]: r["docs"] for r in tags.vocabulary(p).collect()}["rust"] == 2
    assert keys(tags.search(tags.remove_document(p, texts.filter("key = 'a'")), "rust")) == ["b"]


def test_keys_and_params(spark):
    row = spark.range(1).select(
        T.memory_id(T.memory_key(F.lit("x"))).alias("id"),
        T.parse_list(F.lit(" a, ,b ")).alias("parts"),
        T.parse_time_ms(F.lit("2024-02-10T00:00:00Z")).alias("ms"),
        T.parse_time_ms(F.lit("never")).alias("none"),
    ).first()
    assert (row["id"], row["parts"], row["ms"], row["none"]) == ("x", ["a", "b"], 1707523200000, None)


def test_timeline(spark):
    t = spark.createDataFrame([(f"k{i}", i * 100) for i in range(10)], "key string, ts long")
    assert keys(timeline.between(t, 200, 500), "ts") == [200, 300, 400, 500]
    assert keys(timeline.between(t, 200, 500, 2), "ts") == [200, 300]
    assert keys(timeline.before(t, 500, 3), "ts") == [400, 300, 200]
    assert keys(timeline.after(t, 500, 3), "ts") == [600, 700, 800]
    assert keys(timeline.latest(t, 2), "ts") == [900, 800] and keys(timeline.oldest(t, 2), "ts") == [0, 100]
    assert keys(timeline.at(t, 300)) == ["k3"] and keys(timeline.timestamp_of(t, "k3"), "ts") == [300]
    moved = timeline.upsert(t, spark.createDataFrame([("k0", 2000)], "key string, ts long"))
    assert keys(timeline.timestamp_of(moved, "k0"), "ts") == [2000] and moved.count() == 10
    assert timeline.remove(t, t.filter("ts < 300")).count() == 7
    empty = timeline.bounds(t.limit(0)).first()
    assert empty["min_ts"] is None and empty["entries"] == 0
    assert keys(timeline.scan(t, 0, 900, 2, descending=True), "ts") == [900, 800]
    assert keys(timeline.scan(t, 0, 900, 2, descending=True, legacy_order=True), "ts") == [100, 0]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("A", "B", "related", 1.0, 1), ("B", "C", "related", 1.0, 2), ("C", "D", "related", 1.0, 3), ("A", "X", "unrelated", 0.5, 4)]
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, weight double, seq long")


def depths(df):
    return {r["node"]: r["depth"] for r in df.collect()}


def test_bfs(edges):
    assert depths(graph.bfs(edges, "A", 3)) == {"A": 0, "B": 1, "X": 1, "C": 2, "D": 3}
    assert depths(graph.bfs(edges, "A", 1, ["related"])) == {"A": 0, "B": 1}
    assert depths(graph.bfs(edges, "D", 2, direction="incoming")) == {"D": 0, "C": 1, "B": 2}
    assert depths(graph.bfs(edges, "nobody", 2)) == {}
    assert depths(graph.bfs(edges, "D", 0)) == {"D": 0}


def test_graph_edits(spark, edges):
    more = graph.add_edges(edges, edges.filter("src = 'A' and dst = 'B'").withColumn("weight", edges["weight"] * 9).withColumn("seq", edges["seq"] + 100))
    assert more.count() == 4 and more.filter("dst = 'B'").first()["weight"] == 9
    pair = spark.createDataFrame([("A", "B", None, None, 1)], edges.schema)
    mirrored = graph.add_edges(edges.limit(0), pair, undirected=True)
    assert sorted((r["src"], r["edge_type"], r["weight"]) for r in mirrored.collect()) == [("A", "", 1.0), ("B", "", 1.0)]
    assert graph.remove_edges(mirrored, pair, undirected=True).count() == 0
    assert graph.has_edge(edges, "A", "B") and not graph.has_edge(edges, "B", "A")
    assert graph.remove_nodes(edges, spark.createDataFrame([("B",)], "node string")).count() == 2
    assert graph.contains_node(edges, "X") and graph.counts(edges).first().asDict() == {"node_count": 5, "edge_count": 4}
    with pytest.raises(ValueError):
        graph.oriented(edges, "sideways")


def test_adjacency(spark, edges):
    for most in (10_000, 1):
        rows = graph.finalize(edges, most)
        assert sorted(map(tuple, graph.unfinalize(rows).collect())) == sorted(map(tuple, edges.collect()))
    hub = spark.range(60).selectExpr("'H' AS src", "cast(id AS string) AS dst", "'' AS edge_type", "1.0D AS weight", "id AS seq")
    assert graph.finalize(hub).count() == 1 and 4 <= graph.finalize(hub, 10).count() <= 6 and graph.unfinalize(graph.finalize(hub, 10)).count() == 60


def test_paths(spark, edges):
    more = edges.unionByName(spark.createDataFrame([("D", "A", "back", 1.0, 9)], edges.schema))
    hops = lambda *a: {r["node"]: r["hops"] for r in graph.paths(more, *a).collect()}
    assert hops("A", 2) == {"B": 1, "X": 1, "C": 2} and hops("A", 9) == {"B": 1, "X": 1, "C": 2, "D": 3, "A": 4}
    # The type need only occur on the way: D leads back by `back`, and on from there by any type.
    assert hops("C", 4, "back") == {"A": 2, "B": 3, "X": 3, "C": 4}
    assert hops("A", 3, "unrelated") == {"X": 1} and hops("nobody", 3) == {} and hops("A", 0) == {}


def test_segments(spark):
    old = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "key string, token string, score double")
    new = spark.createDataFrame([("a", "x", 5.0), ("c", "x", 1.0)], old.schema)
    assert {r["key"]: r["score"] for r in tags.search_segments([old, new], ["x"]).collect()} == {"a": 6.0, "b": 3.0, "c": 1.0}
    assert sorted(map(tuple, tags.merge_segments([old, new]).collect())) == [("a", "x", 5.0), ("b", "x", 3.0), ("c", "x", 1.0)]


def test_tag_edits(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], "id long, tags array<string>")
    assert tags.add_tags(rows, ["b", "c", "", "x" * 101]).first()["tags"] == ["a", "b", "c"]
    assert tags.set_tags(rows, ["z", "z"]).first()["tags"] == ["z"] and tags.set_tags(rows, []).first()["tags"] == []


def ranked(spark, rows):
    return spark.createDataFrame(rows, "key string, score double")


def test_fusion(spark):
    lists = {"vector": ranked(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7)]), "tag": ranked(spark, [("b", 0.95), ("a", 0.85), ("d", 0.75)])}
    got = {r["key"]: r for r in fusion.rrf(lists).collect()}
    assert got["a"]["score"] == got["b"]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    assert got["c"]["score"] == got["d"]["score"] == pytest.approx(1 / 63, abs=1e-8)
    assert got["a"]["source"] == "hybrid" and got["d"]["source"] == "tag"
    two = {"vector": ranked(spark, [("a", 0.9), ("b", 0.8)]), "tag": ranked(spark, [("b", 0.95), ("c", 0.75)])}
    assert [(r["key"], r["score"]) for r in fusion.intersection(two).collect()] == [("b", 0.875)]
    assert {r["key"]: r["score"] for r in fusion.union(two).collect()} == {"a": 0.9, "b": 0.95, "c": 0.75}
    one = {"vector": ranked(spark, [("a", 0.8)]), "tag": ranked(spark, [("a", 0.6)])}
    assert [r["score"] for r in fusion.weighted(one, weights={"vector": 2.0}).collect()] == [1.0]
    scaled = fusion.min_max_normalized(fusion.concat({"x": ranked(spark, [("p", 10.0), ("q", 5.0), ("r", 0.0)])}))
    assert {r["key"]: r["score"] for r in scaled.collect()} == {"p": 1.0, "q": 0.5, "r": 0.0}
    assert fusion.rrf(lists, 2).count() == 2
