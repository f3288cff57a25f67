"""Runs the headline queries and prints one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from engram import catalogue
from engram.operators import search, vector
from engram.operators.ann import ClusteredIndex
from engram.sources.fixtures import load

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The number of stored vectors that the published search latency of the baseline is for.
VECTORS = 100_000
HEADLINE = ["vector_topk", "knn_batch", "hybrid_search", "hybrid_with_graph", "keyword_search", "graph_bfs", "discover_connections", "expire_short_term", "importance_decay", "active_forgetting", "changelog_fold", "text_tf", "list_connections", "stats"]


def run(df) -> float:
    """Seconds to compute all rows."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def many_vectors(spark, t):
    """VECTORS vectors, made from the stored ones: each copy moved by a small step of its own."""
    n = t.vectors.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(-(-VECTORS // n) - 1)))
    moved = t.vectors.select("id", "embedding", copies.alias("copy"))
    step = F.transform("embedding", lambda x, i: (x + F.sin(F.col("copy") * 7 + i) * 0.1).cast("float"))
    rows = moved.select((F.col("id") + F.col("copy") * n).cast("long").alias("id"), step.alias("embedding"))
    return rows.filter(F.col("id") < VECTORS).repartition(int(CPUS)).cache()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in only:
        best = []
        for _ in range(3):  # the first run also compiles
            began = time.perf_counter()
            run(catalogue.QUERIES[name](spark, SF_DIR))
            best.append(time.perf_counter() - began)
        seconds[name] = round(min(best), 4)
    extra = {}
    if not sys.argv[1:]:
        # Many queries in one job: the batched counterpart of a latency, over as many vectors as the published one is for.
        t = load(spark, SF_DIR)
        many = many_vectors(spark, t)
        held = many.count()
        asks = many.filter(F.col("id") % (VECTORS // 2000) == 0)
        extra["vectors"] = held
        extra["knn_queries_per_s"] = round(2000 / min(run(vector.knn_batch(many, asks, 10)) for _ in range(2)), 1)
        one = list(asks.first()["embedding"])
        extra["topk_s"] = round(min(run(vector.top_k(many, one, 10)) for _ in range(3)), 4)
        began = time.perf_counter()
        index = ClusteredIndex.build(many)
        index.rows = index.rows.cache()
        index.rows.count()
        extra["index_build_s"] = round(time.perf_counter() - began, 2)
        extra["index_knn_queries_per_s"] = round(2000 / min(run(index.knn(asks, 10)) for _ in range(2)), 1)
        exact = vector.knn_batch(many, asks, 10)
        hits = exact.join(index.knn(asks, 10).select("src", "dst"), ["src", "dst"], "left_semi").count()
        extra["index_recall"] = round(hits / exact.count(), 4)
        # All stored vectors as queries of the hybrid search, in one job.
        words = F.element_at(F.array(F.lit("en src1 b3"), F.lit("fr src2"), F.lit("de b1 b2")), (F.col("id") % 3 + 1).cast("int"))
        queries = t.vectors.select(F.col("id").alias("qid"), "embedding", words.alias("text"))
        n = queries.count()
        extra["hybrid_batch_ops_per_s"] = round(n / min(run(search.hybrid_batch(t.memories, t.vectors, queries)) for _ in range(2)), 1)
        rows = t.memories.count()
        extra["decay_rows_per_s"] = round(rows / seconds["importance_decay"], 1)
        events = spark.read.parquet(f"{SF_DIR}/events.parquet").agg(F.count("*")).first()[0]
        extra["fold_rows_per_s"] = round(events / seconds["changelog_fold"], 1)
        extra["hybrid_single_ops_per_s"] = round(1 / seconds["hybrid_search"], 2)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
