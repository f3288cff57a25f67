"""Memories, edges, vectors and a timeline derived from the driver's tables, in one SQL text for Spark and DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RELATIONSHIPS

#: 2024-02-10T00:00:00Z; rules never read the wall clock.
NOW_MS = 1707523200000

MEMORIES = """
SELECT id, content, source,
 CASE WHEN arousal >= 8e-1 THEN 'long_term' WHEN id % 5 < 2 THEN 'short_term' ELSE 'long_term' END AS memory_type,
 {arr}(lang, source, concat('b', CAST(id % 7 AS STRING))) AS tags,
 CASE WHEN arousal >= 8e-1 THEN greatest(imp, 9e-1) ELSE imp END AS importance,
 CAST((id * 29) % 200 - 100 AS DOUBLE) / 1e2 AS emotional_valence,
 arousal,
 CAST((id * 41) % 101 AS DOUBLE) AS health,
 created_at,
 created_at + (id % 10) * 86400000 AS updated_at,
 created_at + (id % 8) * 86400000 AS accessed_at,
 CAST(id % 6 AS INT) AS access_count,
 CASE WHEN id % 3 = 0 THEN created_at + (id % 9) * 86400000 END AS last_recalled_at,
 CASE WHEN arousal >= 8e-1 THEN created_at + 2592000000 END AS flashbulb_until,
 CASE WHEN arousal < 8e-1 AND id % 5 < 2 THEN 3600 + (id % 40) * 86400 END AS ttl,
 CAST(NULL AS BIGINT) AS last_decay_at,
 CAST(NULL AS BIGINT) AS last_health_check_at,
 id % 17 = 0 AS archived
FROM (
 SELECT doc_id AS id, text AS content, lang, source,
  1704067200000 + ((doc_id * 7919) % 2592000) * 1000 AS created_at,
  CAST((doc_id * 53) % 100 AS DOUBLE) / 1e2 AS arousal,
  CAST((doc_id * 37) % 1000 AS DOUBLE) / 1e3 AS imp
 FROM {documents}) b"""


def _edge_type(shift: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(RELATIONSHIPS[:-1]))
    return f"CASE (doc_id + {shift}) % 8 {cases} ELSE '{RELATIONSHIPS[-1]}' END"


EDGES = f"""
SELECT * FROM (
 SELECT doc_id AS src, (doc_id * 7 + 3) % (SELECT count(*) FROM {{documents}}) AS dst, {_edge_type(0)} AS edge_type,
  CAST((doc_id * 11) % 100 AS DOUBLE) / 1e2 AS weight, CAST(1 AS BIGINT) AS seq FROM {{documents}}
 UNION ALL
 SELECT doc_id, (doc_id * 13 + 5) % (SELECT count(*) FROM {{documents}}), {_edge_type(1)},
  CAST((doc_id * 11 + 7) % 100 AS DOUBLE) / 1e2, CAST(2 AS BIGINT) FROM {{documents}}) e
WHERE src <> dst"""

VECTORS = "SELECT vec_id AS id, embedding FROM {embeddings}"


@dataclass
class Tables:
    """The tables that operators work on."""

    memories: DataFrame
    edges: DataFrame
    vectors: DataFrame
    timeline: DataFrame

    def with_string_ids(self) -> Tables:
        """The same with ids as strings, which extracted entities need."""
        text = lambda df, *names: df.withColumns({c: F.col(c).cast("string") for c in names})
        return Tables(text(self.memories, "id"), text(self.edges, "src", "dst"), text(self.vectors, "id"), text(self.timeline, "key"))


def load(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    documents, embeddings = read("documents"), read("embeddings")
    sql = lambda text, **frames: spark.sql(text.format(arr="array", **{k: "{" + k + "}" for k in frames}), **frames)
    return Tables(
        memories=sql(MEMORIES, documents=documents),
        edges=sql(EDGES, documents=documents),
        vectors=sql(VECTORS, embeddings=embeddings),
        timeline=read("events").selectExpr("event_id AS key", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts"),
    )


def duckdb_views() -> str:
    """The same tables as common table expressions for DuckDB."""
    one = {"arr": "list_value", "documents": "documents", "embeddings": "embeddings"}
    return (
        f"memories AS ({MEMORIES.format(**one)}),\nedges AS ({EDGES.format(**one)}),\nvectors AS (SELECT id, embedding::DOUBLE[] AS v FROM ({VECTORS.format(**one)})),\n"
        "timeline AS (SELECT event_id AS key, epoch_us(ts)//1000 AS ts FROM events)"
    )
