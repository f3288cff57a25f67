"""Connections between records: reading, discovering, creating and extracting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import entity_content
from ..functions.vectors import depth_score
from ..schema import MAX_ENTITIES, MAX_RELATIONSHIPS, RELATIONSHIPS, clamp
from .ann import ClusteredIndex
from .filters import live
from .graph import bfs
from .vector import knn_batch, similarity_join

THRESHOLD, NEIGHBORS = 0.7, 5
ENTITY_IMPORTANCE, RELATION_STRENGTH = 0.6, 0.8


def known_type(edge_type: Column, otherwise: str | None = "related_to") -> Column:
    return F.when(edge_type.isin(*RELATIONSHIPS), edge_type).otherwise(F.lit(otherwise))


def live_edges(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges whose two ends exist and are not archived."""
    ids = live(memories).select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def list_connections(edges: DataFrame, memories: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of live edges, by the time of the source record, then insertion."""
    times = memories.select(F.col("id").alias("src"), "created_at")
    rows = live_edges(edges, memories).join(times, "src")
    page = rows.orderBy("created_at", "src", "seq").offset(offset).limit(min(limit, 500))
    return page.select("src", "dst", "edge_type", "weight")


def nest_connections(memories: DataFrame, edges: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Records with an array of their outgoing connections, in order of insertion; edges of unknown types are left out.

    A record with very many connections has them in one row. With `limit` a row has a page of them, and tasks keep no
    more than a page's end per record; `graph.finalize` spreads them over rows.
    """
    known = edges.filter(F.col("edge_type").isin(*RELATIONSHIPS))
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("src").orderBy("seq", "dst", "edge_type"))
        known = known.withColumn("_place", place).filter(F.col("_place") <= offset + limit).filter(F.col("_place") > offset).drop("_place")
    link = F.struct("seq", F.col("dst").alias("target_id"), F.col("edge_type").alias("relationship_type"), F.col("weight").alias("strength"))
    nested = known.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(link)).alias("connections"))
    nested = nested.select("id", F.transform("connections", lambda c: c.dropFields("seq")).alias("connections"))
    empty = F.array().cast(nested.schema["connections"].dataType)
    return memories.join(nested, "id", "left").withColumn("connections", F.coalesce("connections", empty))


def find_related(edges: DataFrame, memories: DataFrame, start, depth: int = 1, edge_types: list[str] | None = None, limit: int = 20, direction: str = "outgoing") -> DataFrame:
    """Live records that a traversal reaches, without the start, nearest first."""
    reached = bfs(edges, start, min(depth, 5), edge_types, direction).filter(F.col("depth") > 0)
    rows = reached.withColumnRenamed("node", "id").join(live(memories), "id")
    rows = rows.select("id", "depth", known_type(F.col("edge_type")).alias("relationship_type"), F.col("weight").alias("strength"), F.round(depth_score(F.col("depth")), 6).alias("score"))
    return rows.orderBy("depth", "id").limit(min(limit, 100))


def without_linked(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (src, dst, ...) that no edge of any type links yet in that direction."""
    return candidates.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def discover_connections(memories: DataFrame, vectors: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBORS, block: int = 16_384, approximate: bool = False) -> DataFrame:
    """similar_to edges from every live record to its k best live neighbours of a score of `threshold` or more, but those linked already.

    Exact by default, with work that grows with the square of the records; `approximate` compares a record with the clusters next to it only.
    """
    usable = vectors.join(live(memories).select("id"), "id", "left_semi")
    found = ClusteredIndex.build(usable).links(threshold, k) if approximate else similarity_join(usable, threshold, k, block)
    return without_linked(found, edges).select("src", "dst", F.lit("similar_to").alias("edge_type"), F.col("score").alias("weight"))


def discover_for(ids: list, memories: DataFrame, vectors: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBORS) -> DataFrame:
    """The same for some records, all at once."""
    usable = vectors.join(live(memories).select("id"), "id", "left_semi")
    found = knn_batch(usable, usable.filter(F.col("id").isin(ids)), k).filter(F.col("score") >= threshold)
    return without_linked(found, edges).select("src", "dst", F.lit("similar_to").alias("edge_type"), F.col("score").alias("weight"))


def auto_discover(id_, memories: DataFrame, vectors: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBORS) -> DataFrame:
    """The same for one record."""
    return discover_for([id_], memories, vectors, edges, threshold, k)


def checked_connections(requests: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (src, dst, edge_type, weight): valid ones with clamped strength, and the others with an `error`."""
    ids = live(memories).select("id", F.lit(True).alias("there"))
    rows = requests.join(ids.withColumnsRenamed({"id": "src", "there": "s"}), "src", "left").join(ids.withColumnsRenamed({"id": "dst", "there": "d"}), "dst", "left")
    error = F.when(F.col("src") == F.col("dst"), "self_loop").when(F.col("s").isNull(), "source_missing").when(F.col("d").isNull(), "target_missing")
    error = error.when(~F.col("edge_type").isin(*RELATIONSHIPS), "type_unknown")
    rows = rows.withColumn("error", error).drop("s", "d")
    good = rows.filter("error is null").drop("error").withColumn("weight", clamp("weight", 0.0, 1.0))
    return good.select(*requests.columns), rows.filter("error is not null").select(*requests.columns, "error")


def extract_graph(requests: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Entity records and edges of create requests (id, graph_extraction).

    Each named entity becomes a long-term record, which its source references with weight 1; relationships join on the
    trimmed lower-cased names of the request's entities, where of equal names the last one counts. Relationships of an entity
    with itself or with unknown names are left out, unknown types become related_to.
    """
    named = requests.select(F.col("id").alias("parent"), F.posexplode(F.slice("graph_extraction.entities", 1, MAX_ENTITIES)).alias("pos", "e"))
    named = named.select("parent", "pos", F.trim("e.name").alias("label"), F.trim(F.coalesce("e.entity_type", F.lit("entity"))).alias("kind"), F.nullif(F.trim("e.description"), F.lit("")).alias("about"))
    named = named.filter(F.coalesce("label", F.lit("")) != "")
    entities = named.select(
        "parent", "pos",
        F.concat_ws(":", F.col("parent").cast("string"), F.lit("entity"), F.col("pos").cast("string")).alias("id"),
        F.lower("label").alias("name"),
        entity_content(F.col("label"), F.col("kind"), F.col("about")).alias("content"),
        F.array(F.lit("__entity__"), F.concat(F.lit("entity:"), F.col("kind"))).alias("tags"),
    )
    records = entities.select("id", "content", F.lit("long_term").alias("memory_type"), F.lit("graph_extraction").alias("source"), "tags", F.lit(ENTITY_IMPORTANCE).alias("importance"), F.lit(now_ms).alias("created_at"))
    references = entities.select(F.col("parent").cast("string").alias("src"), F.col("id").alias("dst"), F.lit("references").alias("edge_type"), F.lit(1.0).alias("weight"))
    last = entities.groupBy("parent", "name").agg(F.max_by("id", "pos").alias("id"))
    links = requests.select(F.col("id").alias("parent"), F.explode(F.slice("graph_extraction.relationships", 1, MAX_RELATIONSHIPS)).alias("r")).select(
        "parent", F.lower(F.trim("r.source")).alias("a"), F.lower(F.trim("r.target")).alias("b"),
        known_type(F.col("r.relationship_type")).alias("edge_type"), F.coalesce(clamp(F.col("r.strength"), 0.0, 1.0), F.lit(RELATION_STRENGTH)).alias("weight"),
    )
    links = links.join(last.withColumnsRenamed({"name": "a", "id": "src"}), ["parent", "a"]).join(last.withColumnsRenamed({"name": "b", "id": "dst"}), ["parent", "b"])
    links = links.filter("src <> dst")
    return records, references.unionByName(links.select("src", "dst", "edge_type", "weight"))
