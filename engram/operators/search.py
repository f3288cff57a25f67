"""Search and listing over records, composed of the index operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import index_tags, matched_tokens, query_tokens
from ..functions.vectors import depth_score
from ..runtime import materialized, settled
from . import fusion
from .filters import live
from .graph import bfs
from .tags import search_or_scored, tag_postings, valid_query
from .vector import knn_batch, top_k

MAX_LIMIT = 100
CONTEXT_DEPTH = 2


def pool_size(limit: int) -> int:
    """How many candidates a fused search takes before it filters."""
    return max(3 * limit, 20)


def semantic(memories: DataFrame, vectors: DataFrame, query: Sequence[float], where: Column | None = None, limit: int = 10) -> DataFrame:
    """id and score of the live, filtered records nearest to the query: filters first, so the limit is always met if it can be."""
    rows = live(memories).filter(F.lit(True) if where is None else where).select("id")
    usable = vectors.join(rows, "id", "left_semi")
    return top_k(usable, query, min(limit, MAX_LIMIT)).select("id", "score")


def _keyed(df: DataFrame, score: str = "score") -> DataFrame:
    return df.select(F.col(df.columns[0]).alias("key"), F.col(score).alias("score"))


def vector_branch(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    return _keyed(top_k(vectors, query, k))


def tag_branch(memories: DataFrame, query: str, k: int) -> DataFrame:
    """Summed tag scores over their maximum."""
    return search_or_scored(tag_postings(memories), query_tokens(query)).orderBy(F.desc("score"), "key").limit(k)


def graph_branch(edges: DataFrame, start, depth: int, k: int, edge_types: list[str] | None = None, direction: str = "outgoing") -> DataFrame:
    reached = bfs(edges, start, depth, edge_types, direction).filter(F.col("depth") > 0)
    return reached.select(F.col("node").alias("key"), F.round(depth_score(F.col("depth")), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def _hydrated(fused: DataFrame, memories: DataFrame, where: Column | None, limit: int) -> DataFrame:
    """Records of a fused pool, archived and filtered ones dropped only now: the pool keeps its size."""
    # The pool has a few hundred rows at most, so it may be broadcast.
    rows = live(memories).filter(F.lit(True) if where is None else where).join(F.broadcast(fused), memories["id"] == fused["key"])
    return rows.select("id", "score", fused["source"].alias("source")).orderBy(F.desc("score"), "id").limit(limit)


def semantic_with_context(memories: DataFrame, vectors: DataFrame, edges: DataFrame, query: Sequence[float], related_to, where: Column | None = None, limit: int = 10) -> DataFrame:
    limit = min(limit, MAX_LIMIT)
    k = pool_size(limit)
    fused = fusion.rrf({"vector": vector_branch(vectors, query, k), "graph": graph_branch(edges, related_to, CONTEXT_DEPTH, 2 * k)}, k)
    return _hydrated(fused, memories, where, limit)


def hybrid(memories: DataFrame, vectors: DataFrame, edges: DataFrame, query_vector: Sequence[float], query: str, related_to=None, where: Column | None = None, limit: int = 10, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """Vector, tag and optional graph lists fused by reciprocal rank, then filtered."""
    limit = min(limit, MAX_LIMIT)
    k = pool_size(limit)
    lists = {"vector": vector_branch(vectors, query_vector, k), "tag": tag_branch(memories, query, 2 * k)}
    if related_to is not None:
        lists["graph"] = graph_branch(edges, related_to, CONTEXT_DEPTH, 2 * k)
    return _hydrated(fusion.rrf(lists, k, rrf_k), memories, where, limit)


def keyword(memories: DataFrame, query: str, where: Column | None = None, limit: int = 10) -> DataFrame:
    """id and score: half the summed tag scores and half the share of tokens in the content; records that match by
    content alone count only while fewer than `limit` records match by a tag.

    Scores are computed within each record; the number of tag matches is one row, from the tag columns alone.
    """
    tokens = query_tokens(query)
    limit = min(limit, MAX_LIMIT)
    rows = live(memories).filter(F.lit(True) if where is None else where)
    t = tag_score(tokens)
    share = matched_tokens(F.col("content"), tokens) / F.lit(float(max(len(tokens), 1)))
    tagged = rows.agg(F.count_if(t > 0).alias("n_tagged"))
    both = rows.select("id", share.alias("c"), t.alias("t")).crossJoin(F.broadcast(tagged))  # one row
    score = F.when(F.col("t") > 0, 0.5 * F.col("t") + 0.5 * F.col("c")).when((F.col("n_tagged") < limit) & (F.col("c") > 0), F.col("c"))
    return both.select("id", F.round(score, 6).alias("score")).filter("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def tag_score(tokens: list[str]) -> Column:
    """How many of the tokens, duplicates counted, a record has as index tags: the sum that postings of score 1 give."""
    wanted = valid_query(tokens)
    return sum((F.array_contains(index_tags(), t).cast("double") * wanted.count(t) for t in sorted(set(wanted))), F.lit(0.0))


def tag_lists(memories: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """qid, key, score and rank of the k records of the highest summed tag scores for each query's words (qid, token, times), ties by key.

    Records with the same tags, of those that any query asks for, have the same scores: of each such group only the first k keys can be in
    a list. Queries with the same words have the same list. So words meet groups, not records, and no row is made for a query and a record
    outside its best groups. A group at place r of a query can give its key at place p only if r + p - 1 is at most k.
    """
    first = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    bags = words.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("token", "times"))).alias("bag"))
    bags = bags.join(bags.groupBy("bag").agg(F.min("qid").alias("list")), "bag")
    asked = bags.filter(F.col("list") == F.col("qid")).select("list", F.explode("bag").alias("b")).select("list", "b.token", "b.times")
    wanted = tag_postings(memories).join(settled(words.select("token").distinct())[0], "token", "left_semi")
    tagged = wanted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("token", "score"))).alias("tags"))
    # A group is named by its first key.
    members = tagged.withColumn("p", first("tags", "key")).filter(F.col("p") <= k)
    members = materialized(members.withColumn("group", F.min("key").over(Window.partitionBy("tags"))))
    groups = members.filter("p = 1").select("group", F.explode("tags").alias("t")).select("group", "t.token", "t.score")
    best = asked.join(groups, "token").groupBy("list", "group").agg(F.sum(F.col("times") * F.col("score")).alias("score"))
    best = best.withColumn("r", first("list", F.desc("score"), "group")).filter(F.col("r") <= k)
    keys = best.join(members.select("group", "key", "p"), "group").filter(F.col("r") + F.col("p") <= k + 1)
    lists = keys.withColumn("rank", first("list", F.desc("score"), "key")).filter(F.col("rank") <= k)
    return bags.select("qid", "list").join(lists, "list").select("qid", "key", "score", "rank")


def hybrid_batch(memories: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """qid, id, score and source: the hybrid search of many queries (qid, embedding, text) in one job.

    Each query has a vector and a tag list as in `hybrid`, found by one batch of nearest neighbours and by `tag_lists`; lists are ranked
    and fused per query.
    """
    limit = min(limit, MAX_LIMIT)
    k = pool_size(limit)
    near = knn_batch(vectors, queries.select(F.col("qid").alias("id"), "embedding"), k, skip_self=False)
    near = near.select(F.col("src").alias("qid"), F.col("dst").alias("key"), "score", F.lit("vector").alias("source"), "rank")
    words = queries.select("qid", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("token"))
    words = words.groupBy("qid", "token").agg(F.count("*").cast("double").alias("times"))
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    both = near.unionByName(tag_lists(memories, words, 2 * k).withColumn("source", F.lit("tag")))
    fused = both.groupBy("qid", "key").agg(F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))), 9).alias("score"), F.min("source").alias("one"), F.count("*").alias("n"))
    pool = fused.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    kept = pool.join(live(memories).select(F.col("id").alias("key")), "key", "left_semi")
    best = kept.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)
    return best.select("qid", F.col("key").alias("id"), "score", F.when(F.col("n") > 1, F.lit("hybrid")).otherwise(F.col("one")).alias("source"))


def fetch_values(keys: DataFrame, memories: DataFrame) -> DataFrame:
    """Records of given keys (key, ...), each with score 1; unknown keys are left out."""
    return memories.join(keys.select(F.col("key").alias("id")).distinct(), "id", "left_semi").withColumn("score", F.lit(1.0))


def list_memories(memories: DataFrame, where: Column | None = None, offset: int = 0, limit: int = 10, order: str = "asc") -> tuple[DataFrame, DataFrame]:
    """A page by creation time, and the filtered total as one row."""
    rows = live(memories).filter(F.lit(True) if where is None else where)
    time = F.col("created_at").desc() if order == "desc" else F.col("created_at").asc()
    return rows.orderBy(time, "id").offset(offset).limit(min(limit, MAX_LIMIT)), rows.agg(F.count("*").alias("total"))


def summaries(memories: DataFrame) -> DataFrame:
    """The first 100 characters of the content and five more columns."""
    preview = F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content"))
    return memories.select("id", preview.alias("preview"), "memory_type", "tags", "importance", "created_at")


def important(memories: DataFrame, limit: int = 20) -> DataFrame:
    return summaries(live(memories).orderBy(F.desc("importance"), "id").limit(limit))


def recent(memories: DataFrame, limit: int = 20, by: str = "created_at") -> DataFrame:
    """The newest records, or with `by` accessed_at those used last."""
    return summaries(live(memories).orderBy(F.desc(by), "id").limit(limit))
