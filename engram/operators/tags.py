"""Tag and text index operators over postings (key, token, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..runtime import spread


def with_index_tags(memories: DataFrame) -> DataFrame:
    return memories.withColumn("index_tags", T.index_tags())


def tag_postings(memories: DataFrame, key: str = "id") -> DataFrame:
    """One row of score 1 for each distinct tag of each record, internal tags included."""
    tagged = with_index_tags(memories).select(F.col(key).alias("key"), F.explode(F.array_distinct("index_tags")).alias("token"))
    return tagged.withColumn("score", F.lit(1.0))


def text_postings(texts: DataFrame, key: str = "key", text: str = "text", min_bytes: int = T.MIN_TOKEN_BYTES) -> DataFrame:
    """Term frequencies of the words of each text (one row a key): counted within the row, so nothing is shuffled."""
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")))
    rows = rows.select("key", F.sort_array(T.tokenize(F.col("text"), min_bytes)).alias("sorted"))
    begins = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: (i == 0) | (F.get("sorted", i - 1) != F.get("sorted", i)))
    # Null, which explodes to no row, for a text without words: a filter would be pushed below and sort everything again.
    rows = rows.select("key", "sorted", F.when(F.size("sorted") > 0, begins).alias("begins"))
    # A token's count is the distance from where it begins to where the next one does.
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("sorted")))
    counted = F.zip_with("begins", ends, lambda a, b: F.struct(F.get("sorted", a).alias("token"), (b - a).alias("n")))
    return rows.select("key", F.explode(counted).alias("e")).select("key", "e.token", F.col("e.n").cast("double").alias("score"))


def valid_query(tokens: list[str]) -> list[str]:
    """Lower-cased query tokens of valid length, duplicates kept."""
    low = [t.lower() for t in tokens]
    return [t for t in low if T.MIN_TOKEN_BYTES <= len(t.encode()) <= T.MAX_TOKEN_BYTES]


def add_tags(memories: DataFrame, tags: list[str]) -> DataFrame:
    """Set semantics: a tag that is there already stays once; tags of invalid length are skipped."""
    tags = [t for t in tags if T.MIN_TOKEN_BYTES <= len(t.encode()) <= T.MAX_TOKEN_BYTES]
    return memories.withColumn("tags", F.array_union("tags", F.array(*map(F.lit, tags)).cast("array<string>")))


def set_tags(memories: DataFrame, tags: list[str]) -> DataFrame:
    return memories.withColumn("tags", F.array_distinct(F.array(*map(F.lit, tags)).cast("array<string>")))


def search(postings: DataFrame, token: str) -> DataFrame:
    return postings.filter(F.col("token") == token.lower()).select("key")


def search_scored(postings: DataFrame, token: str) -> DataFrame:
    return postings.filter(F.col("token") == token.lower()).select("key", "score").orderBy(F.desc("score"), "key")


def search_and(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """Keys that have all tokens; no valid token, no key."""
    wanted = sorted(set(valid_query(tokens)))
    hits = postings.filter(F.col("token").isin(wanted)).groupBy("key").agg(F.countDistinct("token").alias("n"))
    return hits.filter((F.col("n") == len(wanted)) & F.lit(bool(wanted))).select("key")


def search_or(postings: DataFrame, tokens: list[str]) -> DataFrame:
    return postings.filter(F.col("token").isin(sorted(set(valid_query(tokens))))).select("key").distinct()


def search_or_scored(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """Sum of scores over the query's tokens; one that the query repeats counts as often."""
    wanted = valid_query(tokens)
    times = F.lit(0)
    for t in sorted(set(wanted)):
        times = F.when(F.col("token") == t, F.lit(wanted.count(t))).otherwise(times)
    hits = postings.filter(F.col("token").isin(sorted(set(wanted))))
    return hits.groupBy("key").agg(F.sum(F.col("score") * times).alias("score"))


def search_segments(segments: list[DataFrame], tokens: list[str]) -> DataFrame:
    """search_or_scored over postings in several segments: the scores that a key has in each are summed."""
    return search_or_scored(reduce(DataFrame.unionByName, segments), tokens)


def merge_segments(segments: list[DataFrame]) -> DataFrame:
    """Segments as one, newest last: a key's postings are those of the newest segment that has it."""
    numbered = reduce(DataFrame.unionByName, (s.select("key", "token", "score", F.lit(i).alias("segment")) for i, s in enumerate(segments)))
    newest = numbered.groupBy("key").agg(F.max("segment").alias("segment"))
    return numbered.join(newest, ["key", "segment"], "left_semi").select("key", "token", "score")


#: The most keys that a tag step may return: they are broadcast.
MAX_LIMIT = 10_000


def tag_step(postings: DataFrame, tokens: list[str], match_all: bool = False, limit: int = 10) -> DataFrame:
    """key, score and the matching tags: AND scores 1, OR its sum over the largest one; the best `limit` keys."""
    limit = min(limit, MAX_LIMIT)
    wanted = sorted(set(valid_query(tokens)))
    if match_all:
        scored = search_and(postings, tokens).withColumn("score", F.lit(1.0))
    else:
        scored = search_or_scored(postings, tokens)
    # The largest score is one row; a whole-table window would put all hits in one task.
    top = scored.agg(F.max("score").alias("top"))
    best = scored.orderBy(F.desc("score"), "key").limit(limit).crossJoin(F.broadcast(top))
    best = best.select("key", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))
    tags = postings.filter(F.col("token").isin(wanted)).join(F.broadcast(best), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("token")).alias("tags"))
    return best.join(tags, "key")


def tokens_of(postings: DataFrame, key) -> DataFrame:
    return postings.filter(F.col("key") == key).select("token")


def has_token(postings: DataFrame, key, token: str) -> bool:
    return not postings.filter((F.col("key") == key) & (F.col("token") == token.lower())).isEmpty()


def contains_key(postings: DataFrame, key) -> bool:
    return not postings.filter(F.col("key") == key).isEmpty()


def remove_document(postings: DataFrame, keys: DataFrame) -> DataFrame:
    return postings.join(keys.select("key").distinct(), "key", "left_anti")


def vocabulary(postings: DataFrame) -> DataFrame:
    """Number of documents per token."""
    return postings.groupBy("token").agg(F.countDistinct("key").alias("docs"))


def unique_tokens(postings: DataFrame) -> DataFrame:
    return postings.select("token").distinct()
