"""The data model: record columns, defaults, clamps and validation."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MemoryType(str, Enum):
    SHORT = "short_term"
    LONG = "long_term"


class SearchType(str, Enum):
    SEMANTIC = "semantic"
    KEYWORD = "keyword"
    HYBRID = "hybrid"


class Metric(str, Enum):
    L2 = "l2"
    COSINE = "cosine"
    DOT = "dot"


# The relationship types of the data model.
RELATIONSHIPS = ("related_to", "caused_by", "part_of", "references", "contradicts", "supports", "similar_to", "derived_from")

MAX_CONTENT_BYTES = 100_000
MAX_TAGS = 50
MAX_ENTITIES = 100
MAX_RELATIONSHIPS = 200
DEFAULT_TTL_S = 3600
DEFAULT_IMPORTANCE = 0.5
FLASHBULB_AROUSAL = 0.8
FLASHBULB_IMPORTANCE = 0.9
DAY_MS = 86_400_000
FLASHBULB_MS = 30 * DAY_MS

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("accessed_at", T.LongType()),
        T.StructField("access_count", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("importance", T.FloatType()),
        T.StructField("emotional_valence", T.FloatType()),
        T.StructField("arousal", T.FloatType()),
        T.StructField("health", T.FloatType()),
        T.StructField("last_recalled_at", T.LongType()),
        T.StructField("flashbulb_until", T.LongType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("last_decay_at", T.LongType()),
        T.StructField("last_health_check_at", T.LongType()),
        T.StructField("archived", T.BooleanType()),
    ]
)
EDGE = "src string, dst string, edge_type string, weight double, ts bigint"

#: What a create request may hold; a vector of its own, extracted entities and relationships are optional.
CREATE = (
    "id string, content string, memory_type string, source string, tags array<string>, importance double, emotional_valence double,"
    " arousal double, health double, ttl bigint, embedding array<float>, graph_extraction struct<entities:array<struct<name:string,entity_type:string,description:string>>,"
    "relationships:array<struct<source:string,target:string,relationship_type:string,strength:double>>>"
)


def clamp(value: Column | str, low: float, high: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def create_errors(dimension: int | None = None, max_bytes: int | None = MAX_CONTENT_BYTES) -> Column:
    """Names of the limits that a create request breaks; empty for a valid one. A dimension is checked if it is given, the length of a
    content unless `max_bytes` is None: for records taken over from tables that state no such limit."""
    checks = [] if dimension is None else [("embedding_dimension", F.size("embedding") != dimension)]
    checks += [("content_blank", F.coalesce(F.trim("content"), F.lit("")) == "")]
    checks += [] if max_bytes is None else [("content_too_long", F.octet_length("content") > max_bytes)]
    checks += [
        ("too_many_tags", F.size("tags") > MAX_TAGS),
        ("too_many_entities", F.size("graph_extraction.entities") > MAX_ENTITIES),
        ("too_many_relationships", F.size("graph_extraction.relationships") > MAX_RELATIONSHIPS),
        ("memory_type_unknown", ~F.col("memory_type").isin([t.value for t in MemoryType])),
    ]
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in checks)))


def validated(requests: DataFrame, dimension: int | None = None, max_bytes: int | None = MAX_CONTENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the others with an `errors` column."""
    checked = requests.withColumn("errors", create_errors(dimension, max_bytes))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def created(requests: DataFrame, now_ms: int) -> DataFrame:
    """Records of valid create requests, with defaults, clamps and the flashbulb rule."""
    arousal = F.coalesce(clamp("arousal", 0.0, 1.0), F.lit(0.0))
    flash = arousal >= FLASHBULB_AROUSAL
    importance = F.coalesce(clamp("importance", 0.0, 1.0), F.lit(DEFAULT_IMPORTANCE))
    kind = F.when(flash, MemoryType.LONG.value).otherwise(F.coalesce("memory_type", F.lit(MemoryType.SHORT.value)))
    now, none = F.lit(now_ms).cast("long"), F.lit(None).cast("long")
    return requests.select(
        F.coalesce("id", F.expr("uuid()")).alias("id"),
        "content",
        kind.alias("memory_type"),
        now.alias("created_at"),
        now.alias("updated_at"),
        now.alias("accessed_at"),
        F.lit(0).alias("access_count"),
        "source",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(flash, F.greatest(importance, F.lit(FLASHBULB_IMPORTANCE))).otherwise(importance).cast("float").alias("importance"),
        F.coalesce(clamp("emotional_valence", -1.0, 1.0), F.lit(0.0)).cast("float").alias("emotional_valence"),
        arousal.cast("float").alias("arousal"),
        F.coalesce(clamp("health", 0.0, 100.0), F.lit(100.0)).cast("float").alias("health"),
        none.alias("last_recalled_at"),
        F.when(flash, now + FLASHBULB_MS).alias("flashbulb_until"),
        F.when(kind == MemoryType.SHORT.value, F.coalesce("ttl", F.lit(DEFAULT_TTL_S).cast("long"))).alias("ttl"),
        none.alias("last_decay_at"),
        none.alias("last_health_check_at"),
        F.lit(False).alias("archived"),
    )


def api_rows(memories: DataFrame) -> DataFrame:
    """What callers see: times as timestamps, internal columns left out."""
    times = {"created_at", "updated_at", "accessed_at", "last_recalled_at", "flashbulb_until"}
    hidden = {"last_decay_at", "last_health_check_at", "archived"}
    return memories.select(*(F.timestamp_millis(F.col(c)).alias(c) if c in times else F.col(c) for c in memories.columns if c not in hidden))
