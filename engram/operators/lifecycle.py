"""Time-driven rules as functions (memories, now_ms) -> memories; every rule is one pass of conditional columns.

The clock is a parameter. A `changed` flag tells which rows a rule touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY_MS, clamp
from .graph import remove_nodes

PROMOTE_ACCESSES = 3
DECAY_PER_DAY = 0.995
HEALTH_LOSS = {"short_term": 8.0, "long_term": 2.0}
RECALL_HEALTH = 10.0
RETENTION_DAYS = 30


def is_expired(now_ms: int) -> Column:
    expired = (F.col("memory_type") == "short_term") & F.col("ttl").isNotNull() & (F.lit(now_ms) >= F.col("created_at") + F.col("ttl") * 1000)
    return F.coalesce(expired, F.lit(False))


def protected(now_ms: int) -> Column:
    """Flashbulb records are safe until, but not at, their time."""
    return F.coalesce(F.col("flashbulb_until") > now_ms, F.lit(False))


def days_since(ms: Column, now_ms: int) -> Column:
    """Whole days, never negative."""
    return F.floor(F.greatest(F.lit(0), F.lit(now_ms) - ms) / DAY_MS).cast("long")


def _apply(memories: DataFrame, rule: Column, **new: Column) -> DataFrame:
    """Rows where `rule` holds get the new values; all columns are computed from the old ones."""
    flagged = memories.withColumn("changed", F.coalesce(rule, F.lit(False)))
    return flagged.select(*(F.when(F.col("changed"), new[c]).otherwise(F.col(c)).cast(memories.schema[c].dataType).alias(c) if c in new else F.col(c) for c in memories.columns), "changed")


def promote(memories: DataFrame, now_ms: int, ids: Column | None = None) -> DataFrame:
    """Live short-term records (all, or where `ids` holds) become long-term."""
    rule = ~F.col("archived") & (F.col("memory_type") == "short_term") & (F.lit(True) if ids is None else ids)
    return _apply(memories, rule, memory_type=F.lit("long_term"), ttl=F.lit(None), updated_at=F.lit(now_ms))


def expire_short_term(memories: DataFrame, now_ms: int, promote_accesses: int = PROMOTE_ACCESSES) -> DataFrame:
    """Live records past their time to live: often used ones are promoted, the others archived."""
    rule = ~F.col("archived") & is_expired(now_ms)
    often = F.col("access_count") >= promote_accesses
    return _apply(
        memories, rule,
        memory_type=F.when(often, F.lit("long_term")).otherwise(F.col("memory_type")),
        ttl=F.when(~often, F.col("ttl")),
        archived=~often,
        updated_at=F.lit(now_ms),
    )


def importance_decay(memories: DataFrame, now_ms: int, per_day: float = DECAY_PER_DAY) -> DataFrame:
    days = days_since(F.coalesce("last_decay_at", "created_at"), now_ms)
    rule = ~F.col("archived") & (F.col("memory_type") == "long_term") & ~protected(now_ms) & (days > 0)
    return _apply(memories, rule, importance=F.col("importance") * F.pow(F.lit(per_day), days), last_decay_at=F.lit(now_ms))


def active_forgetting(memories: DataFrame, now_ms: int, hard: bool = False, loss: dict[str, float] | None = None) -> DataFrame:
    """Health falls with the days since the last recall or check; at 0 a record is archived, or dropped if `hard`."""
    loss = HEALTH_LOSS | (loss or {})
    since = F.greatest(F.coalesce("last_recalled_at", "accessed_at"), F.coalesce("last_health_check_at", "created_at"))
    days = days_since(since, now_ms)
    health = clamp(F.col("health") - days * F.when(F.col("memory_type") == "short_term", loss["short_term"]).otherwise(loss["long_term"]), 0.0, 100.0)
    rule = ~F.col("archived") & ~protected(now_ms) & (days > 0)
    out = _apply(memories, rule, health=health, last_health_check_at=F.lit(now_ms), archived=health <= 0, updated_at=F.when(health <= 0, F.lit(now_ms)).otherwise(F.col("updated_at")))
    return out.filter(~(F.col("changed") & F.col("archived"))) if hard else out


def cleanup_archived(memories: DataFrame, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop records that were archived at least `days` ago."""
    return memories.filter(~(F.col("archived") & (F.col("updated_at") <= now_ms - days * DAY_MS)))


def consolidate_similar(memories: DataFrame) -> tuple[DataFrame, int]:
    """Changes nothing, as in the data model's first version."""
    return memories, 0


def recall(memories: DataFrame, now_ms: int, ids: Column) -> DataFrame:
    """Reading a record touches it; searching and listing do not."""
    return _apply(
        memories, ~F.col("archived") & ids,
        accessed_at=F.lit(now_ms), access_count=F.col("access_count") + 1, last_recalled_at=F.lit(now_ms), health=F.least(F.col("health") + RECALL_HEALTH, F.lit(100.0)),
    )


LIMITS = {"importance": (0.0, 1.0), "emotional_valence": (-1.0, 1.0), "arousal": (0.0, 1.0), "health": (0.0, 100.0)}


def one_patch(patches: DataFrame) -> DataFrame:
    """One row per id: of each column the last value that isn't null, by `seq` if the patches have it, else the largest."""
    order = [F.col("seq")] if "seq" in patches.columns else []
    names = [c for c in patches.columns if c not in ("id", "seq")]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))).getField("v").alias(c) for c in names]
    return patches.filter("id is not null").groupBy("id").agg(*last)


def update(memories: DataFrame, edges: DataFrame, patches: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Patches (id and any of content, tags, importance, emotional_valence, arousal, source) where not null; new content drops a
    record's edges both ways. Several patches of an id act as one, see one_patch; unknown and archived ids are left alone."""
    patches = one_patch(patches)
    names = [c for c in patches.columns if c != "id"]
    renamed = patches.select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit"))
    joined = memories.join(renamed, "id", "left")
    new = {c: F.coalesce(clamp(f"_{c}", *LIMITS[c]) if c in LIMITS else F.col(f"_{c}"), F.col(c)) for c in names}
    hit = F.col("_hit") & ~F.col("archived")
    out = joined.select(*(F.when(hit, F.lit(now_ms) if c == "updated_at" else new[c]).otherwise(F.col(c)).cast(memories.schema[c].dataType).alias(c) if c in new or c == "updated_at" else F.col(c) for c in memories.columns))
    if "content" not in names:
        return out, edges
    return out, remove_nodes(edges, rewritten(memories, patches).select(F.col("id").alias("node")))


def rewritten(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """id and new content of the live records whose content the patches change."""
    new = one_patch(patches).select("id", F.col("content").alias("new"))
    changed = memories.filter(~F.col("archived")).select("id", "content").join(new, "id").filter(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("content")))
    return changed.select("id", F.col("new").alias("content"))


def delete(memories: DataFrame, edges: DataFrame, ids: DataFrame, now_ms: int, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Soft: archive, and restart the clean-up clock. Hard: drop records and their edges. Unknown ids do nothing."""
    gone = ids.select("id").distinct()
    if hard:
        return memories.join(gone, "id", "left_anti"), remove_nodes(edges, gone.withColumnRenamed("id", "node"))
    flagged = memories.join(gone.withColumn("_hit", F.lit(True)), "id", "left")
    out = _apply(flagged, F.col("_hit"), archived=F.lit(True), updated_at=F.lit(now_ms))
    return out.drop("_hit", "changed"), edges
