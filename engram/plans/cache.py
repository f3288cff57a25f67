"""Tables kept in executor storage, up to a number of bytes; the one that was not used for longest goes first."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a result's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class TableCache:
    def __init__(self, most_bytes: int = 64 << 20):
        self.most_bytes, self.bytes = most_bytes, 0
        self.hits = self.misses = self.evictions = 0
        self._held: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    def get(self, name: str, df: DataFrame) -> DataFrame:
        """df, persisted under a name when its estimate fits; the same name gives what was persisted first."""
        if name in self._held:
            self.hits += 1
            self._held.move_to_end(name)
            return self._held[name][0]
        self.misses += 1
        size = estimated_bytes(df)
        if size > self.most_bytes:
            return df
        while self.bytes + size > self.most_bytes:
            self.drop(next(iter(self._held)))
            self.evictions += 1
        self._held[name] = df.persist(StorageLevel.MEMORY_AND_DISK), size
        self.bytes += size
        return df

    def drop(self, name: str) -> None:
        if name in self._held:
            df, size = self._held.pop(name)
            self.bytes -= size
            df.unpersist()

    def stats(self) -> dict[str, int]:
        return {"tables": len(self._held), "bytes": self.bytes, "hits": self.hits, "misses": self.misses, "evictions": self.evictions}
