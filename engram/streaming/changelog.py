"""The changelog as a stream: a keyed table kept by micro-batches, and edges discovered for new records."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.connections import THRESHOLD, without_linked
from ..operators.vector import knn_batch
from ..sources.levels import LevelStore


def read_changelog(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fold_batch(root: str, keys: list[str] | None = None, buckets: int = 16, trigger: int = 4) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append a micro-batch to the table under root, see LevelStore.

    A batch writes its own changes only, and shuffles only them; once `trigger` batches wait, the buckets that they touch are
    rewritten. A batch that comes again after a failure is left out, and deletions stay as rows, so a late older row
    can't bring a deleted record back.
    """

    def run(batch: DataFrame, number: int) -> None:
        table = LevelStore(batch.sparkSession, root, keys, buckets, trigger)
        table.append(batch, number)
        if table.due():
            table.compact()
            table.sweep()

    return run


def current_state(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """The live rows of the table under root."""
    return LevelStore(spark, root, keys).read()


def start_fold(changes: DataFrame, root: str, checkpoint: str, keys: list[str] | None = None, every_s: float | None = None) -> StreamingQuery:
    """Run over what is there now, then stop; with `every_s`, go on and take a batch every so many seconds."""
    when = {"availableNow": True} if every_s is None else {"processingTime": f"{every_s} seconds"}
    return changes.writeStream.foreachBatch(fold_batch(root, keys)).option("checkpointLocation", checkpoint).trigger(**when).start()


def discover_batch(vectors: Callable[[], DataFrame], edges: Callable[[], DataFrame], sink: str, threshold: float = THRESHOLD, k: int = 5) -> Callable[[DataFrame, int], None]:
    """foreachBatch over new vectors (id, embedding): append their similar_to edges to a table."""

    def run(batch: DataFrame, _: int) -> None:
        found = knn_batch(vectors(), batch, k).filter(F.col("score") >= threshold)
        links = without_linked(found, edges()).select("src", "dst", F.lit("similar_to").alias("edge_type"), F.col("score").alias("weight"))
        links.write.mode("append").parquet(sink)

    return run


class DiscoveryQueue:
    """Ids of new records that wait for their connections to be discovered: a writer never waits, and what finds the queue full is
    counted and dropped, to be found by the next full discovery. Workers take batches; a batch that fails is tried again after 1, 2, 4 and so on
    seconds, `longest_s` at most, and given up and counted after `retries`."""

    def __init__(self, discover: Callable[[list], int], most: int = 10_000, batch: int = 256, retries: int = 5, longest_s: float = 8.0, sleep: Callable[[float], None] = time.sleep):
        self.discover, self.most, self.batch, self.retries, self.longest_s, self.sleep = discover, most, batch, retries, longest_s, sleep
        self.waiting: deque = deque()
        self.dropped = self.done = self.failed = self.restarts = self.found = 0
        self._lock, self._stop, self._workers = threading.Lock(), threading.Event(), []

    def offer(self, id_) -> bool:
        with self._lock:
            if len(self.waiting) >= self.most:
                self.dropped += 1
                return False
            self.waiting.append(id_)
            return True

    def step(self) -> int:
        """Take one batch through; returns how many ids it had."""
        with self._lock:
            ids = [self.waiting.popleft() for _ in range(min(self.batch, len(self.waiting)))]
        for attempt in range(self.retries + 1) if ids else ():
            try:
                found = self.discover(ids)
            except Exception:
                if attempt == self.retries:
                    with self._lock:
                        self.failed += len(ids)
                else:
                    with self._lock:
                        self.restarts += 1
                    self.sleep(min(self.longest_s, 2.0**attempt))
            else:
                with self._lock:
                    self.done, self.found = self.done + len(ids), self.found + found
                break
        return len(ids)

    def drain(self) -> None:
        while self.step():
            pass

    def start(self, workers: int = 1, idle_s: float = 0.2) -> None:
        def work():
            while not self._stop.is_set():
                if not self.step():
                    self._stop.wait(idle_s)

        self._stop.clear()
        self._workers = [threading.Thread(target=work, daemon=True) for _ in range(workers)]
        for w in self._workers:
            w.start()

    def stop(self) -> None:
        """Let the workers finish what they hold, then end them; what waits stays in the queue."""
        self._stop.set()
        for w in self._workers:
            w.join()

    def counters(self) -> dict[str, int]:
        with self._lock:
            return {"waiting": len(self.waiting), "dropped": self.dropped, "done": self.done, "failed": self.failed, "restarts": self.restarts, "found": self.found}


def supervise(start: Callable[[], StreamingQuery], retries: int = 5, longest_s: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end and start it again when it fails, after 1, 2, 4 and so on seconds; the checkpoint makes that safe.

    Returns the number of restarts; the last error is raised once `retries` are used up.
    """
    for attempt in range(retries + 1):
        try:
            start().awaitTermination()
            return attempt
        except Exception:
            if attempt == retries:
                raise
            sleep(min(longest_s, 2.0**attempt))
    return retries

