"""Vector search: exact top-k, batched kNN and a similarity join in blocks, all as matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..schema import Metric

#: Scores are rounded so that ties are ties; order is by score, then key.
DIGITS = 6
#: The most rows that a list may have: what is made from it is broadcast.
MAX_K = 10_000
#: Points, and vectors, whose distances are in memory at once; vectors of the first tile of points without neighbours; pairs that are scored at once.
STRIP, TILE, FIRST, PAIRS = 256, 8192, 1024, 16_384
#: Blocks that each of two sides of a comparison is dealt into at most, as long as none is larger than so many bytes of vectors.
BLOCKS, BLOCK_BYTES = 7, 32 << 20
#: Pairs from which cells get a task each.
MANY_PAIRS = 1_000_000_000


def check_dimension(vectors: DataFrame, query: Sequence[float]) -> None:
    """An error if a stored vector has another dimension than the query; one job. Searches check while they run."""
    found = vectors.filter(F.size("embedding") != len(query)).select(F.size("embedding").alias("n")).first()
    if found is not None:
        raise ValueError(f"query has {len(query)} dimensions, a vector has {found['n']}")


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """The vectors of an Arrow list column as rows; an error if their dimensions, or those of the query, differ."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(lengths[0]) if len(lengths) else 0
    if (wrong := lengths != dim).any():
        raise ValueError(f"expected {dim} dimensions, a vector has {lengths[wrong][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def distances(metric: Metric, points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Smaller is nearer, as in functions.vectors.distance."""
    if metric == Metric.L2:
        return ((points - query) ** 2).sum(1)
    dots = points @ query
    if metric == Metric.DOT:
        return -dots
    size = np.sqrt((points * points).sum(1)) * np.sqrt(query @ query)
    return 1 - np.where(size < V.EPSILON, 0.0, dots / np.where(size < V.EPSILON, 1.0, size))


def similarities(metric: Metric, distance: np.ndarray) -> np.ndarray:
    score = {Metric.L2: lambda d: 1 / (1 + d), Metric.COSINE: lambda d: 1 - d, Metric.DOT: lambda d: -d}[metric](distance)
    return np.round(score, DIGITS) + 0.0


def scored(vectors: DataFrame, query: Sequence[float], metric: Metric = Metric.L2, key: str = "id", k: int | None = None) -> DataFrame:
    """key, distance and score of every vector (key, embedding) against one query, or of each task's k best. Null vectors are left
    out; a vector of another dimension is an error."""
    asked = np.asarray([float(x) for x in query])

    def run(batches):
        best = None
        for batch in batches:
            d = distances(metric, matrix(batch.column(1), len(asked)), asked)
            found = pa.table([batch.column(0), pa.array(d), pa.array(similarities(metric, d))], [key, "distance", "score"])
            if k is None:
                yield from found.to_batches()
                continue
            found = found if best is None else pa.concat_tables([best, found])
            best = found.take(pc.select_k_unstable(found, k, [("score", "descending"), (key, "ascending")])) if len(found) > k else found
        if best is not None:
            yield from best.combine_chunks().to_batches()

    schema = T.StructType([vectors.schema[key], T.StructField("distance", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return vectors.select(key, "embedding").filter("embedding is not null").mapInArrow(run, schema)


def top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.L2, key: str = "id") -> DataFrame:
    """The k nearest vectors: one scan that keeps k rows a task, and a top-k of those; no shuffle."""
    k = min(k, MAX_K)
    return scored(vectors, query, metric, key, k).orderBy(F.desc("score"), key).limit(k)


def top_k_with_values(vectors: DataFrame, records: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.L2) -> DataFrame:
    """The k nearest vectors with score and the columns of their records (id, ...); vectors without a record are left out."""
    found = top_k(vectors, query, k, metric).select("id", "score")  # MAX_K rows at most
    return records.join(F.broadcast(found), "id").orderBy(F.desc("score"), "id")


def get_vector(vectors: DataFrame, id_) -> DataFrame:
    return vectors.filter(F.col("id") == id_)


def upsert(vectors: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """New vectors (id, embedding) in the place of those of the same ids, which must be unique; another dimension is an error."""
    embedding = F.col("embedding") if dim is None else V.checked(F.col("embedding"), dim)
    new = new.select("id", embedding.cast(vectors.schema["embedding"].dataType).alias("embedding"))
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors but those of some ids; unknown ids do nothing."""
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def _points(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """As `matrix`, in the type of the column and without a copy if it can be: `Nearest` makes doubles of a tile at a time."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(lengths[0]) if len(lengths) else 0
    if (wrong := lengths != dim).any():
        raise ValueError(f"expected {dim} dimensions, a vector has {lengths[wrong][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


FOUND = "src long, dst long, score double"


class Nearest:
    """The k best of the vectors seen so far for each of some points, of a score of `least` or more; ties by key.

    Vectors come in tiles, of which a matrix product gives squared distances to a strip of points. Only pairs that may still be among the
    k best are scored, from the differences of their vectors. Memory is a tile and k rows a point, however many vectors come.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, least: float = 0.0, skip_self: bool = True):
        self.ids, self.points, self.k, self.least, self.skip_self = ids, points, k, least, skip_self
        self.score, self.key = np.full((len(ids), k), -1.0), np.zeros((len(ids), k), np.int64)

    def add(self, keys: np.ndarray, others: np.ndarray) -> None:
        if not self.k:
            return
        if (keys[1:] < keys[:-1]).any():  # then a tile's ties with earlier vectors are out by their keys
            order = np.argsort(keys, kind="stable")
            keys, others = keys[order], others[order]
        for a in range(0, len(self.ids), STRIP):
            strip = slice(a, a + STRIP)
            points = self.points[strip].astype(np.float64)
            sizes = (points * points).sum(1)
            left = np.concatenate([-2 * points, np.ones((len(points), 1))], 1)
            # While points lack k neighbours, a short tile finds some; then few pairs of the others are near enough.
            b, n = 0, max(FIRST, 4 * self.k) if (self.score[strip, -1] < 0).any() else TILE
            while b < len(keys):
                self._tile(strip, points, sizes, left, keys[b : b + n], others[b : b + n].astype(np.float64))
                b, n = b + n, TILE

    def _tile(self, strip: slice, points: np.ndarray, sizes: np.ndarray, left: np.ndarray, keys: np.ndarray, others: np.ndarray) -> None:
        own = (others * others).sum(1)
        d = left @ np.concatenate([others, own[:, None]], 1).T  # without the point's own size
        error = 1e-15 * (points.shape[1] + 8) * (sizes + own.max(initial=0.0))  # of a distance out of products
        score, key = self.score[strip], self.key[strip]
        lowest = np.maximum(score[:, -1], self.least)  # a worse score can't enter; as good a one can, with a smaller key
        tied_out = (score[:, -1] > self.least) & (key[:, -1] <= keys.min())

        def near_enough() -> np.ndarray:
            least = lowest + np.where(tied_out, 0.4, -1.0) * 10.0**-DIGITS  # scores are rounded
            most = np.where(least > 0, 1 / np.where(least > 0, least, 1.0) - 1, np.inf)
            return np.flatnonzero(d <= (most - sizes + error)[:, None])

        at, lacking = near_enough(), score[:, -1] < 0
        if len(at) > PAIRS and lacking.any() and len(keys) > self.k:
            near = d[lacking]
            if self.skip_self:
                near[self.ids[strip][lacking, None] == keys[None, :]] = np.inf
            near = np.partition(near, self.k - 1, 1)[:, self.k - 1] + sizes[lacking] + 2 * error[lacking]
            lowest[lacking] = np.maximum(lowest[lacking], 1 / (1 + np.maximum(near, 0)) - 10.0**-DIGITS)
            at = near_enough()
        for c in range(0, len(at), PAIRS):
            self._merge(strip, points, score, key, *np.divmod(at[c : c + PAIRS], len(keys)), keys, others)

    def _merge(self, strip: slice, points: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray, col: np.ndarray, keys: np.ndarray, others: np.ndarray) -> None:
        """Score pairs of a point and a vector and take those among the k best into score and key."""
        found = np.round(1 / (1 + ((points[row] - others[col]) ** 2).sum(1)), DIGITS)
        new = keys[col]
        good = (found >= self.least) & ((found > score[row, -1]) | ((found == score[row, -1]) & (new < key[row, -1])))
        if self.skip_self:
            good &= self.ids[strip][row] != new
        row, found, new = row[good], found[good], new[good]
        if not len(row):
            return
        rows = np.unique(row)
        old = score[rows] >= 0
        row = np.concatenate([np.broadcast_to(rows[:, None], old.shape)[old], row])
        found, new = np.concatenate([score[rows][old], found]), np.concatenate([key[rows][old], new])
        order = np.lexsort((new, -found, row))
        row, found, new = row[order], found[order], new[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        score[rows] = -1.0
        score[row[kept], place[kept]], key[row[kept], place[kept]] = found[kept], new[kept]

    def batch(self) -> pa.RecordBatch:
        has = self.score >= 0
        src = np.broadcast_to(np.asarray(self.ids, np.int64)[:, None], has.shape)[has]
        return pa.record_batch([pa.array(src), pa.array(self.key[has]), pa.array(self.score[has])], ["src", "dst", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each src with their rank."""
    best = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def compare_cells(rows: DataFrame, on: list[str], k: int, least: float = 0.0, skip_self: bool = True) -> DataFrame:
    """src, dst and score from rows (on..., query, id, embedding): in each cell the k best others for every query."""

    def compare(key, table):
        asks, has = table.filter(table["query"]), table.filter(pc.invert(table["query"]))
        del table
        points, others = (_points(t["embedding"].combine_chunks()) for t in (asks, has))
        if len(asks) and len(has) and points.shape[1] != others.shape[1]:
            raise ValueError(f"queries have {points.shape[1]} dimensions, vectors {others.shape[1]}")
        best = Nearest(asks["id"].to_numpy(), points, k, least, skip_self)
        if len(asks):
            best.add(has["id"].to_numpy(), others)
        return pa.Table.from_batches([best.batch()])

    return rows.groupBy(*on).applyInArrow(compare, FOUND)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, skip_self: bool = True) -> DataFrame:
    """src, dst, score and rank of the k nearest vectors (id, embedding) of every query (id, embedding); exact.

    At most `block` queries, which are counted first, go to all partitions of the vectors: no vector is shuffled, and each task keeps k
    rows a query. Of more, blocks of queries meet blocks of vectors in cells, so nothing passes the driver.
    """
    vectors, queries = (df.select("id", "embedding").filter("embedding is not null") for df in (vectors, queries))
    held = queries.limit(block + 1).toArrow()
    if len(held) > block:
        return best_of(compare_cells(_dealt(vectors, queries, k, 4 * block), ["i", "j"], k, skip_self=skip_self), k)
    held = held.combine_chunks()
    ids = held["id"].to_numpy().astype(np.int64)
    points = matrix(held["embedding"].combine_chunks()) if len(held) else np.zeros((0, 0))

    def run(batches):
        best = Nearest(ids, points, k, 0.0, skip_self)
        for batch in batches:
            if batch.num_rows and len(ids):
                best.add(batch.column(0).to_numpy(), _points(batch.column(1), points.shape[1]))
        yield best.batch()

    return best_of(vectors.mapInArrow(run, FOUND), k)


def _size(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors, and the fewest blocks of at most BLOCK_BYTES."""
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return n, -(-n * dim * 4 // BLOCK_BYTES)


def _dealt(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """Cells (i, j, query, id, embedding): block i of the queries with block j of the vectors.

    Blocks have at least about `block` rows. There are BLOCKS ** 2 cells, of few queries with parts of many vectors so that the copies and
    the k rows a query of each cell are the fewest: what is shuffled is in proportion to the rows, until blocks reach BLOCK_BYTES.
    """
    (asked, least_n), (there, least_m) = _size(queries), _size(vectors)
    # A copy of a query brings k rows of about a tenth of a vector.
    share = (asked * (1 + k / 10) / max(there, 1)) ** 0.5 if asked else 1.0
    n, m = (max(1, min(-(-rows // block), max(round(BLOCKS * by), least))) for rows, by, least in ((asked, share, least_n), (there, 1 / max(share, 1e-9), least_m)))
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = queries.select(own(n).alias("i"), every(m).alias("j"), F.lit(True).alias("query"), "id", "embedding")
    has = vectors.select(every(n).alias("i"), own(m).alias("j"), F.lit(False).alias("query"), "id", "embedding")
    return _apart(asks.unionByName(has), n * m, asked * there)


def _apart(cells: DataFrame, n: int, pairs: int) -> DataFrame:
    """The n cells (i, j) of many pairs in tasks of their own, which are work enough though their rows are few."""
    return cells.repartition(4 * n, "i", "j") if pairs > MANY_PAIRS else cells


def similarity_join(vectors: DataFrame, threshold: float, k: int, block: int = 16_384) -> DataFrame:
    """src, dst, score and rank of the k best other vectors that reach `threshold`, for every vector.

    Vectors are dealt into blocks of about `block` or more, and each two blocks meet in one cell, which compares them by matrix products in tiles: exact, no
    row per pair, and a task holds two blocks. A vector is copied once per block, of which there are few: see `_dealt`. The work grows with the square of the number of vectors; `ann.ClusteredIndex.links` is the way that doesn't.
    """
    vectors = vectors.select("id", "embedding").filter("embedding is not null")
    n, least = _size(vectors)
    blocks = max(1, min(-(-n // block), max(2 * BLOCKS, least)))
    dealt = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = cells.select(F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "id", "embedding")

    def compare(key, table):
        i, j = (x.as_py() for x in key)
        sides = [table.filter(pc.equal(table["blk"], x)) for x in dict.fromkeys((i, j))]
        del table
        sides = [(t["id"].to_numpy(), _points(t["embedding"].combine_chunks())) for t in sides]
        if len({p.shape[1] for x, p in sides if len(x)}) > 1:
            raise ValueError(f"vectors of different dimensions: {[p.shape[1] for _, p in sides]}")
        found = []
        for (ids, points), (keys, others) in ((sides[0], sides[-1]), (sides[-1], sides[0]))[: len(sides)]:
            best = Nearest(ids, points, k, threshold)
            if len(ids) and len(keys):
                best.add(keys, others)
            found.append(best.batch())
        return pa.Table.from_batches(found)

    return best_of(_apart(cells, blocks * (blocks + 1) // 2, n * n).groupBy("i", "j").applyInArrow(compare, FOUND), k)
