"""Approximate nearest neighbours: vectors in clusters, of which a query visits the nearest few.

Centres come from k-means over a bounded sample, chosen by a hash of the id; every vector belongs to its nearest centre. How many
clusters a query visits, its probes, is measured when the index is built: sampled vectors ask for their neighbours in the sample, and
the fewest probes that find `recall` of them are taken. Scores of what is visited are exact. Clusters are a partition column
when the index is saved, so a search reads only the folders of the clusters it visits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_snapshot, write_snapshot
from .vector import best_of, compare_cells, matrix, top_k


def _sizes(points: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)


def nearest_centres(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each point, nearest first."""
    d = _sizes(centres)[None, :] - 2 * points @ centres.T
    if n == 1:
        return d.argmin(1)[:, None]
    near = np.argpartition(d, n - 1, 1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(points), 1))
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)


def centres_of(points: np.ndarray, clusters: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means; a centre that loses all its points stays where it was."""
    centres = points[np.random.RandomState(seed).permutation(len(points))[:clusters]].copy()
    for _ in range(rounds):
        own = nearest_centres(points, centres, 1)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def probes_for(points: np.ndarray, centres: np.ndarray, recall: float, k: int, queries: int = 200) -> int:
    """The fewest clusters whose visit finds `recall` of the k nearest neighbours of the first points, other than themselves."""
    own = nearest_centres(points, centres, 1)[:, 0]
    asks = points[:queries]
    d = _sizes(points)[None, :] - 2 * asks @ points.T
    d[np.arange(len(asks)), np.arange(len(asks))] = np.inf
    near = np.argsort(d, 1, kind="stable")[:, : min(k, max(1, len(points) - 1))]
    order = nearest_centres(asks, centres, len(centres))
    place = np.argsort(order, 1)  # of each centre, its place in a query's order
    needed = np.take_along_axis(place, own[near], 1) + 1
    return int(min(len(centres), np.quantile(needed, recall, method="inverted_cdf")))


class ClusteredIndex:
    """Vectors (cluster, id, embedding) with their centres."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, probes: int):
        self.rows, self.centres, self.probes = rows, centres, probes

    @classmethod
    def build(cls, vectors: DataFrame, clusters: int | None = None, recall: float = 0.95, k: int = 10, sample: int = 20_000, seed: int = 7) -> ClusteredIndex:
        """Null vectors are left out. Without a number of clusters there are as many as the square root of the number of vectors, 4096 at most."""
        vectors = vectors.select("id", "embedding").filter("embedding is not null")
        drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().combine_chunks()
        if not len(drawn):
            return cls(vectors.select(F.lit(0).alias("cluster"), "id", "embedding"), np.zeros((1, 0)), 1)
        points = matrix(drawn["embedding"].combine_chunks())
        clusters = clusters or max(1, min(4096, round(vectors.count() ** 0.5)))
        centres = centres_of(points, min(clusters, len(points)), seed=seed)
        return cls(assigned(vectors, centres), centres, probes_for(points, centres, recall, k))

    def visits(self, ef: int | None = None) -> int:
        """Probes of a search; an `ef` above the default share of the vectors raises them in proportion."""
        if ef is None:
            return self.probes
        return min(len(self.centres), max(self.probes, -(-ef * len(self.centres) // max(1, self.rows.count()))))

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        """id and score of about the k nearest vectors; only the clusters visited are read."""
        asked = np.asarray([float(x) for x in query])[None, :]
        if self.centres.shape[1] not in (0, asked.shape[1]):
            raise ValueError(f"expected {self.centres.shape[1]} dimensions, the query has {asked.shape[1]}")
        near = nearest_centres(asked, self.centres, self.visits(ef))[0].tolist() if self.centres.shape[1] else [0]
        return top_k(self.rows.filter(F.col("cluster").isin(near)), query, k).select("id", "score")

    def _cells(self, queries: DataFrame, probes: int, block: int) -> DataFrame:
        """Cells (cluster, i, j, query, id, embedding); a cluster of more than `block` rows is dealt into parts, on both sides."""
        asks = assigned(queries.select("id", "embedding").filter("embedding is not null"), self.centres, probes)
        parts = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        n, m = parts(asks, "n"), parts(self.rows, "m")  # a row a centre, of which there are few
        sizes = F.broadcast(n.join(m, "cluster"))
        own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asks.join(sizes, "cluster").select("cluster", own("n").alias("i"), every("m").alias("j"), F.lit(True).alias("query"), "id", "embedding")
        right = self.rows.join(sizes, "cluster").select("cluster", every("n").alias("i"), own("m").alias("j"), F.lit(False).alias("query"), "id", "embedding")
        return left.unionByName(right)

    def knn(self, queries: DataFrame, k: int, ef: int | None = None, least: float = 0.0, skip_self: bool = True, block: int = 8192) -> DataFrame:
        """src, dst, score and rank of about the k nearest vectors of every query (id, embedding) that reach `least`: a query goes to the
        clusters it visits, and nothing is collected."""
        return best_of(compare_cells(self._cells(queries, self.visits(ef), block), ["cluster", "i", "j"], k, least, skip_self), k)

    def links(self, threshold: float, k: int) -> DataFrame:
        """The same for all vectors of the index and a least score; of neighbours as near as that, few are in clusters not visited."""
        return self.knn(self.rows.select("id", "embedding"), k, least=threshold)

    def save(self, root: str) -> int:
        spark = self.rows.sparkSession
        table = pa.table({"cluster": range(len(self.centres)), "centre": [c.tolist() for c in self.centres], "probes": [self.probes] * len(self.centres)})
        write_snapshot(spark.createDataFrame(table.to_pylist(), "cluster int, centre array<double>, probes int").coalesce(1), f"{root}/centres")
        return write_snapshot(self.rows, f"{root}/rows", partition_by=["cluster"])

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> ClusteredIndex:
        found = read_snapshot(spark, f"{root}/centres").orderBy("cluster").collect()  # a row a centre
        return cls(read_snapshot(spark, f"{root}/rows").select("cluster", "id", "embedding"), np.array([r["centre"] for r in found]), found[0]["probes"])


def assigned(vectors: DataFrame, centres: np.ndarray, n: int = 1) -> DataFrame:
    """(cluster, id, embedding): each vector with the numbers of its n nearest centres, a row each."""

    def run(batches):
        for batch in batches:
            near = nearest_centres(matrix(batch.column(1), centres.shape[1]), centres, n)
            at = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.record_batch([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["cluster", "id", "embedding"])

    kinds = vectors.schema
    return vectors.select("id", "embedding").mapInArrow(run, f"cluster int, id {kinds['id'].dataType.simpleString()}, embedding {kinds['embedding'].dataType.simpleString()}")
