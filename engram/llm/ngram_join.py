"""N-gram Jaccard self-join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Signatures: MinHash values in `bands` bands of `rows` values, and a 128-bit key of the exact shingle set.
2. Documents of one set key are a class, whatever their ids; it gets a number, and exact copies are joined once.
3. Shuffle on band hashes: a bucket is the classes that share one. Of buckets with the same members one is kept (by a count and a
   128-bit sum of hashes), and a bucket goes if all its members meet in one larger bucket, the largest that each of them has.
4. The members of a bucket are compared with each other, by products of incidence matrices; a pair that
   shares several buckets is compared in the first of them only, so pairs that share none never meet. Buckets of more than `cell`
   classes or `weight` shingles are split into blocks, and pairs of blocks go to different tasks. A task returns a count of links per class
   and a spanning forest: no row per pair is ever made.
5. The forests joined give the near-duplicate class of each document.

The recall of the banding at similarity s is 1 - (1 - s^rows)^bands: 0.9999 at 0.8 with the defaults, more above. What is
found is exact: every link is verified on full sets, and every pair that shares a bucket is compared.

Edge cases: a text of one to four words has one shingle of all its words; null texts and texts of blanks have none,
link to nothing and are a class each; repeated rows are exact copies of each other; an id may come with several texts, each
of which is linked by itself; rows with a null id are linked like others, but never name a class, so a class of such
rows only has a null class_id; a similarity that equals the threshold is a link, and of ids the smallest names the class; texts of any
length are read whole, a bounded chunk of texts at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, bounded, cut, read
from .components import components
from .shingles import WordHasher, minima, mixed, shingles, tidy

BANDS, ROWS = 30, 6
SIGNATURE = "doc_id bigint, t1 bigint, t2 bigint, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>"


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - (1 - similarity**rows) ** bands


def set_key(unique: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set, whatever its order."""
    a, b = int(mixed(unique).sum(dtype=np.uint64)), int(mixed(unique + np.uint64(len(unique))).sum(dtype=np.uint64))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


def sign(bands: int, rows: int, size: int):
    """mapInArrow: (doc_id, t1, t2, text) to signatures; null keys and bands without shingles."""
    weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            n, keys, values = [], [], []
            for a, b, words, offsets in hasher.chunks(batch.column(3)):
                h, ends = shingles(words, offsets, size, short=True)
                full = np.flatnonzero(np.diff(ends))
                low = minima(h, ends[full], bands * rows).astype(np.uint64).reshape(bands, rows, len(full))
                hashed = mixed((low * weights[None, :, None]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[:, None])
                of = dict(zip(full.tolist(), hashed.T.view(np.int64).tolist() if len(full) else []))
                for i in range(b - a):
                    unique = np.unique(h[ends[i] : ends[i + 1]])
                    n.append(len(unique))
                    keys.append(set_key(unique) if len(unique) else (None, None))
                    values.append(of.get(i))
            sets = [pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)]
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), *sets, pa.array(values, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "n_shingles", "set1", "set2", "bands"])

    return tidy(run)


def first_here(bucket: int, buckets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix left x right of the pairs whose first bucket in common is this one."""
    here = np.ones((len(left), len(right)), np.bool_)
    earlier: dict[int, list[list[int]]] = {}
    for side, members in enumerate((left, right)):
        for place, k in enumerate(members):
            for other in buckets[k][buckets[k] < bucket].tolist():
                earlier.setdefault(other, [[], []])[side].append(place)
    for x, y in earlier.values():
        if x and y:
            here[np.ix_(x, y)] = False
    return here


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, width: int = 4096) -> np.ndarray:
    """Boolean matrix left x right of the pairs of sets that are similar."""
    n = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    often = np.flatnonzero(np.bincount(column) > 1)  # a shingle of one set is shared by no pair
    place = np.full(len(values), -1)
    place[often] = np.arange(len(often))
    at = place[column]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(left), len(right)), np.float32)
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    for first in range(0, len(often), width):
        a, b = np.searchsorted(at, [first, first + width])
        own, k = owner[a:b], at[a:b] - first
        x, y = np.zeros((len(left), min(width, len(often) - first)), np.float32), np.zeros((len(right), min(width, len(often) - first)), np.float32)
        x[row[own][row[own] >= 0], k[row[own] >= 0]] = 1
        y[col[own][col[own] >= 0], k[col[own] >= 0]] = 1
        both += x @ y.T
    union = n[left][:, None] + n[right][None, :] - both
    return both >= threshold * union - 1e-6


def verify(threshold: float, size: int):
    """mapInArrow over rows sorted by cell: (bucket, i, j, cid, blk, n, buckets, text) to (cid, n_links, root), see step 4."""

    def close(cell, members, out):
        (bucket, i, j), ids = cell, [m[0] for m in members]
        if len(members) < 2:
            return
        sets, blocks, copies = [m[4] for m in members], np.array([m[1] for m in members]), np.array([m[2] for m in members])
        left = np.flatnonzero(blocks == i)
        right = left if i == j else np.flatnonzero(blocks == j)
        if not len(left) or not len(right):
            return
        here = first_here(bucket, [m[3] for m in members], left, right)
        if i == j:
            np.fill_diagonal(here, False)
        if not here.any():
            return
        like = linked(sets, left, right, threshold) & here
        counts = np.zeros(len(members), np.int64)
        counts[left] += like @ copies[right]
        if i != j:
            counts[right] += like.T @ copies[left]
        label = np.arange(len(members))
        while True:  # the smallest linked member, until nothing changes
            new = label.copy()
            new[left] = np.minimum(new[left], np.where(like, label[right][None, :], len(members)).min(1))
            new[right] = np.minimum(new[right], np.where(like, new[left][:, None], len(members)).min(0))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        for k in np.flatnonzero(counts):
            out.append((ids[k], int(counts[k]), ids[label[k]]))

    def run(batches):
        hasher, at, members, out = WordHasher(), None, [], []
        for batch in batches:
            bucket, i, j, cid, blk, n = (batch.column(k).to_pylist() for k in range(6))
            for a, b, words, offsets in hasher.chunks(batch.column(7)):
                for k in range(a, b):
                    if (cell := (bucket[k], i[k], j[k])) != at:
                        if at is not None:
                            close(at, members, out)
                        at, members = cell, []
                    own = words[offsets[k - a] : offsets[k - a + 1]]
                    unique = np.unique(shingles(own, np.array([0, len(own)]), size, short=True)[0])
                    members.append((cid[k], blk[k], n[k], np.array(batch.column(6)[k].as_py(), np.int64), unique))
            if len(out) > 20_000:
                yield _links(out)
                out = []
        if at is not None:
            close(at, members, out)
        yield _links(out)

    return tidy(run)


def _links(rows):
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], ["cid", "n_links", "root"])


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, cid) of classes (cid, bands), by band hashes; every pair of classes that shares a band hash shares a row's bucket."""
    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "cid")).alias(f"x{k}") for k in (1, 2)]
    full = banded.groupBy("bucket").agg(F.count("*").alias("c"), *same).filter("c > 1")
    kept = cut(full.groupBy("c", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "c"))
    rows = cut(banded.join(bounded(kept), "bucket"))
    # Of each class its largest bucket; a bucket whose members all have the same one, and that isn't it, makes no new pair.
    order = F.struct("c", "bucket")
    largest = rows.groupBy("cid").agg(F.max(order).alias("top")).select("cid", F.col("top.bucket").alias("top"))
    needed = rows.join(largest, "cid").groupBy("bucket").agg(F.min("top").alias("a"), F.max("top").alias("b")).filter("a <> b or a = bucket")
    return rows.join(needed.select("bucket"), "bucket", "left_semi")


def verified_links(docs: DataFrame, classes: DataFrame, threshold: float, size: int, cell: int, weight: int) -> DataFrame:
    """(cid, n_links, root): similar classes, see steps 3 and 4."""
    met = cut(shared_buckets(classes.select("cid", "bands")).join(classes.select("cid", "n", "n_shingles", "t"), "cid"))
    blocks = F.greatest(F.ceil(F.count("*") / cell), F.ceil(F.sum("n_shingles") / weight)).cast("int")
    rows = met.join(met.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    rows = rows.select("cid", F.struct("bucket", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("blk"), "blocks").alias("place"))
    # One row per class that meets others, with all its buckets (at most one per band), and the key of one of its texts.
    places = rows.groupBy("cid").agg(F.collect_list("place").alias("places"))
    asked = cut(met.select("cid", "n", "t.*").distinct().join(places, "cid"))
    # Only these texts are read again, each once, and go to a cell for every bucket and every block of it.
    keys = bounded(asked.select(F.col("doc_id").alias("_id"), "t1", "t2", "cid"))
    texts = docs.select("doc_id", *text_key(F.col("text")), "text").join(keys, ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    found = texts.groupBy("cid").agg(F.first("text").alias("text")).join(asked.select("cid", "n", "places"), "cid")
    found = found.select("cid", "n", F.transform("places", lambda p: p.bucket).alias("buckets"), F.explode("places").alias("p"), "text")
    cells = found.select("cid", "n", "buckets", "text", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("other"))
    cells = cells.select("bucket", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "cid", "blk", "n", "buckets", "text")
    cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")
    return cells.mapInArrow(verify(threshold, size), "cid bigint, n_links bigint, root bigint")


def text_key(text) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def join_similar(
    docs: DataFrame, threshold: float = SIMILARITY, size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, cell: int = 1000, weight: int = 2_000_000,
) -> DataFrame:
    """One row per row of docs (doc_id, text): class_id, the smallest id it is linked to directly or through others; rep_id, the
    smallest id with the same shingle set; n_links, the number of other documents that are similar; n_shingles; class, a number
    that tells classes apart whatever their ids (null without shingles); t1 and t2, which stand for the text."""
    keyed = docs.select("doc_id", *text_key(F.col("text")), "text")
    signed = cut(keyed.mapInArrow(sign(bands, rows, size), SIGNATURE))
    full = signed.filter("set1 is not null")
    # Bands of equal sets are equal, so any will do; `t` names one text of the class.
    one = [F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "t1", "t2")).alias("t")]
    classes = full.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *one)
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    links = cut(verified_links(docs, classes, threshold, size, cell, weight))
    similar = links.groupBy("cid").agg(F.sum("n_links").alias("more"))
    near = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    near = near.select(F.col("u").alias("cid"), F.col("v").alias("class")).join(classes.select("cid", "rep"), "cid")
    names = near.groupBy("class").agg(F.min("rep").alias("name"))
    near = cut(near.join(names, "class").join(similar, "cid").select("cid", "class", "name", "more"))
    named = classes.select("set1", "set2", "rep", "n", "cid").join(bounded(near), "cid", "left")
    named = named.select("set1", "set2", "rep", "n", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("class", "cid").alias("class"), F.when(F.col("class").isNull(), F.col("rep")).otherwise(F.col("name")).alias("name"))
    out = signed.drop("bands").join(named, ["set1", "set2"], "left")
    none = F.col("class").isNull()
    return out.select(
        "doc_id",
        F.when(none, F.col("doc_id")).otherwise(F.col("name")).alias("class_id"),
        F.when(none, F.col("doc_id")).otherwise(F.col("rep")).alias("rep_id"),
        F.coalesce(F.col("n") - 1 + F.col("more"), F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
        "class", "t1", "t2",
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("class", "t1", "t2")


def similar_sql(documents: str = "documents", threshold: float = SIMILARITY) -> str:
    """DuckDB: common table expressions `classes` (doc_id, class_id) and `link_counts` by all pairs that share a shingle."""
    return f"""
worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {documents}),
shingle AS (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS s FROM worded),
size_of AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM pair JOIN size_of p ON x = p.doc_id JOIN size_of q ON y = q.doc_id WHERE c >= {threshold} * (p.n + q.n - c) - 1e-6),
reach AS (SELECT doc_id AS x, doc_id AS y FROM {documents} UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
link_counts AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x)"""


OP1_SQL = f"""
WITH RECURSIVE {similar_sql()},
same AS (SELECT doc_id, list_sort(list(s)) AS k FROM shingle GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep_id FROM same)
SELECT d.doc_id, class_id, coalesce(rep_id, d.doc_id) AS rep_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles
FROM documents d JOIN classes USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN link_counts USING (doc_id) LEFT JOIN size_of USING (doc_id)
"""
