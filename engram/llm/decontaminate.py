"""Benchmark items inside long documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles, by powers of two. For a partition of at most u
shingles, documents are cut into overlapping windows of 2u shingles, one every u, so that an item
that a document holds lies in one window whole, and containment turns into a Jaccard similarity that has a
lower bound. The number of MinHash values follows from that bound and `miss`, the accepted chance to overlook an item. A
window and an item that share a value are a candidate; the item's whole shingle set is then looked up in the document's.
Items of fewer than UNIT / 2 shingles are looked up shingle by shingle, and an item of one to four words is one
shingle of that many words, which a document holds when the words follow each other in it.

The documents are read once, however many items there are. Up to `block` shingles of items, counted first, travel
to the tasks, and no document is shuffled. Of more items only keys do: the distinct MinHash keys of documents, less those that a bit
table of a fixed 8 MB excludes, are joined with the keys of items, and the candidates' texts are looked up and verified.

Edge cases: null and empty texts, and texts of blanks, match nothing, as items and as documents; items with equal ids or
equal texts are separate; a containment that equals the threshold is found; repeated documents are reported each, also
without an id; texts of any length are read whole, a bounded chunk of texts at a time; empty tables give an empty result;
other columns are ignored (find_contained) or pass through whatever their names (without_contained).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, cut, matched, read
from .shingles import WordHasher, minima, shingles, tidy

UNIT = 16
#: Words of the bit table, 64 bits each.
TABLE = 1 << 20
FOUND = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double"


def partition_of(size: int, n: int) -> int:
    """Of an item of n shingles of `size` words: -size for few words; 0 for fewer than UNIT / 2 shingles; p for at most UNIT * 2^(p-1)."""
    if size < SHINGLE_WORDS:
        return -size
    return 0 if n < UNIT // 2 else max(1, math.ceil(math.log2(n / UNIT)) + 1)


def values_needed(threshold: float, miss: float) -> int:
    """MinHash values after which an item in a window is overlooked with a chance of at most `miss`.

    The worst case: the smallest item of its partition (half of u shingles), of which `threshold` lies in a window of 2u.
    """
    jaccard = threshold * 0.5 / (2 + 0.5 * (1 - threshold))
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def item_keys(size: int, own: np.ndarray, values: int) -> tuple[int, np.ndarray]:
    """An item's partition and what it is looked up by: its shingles, or its numbered MinHash values."""
    if (part := partition_of(size, len(own))) <= 0:
        return part, own
    return part, (np.arange(values, dtype=np.uint64) << np.uint64(32)) + minima(own, np.array([0]), values)[:, 0].astype(np.uint64)


def document_keys(words: np.ndarray, offsets: np.ndarray, parts: list[int], values: int):
    """(partition, keys, documents) of some documents, by the partitions that items have; and their five-word shingles before that."""
    h, ends = shingles(words, offsets)
    yield h, ends
    n = np.diff(ends)
    docs = np.flatnonzero(n)
    for part in parts:
        if part < 0:
            few, at = shingles(words, offsets, -part)
            yield part, few, np.repeat(np.arange(len(n)), np.diff(at))
        elif part == 0:
            yield part, h, np.repeat(np.arange(len(n)), n)
    large = [p for p in parts if p > 0]
    if not large or not len(docs):
        return
    count = -(-n[docs] // UNIT)
    first = np.concatenate(([0], np.cumsum(count)))
    starts = np.repeat(ends[docs] - UNIT * first[:-1], count) + UNIT * np.arange(first[-1])
    base = minima(h, starts, values)
    for part in large:
        step = 1 << (part - 1)
        if step == 1:
            low, owner, last = base, np.repeat(docs, count), first[1:] - 1
        else:
            groups = -(-count // step)
            at = np.concatenate(([0], np.cumsum(groups)))
            begin = np.repeat(first[:-1] - step * at[:-1], groups) + step * np.arange(at[-1])
            low, owner, last = np.minimum.reduceat(base, begin, axis=1), np.repeat(docs, groups), at[1:] - 1
        two = low.copy()
        two[:, :-1] = np.minimum(low[:, :-1], low[:, 1:])
        two[:, last] = low[:, last]  # a document's last window has no next block
        for k in range(values):
            yield part, (np.uint64(k) << np.uint64(32)) + two[k].astype(np.uint64), owner


class Items:
    """A bounded number of items (id, words in a shingle, shingles), ready for look-up."""

    def __init__(self, rows: list[tuple], threshold: float, miss: float):
        self.rows, self.threshold, self.values = rows, threshold, values_needed(threshold, miss)
        by_part: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, (_, size, own) in enumerate(rows):
            part, keys = item_keys(size, own, self.values)
            by_part.setdefault(part, []).append((keys, np.full(len(keys), i)))
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, held in by_part.items():
            keys, owner = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            self.parts[part] = keys[order], owner[order]

    def owners(self, part: int, keys: np.ndarray, docs: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of all items that have one of the keys."""
        known, owner = self.parts[part]
        at = np.searchsorted(known, keys)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys)
        found = set()
        for doc, a, b in zip(docs[hit], at[hit], np.searchsorted(known, keys[hit], "right")):
            found.update((int(doc), int(i)) for i in owner[a:b])
        return found


def n_shared(own: np.ndarray, h: np.ndarray) -> int:
    return int(np.isin(own, h).sum())


def enough(shared: int, n: int, threshold: float) -> bool:
    return shared >= threshold * n - 1e-9


def matches(items: Items, column, hasher: WordHasher):
    """(row, item, shared) of each item that a text of an Arrow column holds."""
    parts = sorted(items.parts)
    for a, _, words, offsets in hasher.chunks(column):
        keys = document_keys(words, offsets, parts, items.values)
        h, ends = next(keys)
        found: set[tuple[int, int]] = set()
        for part, k, docs in keys:
            found |= items.owners(part, k, docs)
        for doc, item in sorted(found):
            _, size, own = items.rows[item]
            shared = 1 if size < SHINGLE_WORDS else n_shared(own, h[ends[doc] : ends[doc + 1]])
            if enough(shared, len(own), items.threshold):
                yield a + doc, item, shared


def search(items: Items):
    """mapInArrow: (doc_id, text) to the items that each document holds."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for row, item, shared in matches(items, batch.column(1), hasher):
                name, _, own = items.rows[item]
                rows.append((ids[row], name, shared, len(own), shared / len(own)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return tidy(run)


def drop(items: Items, text: int):
    """mapInArrow over rows in a struct, whose field number `text` is the text, to the rows that hold no item."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            keep = np.ones(batch.num_rows, np.bool_)
            for row, _, _ in matches(items, batch.column(0).flatten()[text], hasher):
                keep[row] = False
            yield pa.record_batch([batch.column(0).filter(pa.array(keep))], ["row"])

    return tidy(run)


def item_sets():
    """mapInArrow: (item_id, text) to the words in a shingle and the item's distinct shingles; items without words go."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, b, words, offsets in hasher.chunks(batch.column(1)):
                for i in range(b - a):
                    own = words[offsets[i] : offsets[i + 1]]
                    if size := min(len(own), SHINGLE_WORDS):
                        rows.append((ids[a + i], size, np.unique(shingles(own, np.array([0, len(own)]), size)[0]).view(np.int64)))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["item_id", "size", "shingles"])

    return run


def prepared(items: DataFrame, threshold: float, miss: float, block: int) -> tuple[DataFrame, Items | None]:
    """The items' shingles with a number for each item; and all of them for look-up if they are at most `block` shingles."""
    sets = items.select("item_id", "text").mapInArrow(item_sets(), "item_id bigint, size int, shingles array<bigint>")
    sets = cut(sets.withColumn("uid", F.monotonically_increasing_id()))
    n = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    if n > block:
        return sets, None
    rows = [(r["item_id"], r["size"], np.array(r["shingles"], np.int64).view(np.uint64)) for r in sets.orderBy("uid").toLocalIterator()]
    return sets, Items(rows, threshold, miss)


def table_place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bit of the table that stand for a key."""
    place = keys * np.uint64(0x9E3779B97F4A7C15)
    return (place >> np.uint64(44)).astype(np.int64), (place >> np.uint64(38)) & np.uint64(63)


def keys_of_items(values: int):
    """mapInArrow: (uid, size, shingles) to (part, key, uid, word, bit), the last two as in the bit table."""

    def run(batches):
        for batch in batches:
            for uid, size, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                part, keys = item_keys(size, np.array(own, np.int64).view(np.uint64), values)
                word, bit = table_place(keys)
                cols = [pa.array([part] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array([uid] * len(keys), pa.int64()), pa.array(word, pa.int32()), pa.array((np.uint64(1) << bit).view(np.int64))]
                yield pa.record_batch(cols, ["part", "key", "uid", "word", "bit"])

    return run


def keys_of_documents(parts: list[int], values: int, table: np.ndarray):
    """mapInArrow: (t1, t2, text) to the distinct (t1, t2, part, key) whose bit is set in the table."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            names = [batch.column(k).to_numpy() for k in (0, 1)]
            for a, _, words, offsets in hasher.chunks(batch.column(2)):
                keys = document_keys(words, offsets, parts, values)
                next(keys)
                for part, key, docs in keys:
                    word, bit = table_place(key)
                    hit = ((table[word] >> bit) & np.uint64(1)) == 1
                    if hit.any():
                        of, asked = np.unique(np.stack([docs[hit].astype(np.uint64), key[hit]]), axis=1)
                        at = a + of.astype(np.int64)
                        cols = [pa.array(names[0][at]), pa.array(names[1][at]), pa.array(np.full(len(at), part, np.int32)), pa.array(asked.view(np.int64))]
                        yield pa.record_batch(cols, ["t1", "t2", "part", "key"])

    return tidy(run)


def verified(threshold: float):
    """mapInArrow: (t1, t2, text, [(item_id, size, shingles)]) to the items that the text holds, by their numbers."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            t1, t2, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for a, b, words, offsets in hasher.chunks(batch.column(2)):
                for i in range(b - a):
                    mine = words[offsets[i] : offsets[i + 1]]
                    by_size: dict[int, np.ndarray] = {}
                    for item in batch.column(3)[a + i].as_py():
                        if (size := item["size"]) not in by_size:
                            by_size[size] = np.unique(shingles(mine, np.array([0, len(mine)]), size)[0])
                        own = np.array(item["shingles"], np.int64).view(np.uint64)
                        if enough(shared := n_shared(own, by_size[size]), len(own), threshold):
                            rows.append((t1[a + i], t2[a + i], item["uid"], item["item_id"], shared, len(own)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], ["t1", "t2", "uid", "item_id", "n_shared", "n_item"])

    return tidy(run)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; what a text holds depends on it alone."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def found_texts(docs: DataFrame, sets: DataFrame, threshold: float, miss: float, together: int = 500) -> DataFrame:
    """(t1, t2, uid, item_id, n_shared, n_item) of the texts of docs (text), by joins on keys: for any number of items."""
    values = values_needed(threshold, miss)
    keys = cut(sets.select("uid", "size", "shingles").mapInArrow(keys_of_items(values), "part int, key bigint, uid bigint, word int, bit bigint"))
    parts = sorted(r["part"] for r in keys.select("part").distinct().collect())  # one for each power of two of the items' sizes
    table = np.zeros(TABLE, np.uint64)
    bits = keys.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # TABLE rows at most
    table[bits["word"].to_numpy()] = bits["bit"].to_numpy().view(np.uint64)
    texts = docs.select(*text_key(F.col("text")), "text").filter("text is not null")
    near = texts.mapInArrow(keys_of_documents(parts, values, table), "t1 bigint, t2 bigint, part int, key bigint")
    pairs = cut(near.join(keys.select("part", "key", "uid"), ["part", "key"]).select("t1", "t2", "uid").distinct())
    # A text with many candidates gets several rows of at most about `together` of them.
    rows = pairs.groupBy("t1", "t2").agg(F.ceil(F.count("*") / together).alias("rows"))
    dealt = pairs.join(rows, ["t1", "t2"]).join(sets, "uid").groupBy("t1", "t2", F.pmod(F.xxhash64("uid"), "rows").alias("row"))
    dealt = dealt.agg(F.collect_list(F.struct("uid", "item_id", "size", "shingles")).alias("items"))
    asked = texts.join(dealt, ["t1", "t2"]).select("t1", "t2", "text", "items")
    return asked.mapInArrow(verified(threshold), "t1 bigint, t2 bigint, uid bigint, item_id bigint, n_shared bigint, n_item bigint").distinct()


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, miss: float = 1e-5, block: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of each item (item_id, text) of which a document (doc_id, text) holds `threshold` or more."""
    sets, ready = prepared(items, threshold, miss, block)
    if ready is not None:
        return docs.select("doc_id", "text").mapInArrow(search(ready), FOUND) if ready.rows else docs.sparkSession.createDataFrame([], FOUND)
    found = found_texts(docs, sets, threshold, miss)
    out = docs.select("doc_id", *text_key(F.col("text"))).join(found, ["t1", "t2"])
    return out.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_contained(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, miss: float = 1e-5, block: int = 4_000_000) -> DataFrame:
    """The rows of docs (text, others) that hold no item."""
    sets, ready = prepared(items, threshold, miss, block)
    rows = docs.select(F.struct("*").alias("row"))
    if ready is not None:
        return rows.mapInArrow(drop(ready, docs.columns.index("text")), rows.schema).select("row.*") if ready.rows else docs
    found = cut(found_texts(docs, sets, threshold, miss).select("t1", "t2").distinct())
    return matched(rows.select("row", *text_key(F.col("row.text"))), found, ["t1", "t2"], "left_anti").select("row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def contained_sql(documents: str = "documents", threshold: float = SIMILARITY) -> str:
    """DuckDB: the common table expression `found` with the columns of find_contained; runs of 1 to 4 words for items of so many."""
    split = lambda table, key: f"SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {table}"
    return f"""
item_words AS ({split("benchmark", "item_id")}),
item_shingle AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS s
  FROM (SELECT *, least(5, len(ws)) AS k FROM item_words WHERE len(ws) > 0)),
item_size AS (SELECT item_id, count(*) AS n_item FROM item_shingle GROUP BY item_id),
doc_words AS ({split(documents, "doc_id")}),
doc_shingle AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT k FROM item_shingle) WHERE len(ws) >= k),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingle JOIN item_shingle USING (k, s) GROUP BY doc_id, item_id),
found AS (
  SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
  FROM shared JOIN item_size USING (item_id) WHERE n_shared >= {threshold} * n_item - 1e-9)"""


OP7_SQL = f"WITH {contained_sql()} SELECT * FROM found"
