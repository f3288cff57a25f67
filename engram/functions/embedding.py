"""Text embedding: an interface and a deterministic embedder that needs no model files."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
#: Texts that an embedder gets at once.
BATCH = 32
#: An embedder: a matrix with a row for each text.
Embedder = Callable[[Sequence[str | None]], np.ndarray]


def word_hash(word: str) -> int:
    """FNV-1a of the word's bytes with a final mix: the same in every process."""
    h = 0xCBF29CE484222325
    for byte in word.encode():
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 31)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


def hashed_embeddings(texts: Sequence[str | None], dim: int = DIM) -> np.ndarray:
    """Signed counts of lower-cased words, hashed to `dim` places, at unit length; a text without words is the zero vector.

    Each distinct word of a batch is hashed once, and all texts are summed at once.
    """
    words = [(t or "").lower().split() for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for own in words for w in own))}
    out = np.zeros((len(words), dim))
    if known:
        h = np.array([word_hash(w) for w in known], np.uint64)
        at = np.array([known[w] for own in words for w in own])
        row = np.repeat(np.arange(len(words)), [len(own) for own in words])
        np.add.at(out, (row, (h % np.uint64(dim)).astype(np.int64)[at]), np.where(h >> np.uint64(63), 1.0, -1.0)[at])
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size, size, 1.0)


def embed(text: Column, embedder: Embedder = hashed_embeddings, batch: int = BATCH) -> Column:
    """A column of vectors, computed in Arrow batches by a function of `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [None if t is None or t != t else t for t in part]
            found = [v for k in range(0, len(texts), batch) for v in np.asarray(embedder(texts[k : k + batch]), np.float32)]
            yield pd.Series(found, index=part.index, dtype=object)

    return run(text)


def with_vectors(records: DataFrame, vectors: DataFrame, embedder: Embedder = hashed_embeddings) -> DataFrame:
    """(id, embedding) of each record: the stored vector (id, embedding) where there is one, else that of its content."""
    stored = records.select("id", "content").join(vectors.select("id", "embedding"), "id", "left")
    have = stored.filter("embedding is not null").select("id", "embedding")
    lack = stored.filter("embedding is null").select("id", embed(F.col("content"), embedder).cast(vectors.schema["embedding"].dataType).alias("embedding"))
    return have.unionByName(lack)


class QueryEmbedder:
    """An embedder for single queries that remembers the last `most` texts."""

    def __init__(self, embedder: Embedder = hashed_embeddings, most: int = 1000):
        self.embedder, self.most, self.hits, self.misses = embedder, most, 0, 0
        self.known: OrderedDict[str, np.ndarray] = OrderedDict()

    def __call__(self, text: str) -> np.ndarray:
        if text in self.known:
            self.hits += 1
            self.known.move_to_end(text)
            return self.known[text]
        self.misses += 1
        self.known[text] = found = np.asarray(self.embedder([text]))[0]
        if len(self.known) > self.most:
            self.known.popitem(last=False)
        return found
