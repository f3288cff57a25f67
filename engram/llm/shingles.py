"""Word hashes, word shingles and MinHash on flat arrays.

Texts are read as the bytes of an Arrow column, a bounded chunk at a time, so memory follows the longest text of a batch
and not the batch, and no Python object is made per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SHINGLE_WORDS

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xFF51AFD7ED558CCD)
#: Bytes whose hashes are computed at once; longer words are hashed by themselves.
PIECE = 1 << 18
BLANK = np.zeros(256, np.bool_)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def chunks(offsets: np.ndarray, most: int):
    """Ranges of texts of about `most` bytes or words in all, or of one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its texts; a null text has none."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 4_000_000):
    """(first, last, texts) of a string column, about `most` bytes at a time."""
    _, at = text_bytes(column)
    for a, b in chunks(at, most):
        yield a, b, column.slice(a, b - a).to_pylist()


def tidy(run):
    """A function for mapInArrow that, when its partition ends, gives memory which it doesn't need any more back to the system: the
    worker lives on and waits for its next task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


class WordHasher:
    """64-bit hashes of words: a polynomial over one random number per byte, taken from running sums, then mixed."""

    def __init__(self, seed: int = 11):
        rng = np.random.RandomState(seed)
        self.of_byte = rng.randint(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)
        self.grown(PIECE)

    def grown(self, n: int) -> None:
        """Powers of the multiplier and of its inverse modulo 2^64, for at least n places."""
        if len(self.power) < n + 1:
            both = []
            for x in (int(MULTIPLIER), pow(int(MULTIPLIER), -1, 1 << 64)):
                steps = np.full(n + 1, x, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps))
            self.power, self.inverse = both

    def words(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of some texts, given as bytes and offsets, and the offsets of each text's words."""
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        inside = ~BLANK[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        bounds = texts[(texts > 0) & (texts < len(data))]
        first[bounds], last[bounds - 1] = inside[bounds], inside[bounds - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        del inside, first, last
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            begin = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
            self.grown(int(ends[j - 1] - begin))
            sums = np.zeros(ends[j - 1] - begin + 1, np.uint64)
            np.cumsum(self.of_byte[data[begin : ends[j - 1]]] * self.power[: len(sums) - 1], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - begin] - sums[starts[i:j] - begin]) * self.inverse[starts[i:j] - begin]
            i = j
        return mixed(out), np.searchsorted(starts, texts)

    def chunks(self, column: pa.Array, most: int = 1_500_000):
        """(first, last, hashes, offsets) of the lower-cased words of the texts of a column, about `most` bytes at a time."""
        _, at = text_bytes(column)
        for a, b in chunks(at, most):
            data, texts = text_bytes(pc.utf8_lower(column.slice(a, b - a)))
            yield a, b, *self.words(data, texts)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, text by text, and their offsets.

    With `short`, a text with some words but fewer than `size` has one shingle of all of them; otherwise none.
    """
    n = np.diff(offsets)
    counts = np.maximum(n - size + 1, 0)
    if len(words) >= size:
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h = h * MULTIPLIER + words[k : len(words) - size + 1 + k]
        starts = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        h = h[starts + np.arange(counts.sum())]
    else:
        h = np.empty(0, np.uint64)
    h = mixed(h)
    ends = np.concatenate(([0], np.cumsum(counts)))
    if short and (few := np.flatnonzero((n > 0) & (n < size))).size:
        own = []
        for i in few:
            x = np.uint64(n[i])
            for w in words[offsets[i] : offsets[i + 1]]:
                x = np.uint64((int(x) * int(MULTIPLIER) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            own.append(x)
        h = np.insert(h, ends[few], mixed(np.array(own, np.uint64)))
        counts = counts.copy()
        counts[few] = 1
        ends = np.concatenate(([0], np.cumsum(counts)))
    return h, ends


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * FINAL
    return h ^ (h >> np.uint64(29))


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks, each pair of which permutes 32-bit numbers."""
    rng = np.random.RandomState(seed)
    draw = lambda: rng.randint(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


def minima(h: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """MinHash values (count x segments) of the non-empty segments of h that begin at `starts`."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(starts)), np.uint32)
    work = np.empty_like(low)
    for k, (a, b) in enumerate(zip(*permutations(count))):
        np.bitwise_xor(low, b, out=work)
        np.multiply(work, a, out=work)
        out[k] = np.minimum.reduceat(work, starts) if len(starts) else 0
    return out
