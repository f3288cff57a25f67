"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: each partition packs its own pieces best-fit decreasing
and emits the bins that are nearly full; the underfull bins are items of the next round,
where fewer, larger groups of them are packed again, until one group is left or a round
gains nothing. A group is packed twice, with its underfull bins as whole items and, beyond the plain method, with
their members as loose items; the way that needs fewer bins is taken (`loose` turns the second one off).
Every task holds a bounded number of items. Nothing is dropped: bins that never fill are emitted as they are.

Edge cases: null and empty texts are one token (the end id); repeated rows, and rows without an id, are packed
once each; items of equal length are ordered by document and piece; a text of any length is tokenised whole, and cut only after that;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .shingles import pieces, tidy

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BIN = f"closed boolean, fill long, members array<{MEMBER}>"
#: Texts of other characters than these go to the tokenizer itself, whose tables of letters are the authority.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ſ‐-‧€]")
#: How a byte-level tokenizer splits a text before its merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked_by_merges(told: dict) -> bool:
    """Whether the ids of a vocabulary stand for its merges: every token of several bytes is made by one merge, merges come in
    the order of their ids, and nothing else bears on the result."""
    model, added = told["model"], {t["content"] for t in told["added_tokens"]}
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return False
    vocab = {token: i for token, i in model["vocab"].items() if token not in added}
    byte = byte_of_char()
    if any(c not in byte for token in vocab for c in token):
        return False
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab.get(token, -1) for token in made]
    single = [i for token, i in vocab.items() if len(token) == 1]
    return all(a < b for a, b in zip([max(single, default=-1), *ids], ids)) and len(made) + len(single) == len(vocab) and len(single) == 256


class TokenBytes:
    """Token ids of texts as little-endian 32-bit bytes.

    The merges of a byte-level vocabulary are applied by the faster of two libraries that agree on them; texts with added
    tokens or with characters outside of the plain ranges are left to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.added = [t["content"] for t in told["added_tokens"]]
        pre, byte = told["pre_tokenizer"] or {}, byte_of_char()
        self.fast = None
        if told["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and ranked_by_merges(told):
            ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in self.added}
            self.fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or NOT_PLAIN.search(text) or any(t in text for t in self.added):
            return self.exact(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def cut_document(doc_id, data: bytes, size: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc32) of each piece; only the first may be shorter than `size`, when there are several."""
    n = len(data) // 4
    first = n if n <= size else n % size or size
    ends = range(first, n + 1, size)
    starts = [0, *ends][: len(ends)]
    return [(doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, ends))]


def best_fit(items: list[tuple[int, list]], size: int) -> list[tuple[int, list]]:
    """Best-fit decreasing of (length, members) items into bins (fill, members).

    `free` has bit r set while some bin has r tokens left: the best fit is its lowest set bit from the length on.
    """
    left: list[list[list]] = [[] for _ in range(size + 1)]
    free, bins = 0, []
    for length, members in items:
        if fits := free >> length:
            r = length + (fits & -fits).bit_length() - 1
            at = left[r].pop()
            if not left[r]:
                free ^= 1 << r
            at[0] += length
            at[1].extend(members)
        else:
            at, r = [length, list(members)], size
            bins.append(at)
        if rest := r - length:
            left[rest].append(at)
            free |= 1 << rest
    return [(fill, members) for fill, members in bins]


def _order(item: tuple[int, list]):
    length, members = item
    return -length, tuple((m[0] is None, m[0] or 0, m[1]) for m in members)


def _batch(bins: list[tuple[int, list]], full: int) -> pa.RecordBatch:
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    member = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return pa.record_batch(
        [
            pa.array([fill >= full for fill, _ in bins], pa.bool_()),
            pa.array([fill for fill, _ in bins], pa.int64()),
            pa.array([[dict(zip(names, m)) for m in members] for _, members in bins], pa.list_(member)),
        ],
        ["closed", "fill", "members"],
    )


def first_round(path: str, size: int, full: int, block: int):
    """Tokenise whole texts and pack each block of pieces of a partition."""

    def run(batches):
        tokens = TokenBytes(path)
        items: list[tuple[int, list]] = []

        def flush():
            bins = best_fit(sorted(items, key=_order), size)
            for k in range(0, len(bins), 2000):
                yield _batch(bins[k : k + 2000], full)
            items.clear()

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in pieces(batch.column(1)):
                for doc_id, text in zip(ids[a:b], texts):
                    items += [(p[3], [p]) for p in cut_document(doc_id, tokens.encode(text or "") + bytes(4), size)]
                    if len(items) >= block:
                        yield from flush()
        yield from flush()

    return tidy(run)


def next_round(size: int, full: int, block: int, loose: bool):
    """Pack underfull bins again: as whole items, or with their members loose if that is allowed and makes fewer bins."""

    def run(batches):
        bins: list[tuple[int, list]] = []

        def flush():
            bins.sort(key=_order)
            best = best_fit(bins, size)
            if loose:
                best = min(best_fit(sorted(((m[3], [m]) for _, members in bins for m in members), key=_order), size), best, key=len)
            for k in range(0, len(best), 2000):
                yield _batch(best[k : k + 2000], full)
            bins.clear()

        for batch in batches:
            fills, members = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for fill, ms in zip(fills, members):
                bins.append((fill, [tuple(m.values()) for m in ms]))
                if len(bins) >= block:
                    yield from flush()
        yield from flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, slack: float = 0.01, block: int = 50_000, shrink: float = 0.95, loose: bool = True) -> DataFrame:
    """Pack every document of `docs` (doc_id, text) into sequences of at most `max_tokens` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A bin within `slack`
    of full is closed at once. `block` bounds the items a task holds. Rounds end when one task holds all
    underfull bins, or when a round leaves more than `shrink` of them.
    """
    full = max_tokens - int(max_tokens * slack)
    done, parts = [], None
    state = cut(docs.select("doc_id", "text").mapInArrow(first_round(tokenizer_path, max_tokens, full, block), BIN))
    before = None
    while True:
        open_bins = state.filter("not closed")
        n = open_bins.count()
        done.append(state.filter("closed"))
        if n == 0 or parts == 1 or (before is not None and n > shrink * before):
            done.append(open_bins)
            break
        before, parts = n, -(-2 * n // block)
        state = cut(open_bins.repartition(parts).mapInArrow(next_round(max_tokens, full, block, loose), BIN))
    sequences = done[0]
    for more in done[1:]:
        sequences = sequences.unionByName(more)
    # The bins are checkpointed, so this numbering is stable when tasks are run again.
    numbered = sequences.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = numbered.select(
        "sequence_id",
        "members",
        F.expr("transform(sequence(1, size(members)), i -> aggregate(slice(members, 1, i - 1), 0L, (a, m) -> a + m.length))").alias("offsets"),
    )
    rows = placed.select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("m"))
    return rows.select("m.members.doc_id", "m.members.piece", "m.members.start", "m.members.length", "m.members.ids_crc32", "sequence_id", F.col("m.offsets").alias("offset"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
