"""Language identification with a bit-sliced Bloom filter of character n-grams.

Each slot of the filter holds one bit per language, so that the AND of an n-gram's slots
is the set of all languages that contain it. A text's n-grams are counted per language
(popcounts per bit), the counts are corrected for each language's false-positive rate, and
the language with the most n-grams left wins.

Learning takes a bounded sample of labelled documents: at most `sample` ids of each language, chosen by a hash of the id, so that a rare
language is learned from all it has. At most `max_grams` n-grams a language are kept. The filter that
tasks receive holds 2^bits bits a language, in tables of 64 languages or fewer: 8 MB for each 64 languages by default.

Edge cases: null, empty and letterless texts are `und` with score 0; a text none of whose
n-grams is known gets the language most frequent in the sample, with score 0; equal counts go to the
alphabetically first language; no labelled row at all makes every text `und`. Repeated rows and rows without an id
are judged each; rows without an id are not learned from. Texts of any length are read whole, in slices that end between
words; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, read
from .shingles import pieces, tidy

SLICE = re.compile(r".{1,400000}\S*", re.S)
GRAM_SIZES = (3, 4)
#: Odd multipliers for the n-gram hash and the probes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def slices(texts, most: int = 500_000):
    """Groups of (row numbers, lower-cased slices), each of about `most` characters at most."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in SLICE.findall((text or "").lower()) if len(text or "") > 400_000 else ((text or "").lower(),):
            rows.append(row)
            parts.append(part)
            size += len(part) + 1
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def grams(parts: list[str], is_letter: np.ndarray):
    """Hashes of the n-grams of each part, and the index of each part's first; characters other than letters bound words.

    An n-gram has letters only, but for one bound at either end. Returns (n-grams, starts, letters per part).
    """
    code = np.frombuffer(("\n" + "\n".join(parts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
    letter = is_letter[code]
    n_letters = np.add.reduceat(letter.astype(np.int64), starts)
    code = np.where(letter, code, 0).astype(np.uint64)
    found, places = [], []
    for n in GRAM_SIZES:
        size = len(code) - n + 1
        inner, h = letter[1 : 1 + size], code[:size] * MIX[0]
        for k in range(1, n):
            h = h + code[k : k + size] * MIX[k]
            if 1 < k < n - 1:
                inner = inner & letter[k : k + size]
        at = np.flatnonzero(inner)
        h = h[at] + np.uint64(n)
        found.append((h ^ (h >> np.uint64(29))) * MIX[4])
        places.append(np.searchsorted(at + 1, starts))
    return found, places, n_letters


def positions(h: np.ndarray, bits: int, probes: int):
    return [((h * MIX[k]) >> np.uint64(64 - bits)).astype(np.int64) for k in range(probes)]


def count_grams():
    """mapInArrow: (lang, text) to counts of n-grams per language."""

    def run(batches):
        is_letter = letters()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                texts = [t for x, t in zip(langs, batch.column(1).to_pylist()) if x == lang]
                for _, parts in slices(texts, 2_000_000):
                    found, _, _ = grams(parts, is_letter)
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return tidy(run)


#: Languages in one table of the filter.
WIDTH = 64


class Filter:
    """Bit-sliced Bloom filter: `tables[i][slot]` has bit l set when language 64 i + l has an n-gram there."""

    def __init__(self, langs: list[str], common: str | None, bits: int, probes: int):
        self.langs, self.common, self.bits, self.probes = langs, common, bits, probes
        widths = [min(WIDTH, len(langs) - k) for k in range(0, len(langs), WIDTH)]
        kinds = [np.uint8 if w <= 8 else np.uint16 if w <= 16 else np.uint32 if w <= 32 else np.uint64 for w in widths]
        self.tables = [np.zeros(1 << bits, kind) for kind in kinds]

    def add(self, lang: int, gram: np.ndarray):
        table = self.tables[lang // WIDTH]
        for at in positions(gram, self.bits, self.probes):
            table[at] |= table.dtype.type(1 << lang % WIDTH)

    def finish(self):
        fill = [np.mean(self.bit(self.tables[k // WIDTH], k)) for k in range(len(self.langs))]
        self.false = np.minimum(np.array(fill) ** self.probes, 0.999)
        return self

    @staticmethod
    def bit(mask: np.ndarray, lang: int) -> np.ndarray:
        return (mask >> mask.dtype.type(lang % WIDTH)) & mask.dtype.type(1)

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """Of each table the languages that have an n-gram."""
        first, *rest = positions(gram, self.bits, self.probes)
        found = []
        for table in self.tables:
            mask = table[first]
            for at in rest:
                mask &= table[at]
            found.append(mask)
        return found


def learn(labelled: DataFrame, sample: int = 2000, max_grams: int = 20_000, bits: int = 20, probes: int = 3, keep: float = 0.3, least: int = 3) -> Filter:
    """Learn from (doc_id, text, lang). An n-gram belongs to each language where it is at least `keep` times as frequent as where it is most frequent."""
    known = labelled.filter("lang is not null and text is not null and doc_id is not null")
    # By the share that a language needs of its rows, few more ids than wanted are left; then exactly those of the smallest hashes.
    shares = known.groupBy("lang").agg((F.lit(1.5 * sample + 50) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) <= F.col("share") * 1_000_000_007
    ids = known.select("lang", "doc_id").join(F.broadcast(shares), "lang").filter(drawn).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)), "doc_id")
    ids = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample).drop("place")
    counted = known.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", "text").mapInArrow(count_grams(), "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang")
    counted = counted.withColumn("total", F.sum("n").over(by_lang)).withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("n"), "gram")))
    rows = counted.filter((F.col("rank") <= max_grams) & (F.col("n") >= least)).select("lang", "gram", (F.col("n") / F.col("total")).alias("p"), "total").toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    number = {name: k for k, name in enumerate(names)}
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    gram, p, total = rows["gram"].to_numpy().view(np.uint64), rows["p"].to_numpy(), rows["total"].to_numpy()
    unique, at = np.unique(gram, return_inverse=True)
    most = np.zeros(len(unique))
    np.maximum.at(most, at, p)
    common = names[lang[np.argmax(total)]] if len(names) else None
    out = Filter(names, common, bits, probes)
    for k in range(len(names)):
        out.add(k, gram[(lang == k) & (p >= keep * most[at])])
    return out.finish()


def judged(filter_: Filter, texts: list[str | None], is_letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the predicted language, its share of the corrected counts, and its share of all n-grams."""
    n, langs = len(texts), len(filter_.langs)
    counts, total, n_letters = np.zeros((n, langs)), np.zeros(n), np.zeros(n, np.int64)
    for rows, parts in slices(texts):
        found, places, lettered = grams(parts, is_letter)
        np.add.at(n_letters, rows, lettered)
        for gram, starts in zip(found, places):
            ends = np.append(starts[1:], len(gram))
            np.add.at(total, rows, ends - starts)
            masks = filter_.masks(gram)
            for k in range(langs):
                sums = np.concatenate(([0], np.cumsum(filter_.bit(masks[k // WIDTH], k), dtype=np.int64)))
                np.add.at(counts[:, k], rows, sums[ends] - sums[starts])
    if not langs:
        return ["und"] * n, np.zeros(n), np.zeros(n)
    true = np.maximum(counts - total[:, None] * filter_.false, 0) / (1 - filter_.false)
    best, most, sums = true.argmax(1), true.max(1), true.sum(1)
    pred = [("und" if not k else filter_.langs[b] if m > 0 else filter_.common) for k, b, m in zip(n_letters, best, most)]
    share, cover = most / np.maximum(sums, 1e-9), np.minimum(most / np.maximum(total, 1), 1)
    return pred, np.where(n_letters > 0, share, 0.0), np.where(n_letters > 0, cover, 0.0)


def identify(filter_: Filter):
    """mapInArrow: (doc_id, held_out, text) to predictions."""

    def run(batches):
        is_letter = letters()
        for batch in batches:
            for a, b, texts in pieces(batch.column(2)):
                pred, share, cover = judged(filter_, texts, is_letter)
                own = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.record_batch([*own, pa.array(pred, pa.string()), pa.array(share), pa.array(cover)], ["doc_id", "held_out", "lang_pred", "score", "coverage"])

    return tidy(run)


def keep_language(filter_: Filter, least_coverage: float, text: int):
    """mapInArrow over rows in a struct, whose field number `text` is the text, to those with letters and enough n-grams of the predicted language."""

    def run(batches):
        is_letter = letters()
        for batch in batches:
            keep = []
            for _, _, texts in pieces(batch.column(0).flatten()[text]):
                pred, _, cover = judged(filter_, texts, is_letter)
                keep += [p != "und" and c >= least_coverage for p, c in zip(pred, cover)]
            yield pa.record_batch([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["row"])

    return tidy(run)


def predict_language(docs: DataFrame, filter_: Filter, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and coverage of every row of docs (doc_id, text)."""
    rows = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"), "text")
    return rows.mapInArrow(identify(filter_), "doc_id bigint, held_out boolean, lang_pred string, score double, coverage double")


def held_out() -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict_language(docs, learn(docs.filter(~held_out())), held_out())
