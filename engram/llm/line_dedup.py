"""Removal of line passages that occur earlier in the corpus.

A window is three consecutive lines that hold a word (`window` sets the number); a document of fewer lines has none. The hashes of
all windows are grouped over the whole corpus (partial aggregation, so a frequent window costs each task one row). Each window
but the first occurrence, by document id and position, covers its lines; covered positions of a document are merged and removed.
Windows that make up more than a thousandth of all are matched by a broadcast of their first places, of which there are
a thousand at most, so no task gets all occurrences of one. Everything runs as built-in column expressions.

With `enough` a window is cut short once its lines hold more words than that, so that long passages on one or two lines
are found as well; by default it isn't.

Edge cases: null texts stay null, texts without words stay as they are; lines without a word go with the last
line before them that has one; a window that overlaps its own first occurrence covers only what comes after that, so a
passage that repeats over itself keeps one whole window; rows of equal id and text count as one document, and all lose the same lines; of equal
ids the text with the smaller hash comes first; null ids come first; lines of any length and number are read whole; an empty table gives
an empty result; other columns pass through unchanged, whatever their names, but for n_lines and n_removed, which are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

HAS_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 3
#: Ranges of lines, of some 80 bytes with their document's key, up to which those to remove are broadcast (80 MB) and no text is shuffled;
#: beyond, texts are shuffled by document.
BROADCAST_RANGES = 1_000_000


def _key(df: DataFrame) -> list:
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.length("text").alias("_n")]


def line_windows(docs: DataFrame, window: int = WINDOW, enough: int | None = None) -> DataFrame:
    """Windows of docs (doc_id, text): document key, first and last line from 0, and a hash of 128 bits.

    The last line takes in the lines without words that follow it.
    """
    lines = docs.filter(F.col("text").rlike(HAS_WORD)).select(*_key(docs), F.split("text", "\n").alias("lines"))
    if enough is None:
        n_words = lambda x: x.rlike(HAS_WORD).cast("int")  # noqa: E731 - only whether there is one counts
    else:
        n_words = lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    # One struct per line with a word: its number, its words, 128 bits that stand for its text.
    of_line = lambda x, i: F.struct(i.alias("i"), n_words(x).alias("w"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"))
    full = F.filter(F.transform("lines", of_line), lambda s: s.w > 0)
    lines = lines.select("_id", "_h", "_n", F.size("lines").alias("n_lines"), full.alias("full"))
    lines = lines.filter(F.size("full") >= (window if enough is None else 1))
    at = lines.select("_id", "_h", "_n", "n_lines", F.explode(_runs("full", window)).alias("run"))
    # How many lines the window takes: `window`, or as few as hold more than `enough` words.
    take = F.when(F.size("run") >= window, F.lit(window))
    for k in range(window - 1, 0, -1) if enough is not None else ():
        long_ = (F.size("run") >= k) & (F.aggregate(F.slice("run", 1, k), F.lit(0), lambda a, x: a + x.w) > enough)
        take = F.when(long_, F.lit(k)).otherwise(take)
    at = at.select("_id", "_h", "_n", "n_lines", "run", take.alias("take")).filter("take is not null")
    taken = F.slice("run", F.lit(1), F.col("take"))
    hashed = [F.xxhash64(F.transform(taken, lambda s: s.h)).alias("h1"), F.xxhash64(F.transform(taken, lambda s: s.g)).alias("h2")]
    last = F.when(F.size("run") > F.col("take"), F.try_element_at("run", F.col("take") + 1).i - 1).otherwise(F.col("n_lines") - 1)
    return at.select("_id", "_h", "_n", F.element_at("run", 1).i.alias("a"), last.alias("b"), *hashed)


def _runs(full: str, window: int):
    """For each line with a word, it and the next `window` ones."""
    return F.transform(full, lambda x, i: F.slice(full, i + 1, F.lit(window + 1)))


def covered_lines(windows: DataFrame) -> DataFrame:
    """Document key and the line ranges of materialised windows that occur earlier."""
    place = F.struct("_id", "_h", "_n", "a", "b")
    first = cut(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1"))
    often = max(100, windows.count() // 1000)
    hot, rare = first.filter(F.col("c") > often).drop("c"), first.filter(F.col("c") <= often).drop("c")
    # At most a thousand windows are hot.
    rows = windows.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(rare, ["h1", "h2"])
    rows = rows.unionByName(windows.join(F.broadcast(hot), ["h1", "h2"])).filter(~place.eqNullSafe(F.col("first")))
    own = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_h") == F.col("first._h")) & (F.col("_n") == F.col("first._n"))
    rows = rows.withColumn("a", F.when(own, F.greatest("a", F.col("first.b") + 1)).otherwise(F.col("a"))).filter("a <= b")
    return rows.groupBy("_id", "_h", "_n").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, enough: int | None = None) -> DataFrame:
    """docs (doc_id, text, others) with covered lines removed from text, and n_lines and n_removed added."""
    windows = cut(line_windows(docs.select("doc_id", "text"), window, enough))
    covered = cut(covered_lines(windows))
    n = covered.agg(F.sum(F.size("ranges"))).first()[0] or 0
    covered = F.broadcast(covered) if n <= BROADCAST_RANGES else covered
    keys = [k.alias(f"_doc{i}") for i, k in enumerate((F.col("doc_id"), F.xxhash64("text"), F.length("text")))]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *keys)
    same = F.col("_doc0").eqNullSafe(F.col("_id")) & (F.col("_doc1") == F.col("_h")) & F.col("_doc2").eqNullSafe(F.col("_n"))
    joined = rows.join(covered, same, "left")
    lines = F.split("_row.text", "\n")
    gone = F.flatten(F.transform("ranges", lambda r: F.sequence(r.a, r.b)))
    joined = joined.select("_row", F.when(F.col("ranges").isNotNull(), gone).alias("gone"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"))
    joined = joined.select("_row", "n_lines", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), "gone")).alias("kept"), F.when(F.col("gone").isNotNull(), lines).alias("lines"))
    text = F.when(F.col("kept").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    removed = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept"))
    others = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*others, F.when(F.col("_row.text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).alias("n_lines"), removed.alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"), "text")


def dedup_sql(documents: str = "documents") -> str:
    """DuckDB: the common table expression `deduped` (doc_id, text, n_lines, n_removed) for unique, non-null ids."""
    return f"""
raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {documents}),
line AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM raw),
full_line AS (
  SELECT doc_id, i, x, lead(x, 1) OVER d AS x2, lead(x, 2) OVER d AS x3, lead(i, 2) OVER d AS i3, lead(i, 3) OVER d AS i4
  FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
win AS (
  SELECT f.doc_id, f.i AS a, coalesce(i4, n_all) - 1 AS b, x || chr(10) || x2 || chr(10) || x3 AS t
  FROM full_line f JOIN (SELECT doc_id, len(lines) AS n_all FROM raw) r USING (doc_id) WHERE i3 IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER o AS k, first_value(doc_id) OVER o AS first_doc, first_value(b) OVER o AS first_b
  FROM win WINDOW o AS (PARTITION BY t ORDER BY doc_id, a)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN first_doc = doc_id THEN greatest(a, first_b + 1) ELSE a END, b + 1)) AS i
  FROM ranked WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(g.i) AS n_removed, count(*) AS n_lines,
    coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
deduped AS (
  SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE k.text END AS text,
    coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
  FROM raw r LEFT JOIN kept k ON r.doc_id = k.doc_id)"""


OP5_SQL = f"WITH {dedup_sql()} SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5, text FROM deduped"
