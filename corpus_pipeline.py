"""A pipeline that turns documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and the documents that the stage before it kept, and returns a DataFrame. All but the last return
the columns of documents, whatever further ones there are; their decisions take effect. Every stage gives an empty result for an empty
table and reads texts of any length whole; what it does with nulls, empty texts, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontaminate, langid, line_dedup, ngram_join, packing
from engram.llm.common import bounded, cut, matched, read, written

#: A text is of no learned language when less than this share of its n-grams is.
LEAST_COVERAGE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that have no letter (null and empty ones too), and those of whose n-grams less than LEAST_COVERAGE belong to the
    predicted language. Equal texts fare equally, whatever their ids; a text at the bound stays; without any labelled language all rows do."""
    known = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    if not known.langs:  # nothing to judge by
        return docs
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(langid.keep_language(known, LEAST_COVERAGE, docs.columns.index("text")), rows.schema).select("row.*")


def line_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of passages of three lines that occur earlier, by id and place; a document of which nothing but blanks is left
    goes. Null texts and texts without words stay as they are; rows of equal id and text are one document, and fare equally."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("all")))
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(line_dedup.HAS_WORD))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col(f"all.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the smallest id, of equal ids the text with the smallest key, of
    equal rows any; rows without an id come last. Texts without words, null ones too, are in no class and stay."""
    joined = ngram_join.join_similar(docs.select("doc_id", "text")).filter("class is not null")
    texts = joined.groupBy("class", F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.count("*").alias("n"))
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "_t1", "_t2")
    several = texts.groupBy("class").agg(F.sum("n").alias("c"), F.min(place).alias("first")).filter("c > 1").drop("c")
    texts = cut(texts.join(bounded(cut(several)), "class").select("_id", "_t1", "_t2", "n", place.eqNullSafe(F.col("first")).alias("stays")))
    gone, again = texts.filter("not stays").drop("n", "stays"), texts.filter("stays and n > 1").drop("n", "stays")
    # Most documents stay as they are: only those that go, and those that come again as they are, are looked up.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), *ngram_join.text_key(F.col("text")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    rows = matched(rows, gone, same, "left_anti")
    once = matched(rows, again, same, "left_semi").dropDuplicates(["id", "t1", "t2"])
    return matched(rows, again, same, "left_anti").select("row.*").unionByName(once.select("row.*"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold four fifths or more of the shingles of a benchmark item. Null and empty texts hold none and stay, as
    do all rows when there are no items; equal texts fare equally."""
    return decontaminate.without_contained(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `pack_documents`: every document, null and empty texts as their end token, repeated rows once each."""
    return packing.pack_documents(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [
    ("language_id", language),
    ("line_dedup", line_passages),
    ("near_duplicates", near_duplicates),
    ("decontamination", contamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each but the last is written as Parquet and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = before = written(stage(spark, docs, sf_dir), before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising and packing are not expressible in SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None
