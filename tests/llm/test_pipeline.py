import corpus_pipeline as pipeline

from engram.llm import line_dedup, ngram_join

from ..oracle import assert_same
from .cases import documents


def test_stages_keep_the_columns_and_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            left = ngram_join.join_similar(docs.select("doc_id", "text"))
            assert left.filter("n_links > 0").count() == 0
    assert docs.select("doc_id").distinct().count() <= n


def test_line_stage_matches_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = pipeline.line_passages(spark, docs, data).select("doc_id", "text", "n_chars")
    word = "[^\\x20\\x09-\\x0D]"
    sql = f"WITH {line_dedup.dedup_sql()} SELECT doc_id, text, length(text) AS n_chars FROM deduped WHERE n_removed = 0 OR regexp_matches(text, '{word}')"
    assert assert_same(out, sql, data)


def test_stages_with_awkward_rows(spark, data):
    docs = documents(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= 14, name
        assert stage(spark, docs.limit(0), data).count() == 0
    near = pipeline.near_duplicates(spark, docs, data)
    kept = [r["doc_id"] for r in near.collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept and None in kept


def test_near_duplicate_stage_with_equal_or_no_ids(spark, data):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " more"), (2, c), (None, b), (None, b), (None, a), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pipeline.near_duplicates(spark, docs, data).collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, docs.filter(f"text = '{c}' or text is null").collect() + docs.limit(1).collect() + [r for r in docs.collect() if r["doc_id"] is None and r["text"] == b][:1]))


def test_run(spark, data):
    out = pipeline.run(spark, data)
    assert out.count() > 0 and out.filter("length > 2048 or offset < 0").count() == 0
