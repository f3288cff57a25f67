from pyspark.sql import functions as F

from engram.runtime import materialized, settled, spread


def test_settled(spark):
    rows = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("v"), F.lit(None).cast("string").alias("none"))
    for most in (10, 100, 1000):
        found, empty = settled(rows, most)
        assert not empty and found.dtypes == rows.dtypes and sorted(r["id"] for r in found.collect()) == list(range(100))
    assert settled(rows.limit(0))[1] and settled(rows.limit(0))[0].count() == 0


def test_materialized_is_computed_once(spark):
    drawn = materialized(spark.range(50).withColumn("x", F.expr("uuid()")))
    assert drawn.collect() == drawn.collect()


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    shuffled = spark.range(10).groupBy("id").count()
    assert spread(shuffled) is shuffled
