"""Pairs of documents are made by many tasks, however large one topic is."""

from pyspark.sql import functions as F

from curalis.operators.relationships import PART, document_pairs


def test_pairs_of_one_topic_are_dealt_to_tasks(spark):
    n = 3 * PART
    none = F.lit(None).cast("string")
    d = spark.range(n).select(F.concat(F.lit("t"), F.col("id") % 1).alias("topic"), F.lpad(F.col("id").cast("string"), 6, "0").alias("path"), *[none.alias(c) for c in ("audience", "lifecycle", "role", "value", "status")], (F.col("id") % 2).cast("string").alias("claim"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = document_pairs(d).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("subtype") == "DO_NOT_MERGE").alias("no")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    pairs = n * (n - 1) // 2
    assert sum(r.n for r in got) == pairs and sum(r.no for r in got) == (n // 2) ** 2
    assert max(r.n for r in got) < 0.9 * pairs
