"""The canonical sink writes the columns that its SQL names, and an empty text as an empty text."""

import hashlib
import json

from pyspark.sql import functions as F

from curalis import registry

SF = "/root/testdata/sf0.001"


def test_columns_that_the_sql_does_not_name_are_left_out(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d.limit(20).withColumn("text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))).withColumn("added", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).drop("added").collect()
    want = "".join(json.dumps(r.asDict(), sort_keys=True, separators=(",", ":")) + "\n" for r in sorted(rows, key=lambda r: r.doc_id)).encode()
    got = registry.queries()["s010_canonical_sink"](spark, str(tmp_path)).collect()
    assert [(r.name, r.bytes, r.records, r.sha256) for r in got] == [("part-000000.jsonl", len(want), 20, hashlib.sha256(want).hexdigest())]
