"""Readers and writers of record sets: strict JSON lines, manifests, file content, staged writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, most_records: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line or too many records fail."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if most_records is not None:
        if df.limit(most_records + 1).count() > most_records:
            raise ValueError(f"more than {most_records} records in {path}")
    return df


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON value a file, with a fixed schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Regular files under root: relative path, size, content hash and content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rel = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    return f.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.concat(F.lit("sha256-file-v1:"), F.sha2("content", 256)).alias("content_id"), "content")


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Written beside its place and renamed into it: readers see all of it or nothing; an existing place fails."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").format(fmt).save(stage)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), target):
        raise OSError(f"could not publish {path}")


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose payload is there with the declared content."""
    return manifest.join(files.select("path", F.col("content_id").alias("_c")), "path", "left").withColumn("status", F.when(F.col("_c").isNull(), "MISSING").when(F.col("_c") != F.col("content_id"), "CHANGED").otherwise("VERIFIED")).drop("_c")
