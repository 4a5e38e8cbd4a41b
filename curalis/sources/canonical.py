"""Canonical JSON lines, created once: the same bytes for any partitioning, a digest for each part, all or nothing.

Rows are ordered by the keys given and then by their own line, so that ties do not matter. They are numbered densely over all tasks, and every PART_ROWS of them are one part file; a
part is written by one task, whatever other parts that task writes. Writing takes three steps: the target folder is created, which fails if anybody else has created it and so
is the claim to it; tasks write parts under names of their own attempt into a folder in it and report names, digests and sizes; the commit gives the reported
attempts their final names, removes all else, and writes the manifest last. A folder without a manifest is no output. A failed job removes the folder; what a killed
task has left goes with either. The folder must be one that all executors see at the same place.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from curalis.functions.columns import json_object, json_string
from curalis.functions.nested import canonical_json
from curalis.operators.duplicates import dense_ids, kept
from curalis.sources.records import verified

PART_ROWS = 200_000
MANIFEST = "manifest.json"
STAGE = ".stage"


class Parts(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str, str, int, int]]):
        self.parts = parts


class LinesWriter(DataSourceArrowWriter):
    """Rows (part, line) that come with each part whole and in order."""

    def __init__(self, path: str, end: str):
        self.path, self.end = path, end.encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        done, now, f, digest, size, rows = [], None, None, None, 0, 0

        def close():
            f.flush()
            os.fsync(f.fileno())
            f.close()
            done.append((f"part-{now:06d}.jsonl", name, digest.hexdigest(), size, rows))

        try:
            for b in iterator:
                for part, line in zip(b.column("part").to_pylist(), b.column("line").to_pylist()):
                    if part != now:
                        if f is not None:
                            close()
                        now, name, digest, size, rows = part, f"{part:06d}-{uuid.uuid4().hex}", hashlib.sha256(), 0, 0
                        f = open(os.path.join(self.path, STAGE, name), "xb")
                    data = line.encode() + self.end
                    f.write(data)
                    digest.update(data)
                    size, rows = size + len(data), rows + 1
            if f is not None:
                close()
        except BaseException:
            if f is not None:
                f.close()
            raise
        return Parts(done)

    def commit(self, messages) -> None:
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        names = [p[0] for p in parts]
        if len(set(names)) != len(names):
            raise ValueError("a part came from two tasks")
        for name, attempt, *_ in parts:
            os.rename(os.path.join(self.path, STAGE, attempt), os.path.join(self.path, name))
        shutil.rmtree(os.path.join(self.path, STAGE))
        whole = {"files": [{"bytes": size, "name": name, "records": rows, "sha256": digest} for name, _, digest, size, rows in parts], "records": sum(p[4] for p in parts)}
        with open(os.path.join(self.path, f".{MANIFEST}"), "x") as f:
            f.write(json.dumps(whole, sort_keys=True, separators=(",", ":")) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(os.path.join(self.path, f".{MANIFEST}"), os.path.join(self.path, MANIFEST))

    def abort(self, messages) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


class LinesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "canonical_lines"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], self.options.get("end", "\n"))


def _plain(value: Column, kind: str) -> Column | None:
    """Canonical JSON of a string, a whole number or a truth value; none for other types, whose text takes parsing."""
    return json_string(value) if kind == "string" else value.cast("string") if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else None


def write_canonical(df: DataFrame, path: str, keys: list[str], part_rows: int = PART_ROWS) -> dict:
    """df as canonical JSON lines in the folder `path`, in the order of keys; the manifest. Fails with FileExistsError where there is anything already."""
    path = path.removeprefix("file://").removeprefix("file:")
    df = df.withColumn("_row", F.monotonically_increasing_id()).repartition("_row").drop("_row")  # a file of one block is read by one task
    order = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    values = {c: _plain(F.col(f"`{c}`"), kind) for c, kind in df.dtypes}
    if all(v is not None for v in values.values()):
        lines = df.select(*order, json_object([(json.dumps(c)[1:-1], v) for c, v in sorted(values.items())]).alias("line"))
    else:
        lines = df.select(*order, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("_j"))
        lines = canonical_json(lines, "_j", "line").drop("_j")
    lines = kept(lines)  # the sort by ranges reads them twice
    return _publish(lines, path, [f"_k{i}" for i in range(len(keys))], part_rows, "\n")


def _publish(lines: DataFrame, path: str, keys: list[str], part_rows: int, end: str) -> dict:
    """lines(keys, line) as parts of so many rows each, every line with `end` behind it; the manifest."""
    spark = lines.sparkSession
    numbered = dense_ids(lines, [*keys, "line"], "n", width=18)
    part = F.floor(F.col("n").cast("long") / part_rows).cast("int")
    out = numbered.select(part.alias("part"), "n", "line").repartition("part").sortWithinPartitions("part", "n").select("part", "line")
    os.mkdir(path)
    try:
        os.mkdir(os.path.join(path, STAGE))
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        spark.dataSource.register(LinesSink)
        out.write.format("canonical_lines").option("end", end).mode("append").save(path)
    except BaseException:
        shutil.rmtree(path, ignore_errors=True)
        raise
    with open(os.path.join(path, MANIFEST)) as f:
        return json.load(f)


def write_graph(entities: DataFrame, path: str, context, descriptor: dict, root: dict, part_rows: int = PART_ROWS) -> dict:
    """One linked-graph document as canonical JSON, in parts whose bytes one after the other are the document; the manifest.

    entities(id, json): ids are distinct, json is canonical. They follow the descriptor and the root in the order of their ids, and the root's hasPart names them all: it is made of rows
    like they are, so that no row and no process but the files holds the document."""
    path = path.removeprefix("file://").removeprefix("file:")
    dumps = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    before, after = ({k: v for k, v in root.items() if (k < "hasPart") == low} for low in (True, False))
    head = f'{{"@context":{dumps(context)},"@graph":[{dumps(descriptor)},{dumps(before)[:-1]}{"," if before else ""}"hasPart":['
    tail = "]" + ("," + dumps(after)[1:] if after else "}")
    entities = kept(entities)  # used for the first id, twice for the lines, and to find the ranges that these are sorted by
    first = entities.agg(F.min("id")).first()[0]
    fixed = entities.sparkSession.createDataFrame([(0, "", head), (2, "", tail), (4, "", "]}")], "s int, k string, line string")
    comma = F.when(F.col("id") == F.lit(first), "").otherwise(",")
    names = entities.select(F.lit(1).alias("s"), F.col("id").alias("k"), F.concat(comma, F.lit('{"@id":'), json_string(F.col("id")), F.lit("}")).alias("line"))
    bodies = entities.select(F.lit(3).alias("s"), F.col("id").alias("k"), F.concat(F.lit(","), "json").alias("line"))
    return _publish(fixed.unionByName(names).unionByName(bodies), path, ["s", "k"], part_rows, "")


def join_parts(path: str, target: str) -> None:
    """The parts of a folder one after the other as one file, which must not exist; copied by the operating system, piece by piece."""
    path = path.removeprefix("file://").removeprefix("file:")
    with open(os.path.join(path, MANIFEST)) as f:
        names = [x["name"] for x in json.load(f)["files"]]
    with open(target, "xb") as out:
        for n in names:
            with open(os.path.join(path, n), "rb") as part:
                shutil.copyfileobj(part, out)


def read_canonical(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of a folder that write_canonical() wrote, after each part's digest has been found to be the manifest's."""
    path = path.removeprefix("file://").removeprefix("file:")
    files = spark.read.json(os.path.join(path, MANIFEST), schema="files array<struct<bytes:long,name:string,records:long,sha256:string>>").select(F.explode("files").alias("f")).select(F.col("f.name").alias("path"), F.col("f.sha256").alias("content_id"))
    have = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.jsonl").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("content_id"))
    wrong = verified(files, have).filter("status <> 'VERIFIED'").orderBy("path").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].path}: {wrong[0].status}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(os.path.join(path, "part-*.jsonl"))
