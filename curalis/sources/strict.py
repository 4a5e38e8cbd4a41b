"""Strict readers of JSON: lines, arrays, registries and manifests, with limits that are added up before anything is parsed.

Strict is: valid UTF-8, one JSON value and nothing behind it, no NaN or Infinity, and where `unique` is asked no object that names a key twice, at any depth. All checks are column
expressions over the text; sizes come from the file listing and record counts from one pass over line ends. Readers of records fail with the first fault; readers of
manifests give a row with a limitation for each file that is unusable.
"""

from __future__ import annotations

import os
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.functions.columns import is_sha256

# fixed values: bounds of record files, of case files and of manifests
MAX_FILES = 128
MAX_FILE_BYTES = 256 * 1024 * 1024
MAX_TOTAL_BYTES = 1024 * 1024 * 1024
MAX_RECORDS = 200_000
MAX_CASE_BYTES = 64 * 1024 * 1024
MAX_MANIFEST_BYTES = 1024 * 1024
# fixed values: names of the manifests and how their limitations begin
MANIFESTS = {"experiment-manifest.json": "EXPERIMENT_MANIFEST", "relationship-manifest.json": "RELATIONSHIP_MANIFEST", "document-manifest.json": "DOCUMENT_MANIFEST"}
_SPACE = r"[ \t\n\r]*"


def _kept(text: Column, unique: bool) -> Column:
    """text where it holds one strict JSON value, else null. A value is whole if it still reads as the member of an object around it."""
    around = F.concat(F.lit('{"a":'), text, F.lit(',"b":0}'))
    if unique:
        ok = F.try_variant_get(F.try_parse_json(around), "$.b", "int") == 0
    else:
        strict = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
        ok = F.from_json(around, "map<string,string>", strict)["b"] == "0"
    return F.when(F.is_valid_utf8(text) & F.coalesce(ok, F.lit(False)), text)


def strict_object(text: Column, unique: bool = False) -> Column:
    """text where it is one strict JSON object, else null."""
    return F.when(text.rlike(rf"^{_SPACE}\{{"), _kept(text, unique))


def strict_array(text: Column, unique: bool = False) -> Column:
    return F.when(text.rlike(rf"^{_SPACE}\["), _kept(text, unique))


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, length) of the regular files of a folder or a file, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "length")


def _fail_if(wrong: Column, message: Column) -> Column:
    return F.when(wrong, F.raise_error(message))


def read_jsonl(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl", unique: bool = False, max_files: int = MAX_FILES, max_file: int = MAX_FILE_BYTES, max_total: int = MAX_TOTAL_BYTES, max_records: int = MAX_RECORDS) -> DataFrame:
    """Records of JSON lines files with `file` (the name) beside the columns of schema. Too many or too large files and too many lines raise ValueError before a line
    is parsed; a line that is no strict object fails the job that reads it. Empty lines are no records but faults; an empty file has none and is not counted."""
    told = _files(spark, path, glob).agg(F.count("*").alias("n"), F.max("length").alias("most"), F.sum("length").alias("total")).first()
    if told.n > max_files:
        raise ValueError(f"{told.n} files, more than {max_files}")
    if (told.most or 0) > max_file:
        raise ValueError(f"a file of {told.most} bytes exceeds the file byte limit")
    if (told.total or 0) > max_total:
        raise ValueError("the files exceed the total byte limit")
    lines = spark.read.option("pathGlobFilter", glob).text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    most = lines.groupBy("file").count().agg(F.max("count").alias("n")).first().n or 0
    if most > max_records:
        raise ValueError(f"a file of {most} lines exceeds the record limit")
    fault = _fail_if(strict_object(F.col("value"), unique).isNull(), F.concat("file", F.lit(" holds a line that is no strict UTF-8 JSON object")))
    parsed = F.from_json(F.coalesce(fault.cast("string"), F.col("value")), schema, {"mode": "FAILFAST"})
    return lines.select("file", parsed.alias("r")).select("file", "r.*")


def _case_text(spark: SparkSession, path: str, limit: int) -> Column | DataFrame:
    size = _files(spark, path, "*").agg(F.max("length").alias("n"), F.count("*").alias("k")).first()
    if not size.k:
        raise ValueError(f"{path} must be a regular file")
    if size.n > limit:
        raise ValueError(f"{path} exceeds the file limit of {limit} bytes")
    return spark.read.text(path, wholetext=True)


def read_array(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None, unique: bool = False, limit: int = MAX_CASE_BYTES) -> DataFrame:
    """(pos, columns of schema) of the objects of a JSON array. keys: the only and all names each object must have. Anything else fails the job that reads it."""
    text = _case_text(spark, path, limit)
    whole = F.coalesce(_fail_if(strict_array(F.col("value"), unique).isNull(), F.lit(f"{path} must contain a JSON array")).cast("string"), F.col("value"))
    rows = text.select(F.posexplode(F.from_json(whole, "array<string>")).alias("pos", "x"))
    names = F.json_object_keys("x")
    fault = _fail_if(names.isNull(), F.lit(f"{path} must contain only JSON objects"))
    if keys is not None:
        fault = F.coalesce(fault, _fail_if(F.array_sort(names) != F.array(*map(F.lit, sorted(keys))), F.lit(f"{path} holds an object with other keys")))
    parsed = F.from_json(F.coalesce(fault.cast("string"), F.col("x")), schema, {"mode": "FAILFAST"})
    return rows.select("pos", parsed.alias("r")).select("pos", "r.*")


def read_registry(spark: SparkSession, path: str, limit: int = MAX_CASE_BYTES) -> DataFrame:
    """(reviewer_id, provenance_hash) of a JSON object of names and sha256 values; anything else fails."""
    text = _case_text(spark, path, limit)
    whole = F.coalesce(_fail_if(strict_object(F.col("value")).isNull(), F.lit(f"{path} must contain a JSON object")).cast("string"), F.col("value"))
    rows = text.select(F.explode(F.from_json(whole, "map<string,string>")).alias("reviewer_id", "h"))
    fault = _fail_if((F.col("reviewer_id") == "") | ~is_sha256(F.col("h")), F.lit("reviewer registry must map nonempty reviewer IDs to sha256 hashes"))
    return rows.select("reviewer_id", F.coalesce(fault.cast("string"), F.col("h")).alias("provenance_hash"))


def _named_files(spark: SparkSession, root: str, names: list[str], limit: int) -> DataFrame:
    """(path below root, length, content where that is at most limit) of the files of these names. Below a folder of this machine or one mounted alike on all, tasks list the folders of the first two
    levels and then walk what is below these, so that the driver holds no names; elsewhere Spark's reader lists them. Hidden names are left out as Spark leaves them out."""
    base = root.removeprefix("file://").removeprefix("file:")
    if ":" in base.split("/", 1)[0]:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
        rel = F.element_at(F.split("path", (root.rstrip("/") + "/").replace("\\", "\\\\"), 2), -1).alias("path")
        none = F.lit(None).cast("binary").alias("content")
        return whole.filter(F.col("length") <= limit).select(rel, "length", "content").unionByName(whole.filter(F.col("length") > limit).select(rel, "length", none))

    def listed(folder: bytes):
        with os.scandir(os.path.join(os.fsencode(base), folder)) as entries:
            for e in entries:
                hidden = e.name.startswith(b".") or e.name.startswith(b"_") and b"=" not in e.name or e.name.endswith(b"._COPYING_")
                path = folder + b"/" + e.name if folder else e.name
                if not hidden and e.is_dir():
                    yield path, True
                elif not hidden and os.fsdecode(e.name) in names and e.is_file():
                    yield path, False

    def level(batches):
        for b in batches:
            some = []
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in listed(path) if folder else [(path, False)]:
                    some.append(x)
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.binary()), pa.array([x[1] for x in some], pa.bool_())], names=["path", "folder"])
                        some = []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.binary()), pa.array([x[1] for x in some], pa.bool_())], names=["path", "folder"])

    def files(path: bytes, folder: bool):
        stack = [(path, folder)]
        while stack:
            path, folder = stack.pop()
            if folder:
                stack += listed(path)
            else:
                yield path

    def read(batches):
        for b in batches:
            rows, size = [], 0
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in files(path, folder):
                    with open(os.path.join(os.fsencode(base), p), "rb") as f:
                        n = os.fstat(f.fileno()).st_size
                        rows.append((p.decode("utf-8", "replace"), n, f.read() if n <= limit else None))
                    size += min(n, limit)
                    if len(rows) == 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])
                        rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    tasks = 4 * spark.sparkContext.defaultParallelism
    d = spark.createDataFrame([(b"", True)], "path binary, folder boolean")
    for _ in range(2):
        d = d.mapInArrow(level, "path binary, folder boolean").repartition(tasks)
    return d.mapInArrow(read, "path string, length long, content binary")


def read_manifests(spark: SparkSession, root: str, names: dict[str, str] = MANIFESTS, limit: int = MAX_MANIFEST_BYTES, tree: DataFrame | None = None) -> DataFrame:
    """(path, name, json, limitation) of every manifest below root: its text, or why there is none.

    Files above the limit are not read. tree: rows (path, object_type) of the same root; a manifest's name on anything but a regular file is unavailable."""
    f = _named_files(spark, root, list(names), limit)
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    f = f.select("path", (F.col("length") > limit).alias("large"), text.alias("t"))
    kept = F.when(F.col("t").rlike(rf"^{_SPACE}\{{"), F.when(F.from_json(F.concat(F.lit('{"a":'), "t", F.lit(',"b":0}')), "map<string,string>", {"allowSingleQuotes": "false"})["b"] == "0", F.col("t")))
    found = f.select("path", "large", kept.alias("json")).select("path", "json", F.when(F.col("large"), "SIZE_LIMIT").when(F.col("json").isNull(), "MALFORMED").alias("why"))
    if tree is not None:
        found = found.unionByName(tree.filter(F.element_at(F.split("path", "/"), -1).isin(list(names)) & (F.col("object_type") != "REGULAR_FILE")).select("path", F.lit(None).cast("string").alias("json"), F.lit("UNAVAILABLE").alias("why")))
    name = F.element_at(F.split("path", "/"), -1)
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), name)
    return found.select("path", name.alias("name"), "json", F.when(F.col("why").isNotNull(), F.concat(begin, F.lit("_"), "why")).alias("limitation"))
