"""Directory trees as a table: `spark.read.format("tree").load(root)`.

Tasks each walk a subtree; the driver lists only as many directories as it takes to have enough of them. A row is an entry: nothing is read but names and what
lstat tells, links are not followed, special files are not opened. Each directory's row comes from the task that lists it, so that a directory too wide or too deep says so and
gives no children. The options prefix (how paths begin) and object_types (names with commas) reach the walk, which does not enter subtrees that cannot match. They are options,
not pushed filters, as Spark 4.1 keeps one set of pushed filters for a loaded table: of two uses of it with other filters, one would lose rows.

The root must be a folder that every executor sees at the same place. Order is the bytes of path_bytes; path shows bytes that are no UTF-8 as \\xNN.
Options: max_entries, max_depth, exclude (a name at the root that is not listed), slices (subtrees to have at least).
"""

from __future__ import annotations

import hashlib
import os
import stat
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, path_bytes binary, object_type string, mode int, size_bytes long, mtime_ns long, symlink_target_text string, warnings array<string>"
ARROW = pa.schema([("path", pa.string()), ("path_bytes", pa.binary()), ("object_type", pa.string()), ("mode", pa.int32()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("symlink_target_text", pa.string()), ("warnings", pa.list_(pa.string()))])
BATCH = 2000
# fixed values: bounds of a scan and what it says where it stops
MAX_ENTRIES = 50_000
MAX_DEPTH = 128
KINDS = ((stat.S_ISREG, "REGULAR_FILE"), (stat.S_ISDIR, "DIRECTORY"), (stat.S_ISLNK, "SYMLINK"))


def shown(raw: bytes) -> str:
    return raw.decode("utf-8", "backslashreplace")


class Subtree(InputPartition):
    """Directories below the root, walked to the end or (deep false) listed alone."""

    def __init__(self, dirs: list[tuple[bytes, int]], deep: bool):
        self.dirs, self.deep = dirs, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.fsencode(options["path"].removeprefix("file://").removeprefix("file:"))
        self.max_entries, self.max_depth = int(options.get("max_entries", MAX_ENTRIES)), int(options.get("max_depth", MAX_DEPTH))
        self.exclude, self.slices = os.fsencode(options.get("exclude", "")), int(options.get("slices", 64))
        self.prefix = options.get("prefix", "")
        self.kinds = set(options["object_types"].split(",")) if "object_types" in options else None

    def partitions(self):
        """Directories are listed here, the widest level first, until there are enough to walk in tasks of their own."""
        now, flat = [(b"", 0)], []
        while now and len(now) < self.slices:
            below = []
            for path, depth in now:
                flat.append((path, depth))
                below += [(p, depth + 1) for p, kind in self._children(path, depth) if kind == "DIRECTORY" and self._enters(p)]
            now = below
        few = max(1, len(flat) // self.slices)
        return [Subtree(flat[i : i + few], False) for i in range(0, len(flat), few)] + [Subtree([d], True) for d in now]

    def _enters(self, path: bytes) -> bool:
        p = shown(path)
        return self.prefix.startswith(p) or p.startswith(self.prefix)

    def _names(self, path: bytes) -> list[bytes] | None:
        """Names in a directory in the order of their bytes; None if there are more than allowed."""
        names = []
        with os.scandir(os.path.join(self.root, path)) as entries:
            for e in entries:
                if path or e.name != self.exclude:
                    names.append(e.name)
                if len(names) > self.max_entries:
                    return None
        return sorted(names)

    def _kind(self, path: bytes) -> tuple[str, os.stat_result | None, str | None]:
        try:
            s = os.lstat(os.path.join(self.root, path))
        except FileNotFoundError:
            return "UNKNOWN", None, "ARTIFACT_DISAPPEARED"
        except OSError:
            return "UNKNOWN", None, "ARTIFACT_UNREADABLE"
        kind = next((k for is_, k in KINDS if is_(s.st_mode)), "SPECIAL_FILE")
        return kind, s, "SPECIAL_FILE_NOT_READ" if kind == "SPECIAL_FILE" else None

    def _children(self, path: bytes, depth: int) -> Iterator[tuple[bytes, str]]:
        """(path, kind) of what a directory lists; nothing where it is too deep, too wide or cannot be read."""
        try:
            names = self._names(path) if depth < self.max_depth else None
        except OSError:
            return
        for n in names or ():
            p = path + b"/" + n if path else n
            yield p, self._kind(p)[0]

    def _row(self, path: bytes, kind: str, s: os.stat_result | None, warning: str | None) -> tuple:
        target = None
        if kind == "SYMLINK":
            try:
                target = shown(os.readlink(os.path.join(self.root, path)))
            except OSError:
                warning = "ARTIFACT_UNREADABLE"
        some = (None, None, None) if s is None else (s.st_mode, s.st_size, s.st_mtime_ns)
        return shown(path or b"."), path or b".", kind, *some, target, [warning] if warning else []

    def _rows(self, path: bytes, depth: int, deep: bool) -> Iterator[tuple]:
        """A directory's own row and those of what it lists, down to the end if deep; a stack, so that depth costs no frames."""
        stack = [(path, depth)]
        while stack:
            path, depth = stack.pop()
            kind, s, warning = self._kind(path)
            names = []
            if kind == "DIRECTORY" and depth >= self.max_depth:
                warning = "INVENTORY_DEPTH_LIMIT"
            elif kind == "DIRECTORY":
                try:
                    found = self._names(path)
                    names, warning = (found, None) if found is not None else ([], "DIRECTORY_ENTRY_LIMIT")
                except OSError:
                    warning = "ARTIFACT_UNREADABLE"
            yield self._row(path, kind, s, warning)
            for n in names:
                p = path + b"/" + n if path else n
                k, s, w = self._kind(p)
                if k != "DIRECTORY":
                    yield self._row(p, k, s, w)
                elif deep and self._enters(p):
                    stack.append((p, depth + 1))

    def rows(self, part: Subtree) -> Iterator[tuple]:
        for path, depth in part.dirs:
            for r in self._rows(path, depth, part.deep):
                if (self.kinds is None or r[2] in self.kinds) and r[0].startswith(self.prefix):
                    yield r

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        batch = []
        for r in self.rows(partition):
            batch.append(r)
            if len(batch) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), ARROW.types)], schema=ARROW)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), ARROW.types)], schema=ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Workers get the classes themselves, so that no executor needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TreeSource)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def hashed(files: DataFrame, root: str) -> DataFrame:
    """files with content_id: the hash of each regular file without a limitation, read in pieces by the tasks that hold the rows. A file that has changed its size since it was listed
    gets ARTIFACT_CHANGED_DURING_INVENTORY as its limitation, one that cannot be read ARTIFACT_UNREADABLE or ARTIFACT_DISAPPEARED. files must have path_bytes, size_bytes, object_type, limitation."""
    base = os.fsencode(root.removeprefix("file://").removeprefix("file:"))
    names = [f.name for f in files.schema]

    def digest(path: bytes, size: int) -> tuple[str | None, str | None]:
        h, n = hashlib.sha256(), 0
        try:
            with os.fdopen(os.open(os.path.join(base, path), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb", 0) as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
                    n += len(piece)
                    if n > size:
                        break
        except FileNotFoundError:
            return None, "ARTIFACT_DISAPPEARED"
        except OSError:
            return None, "ARTIFACT_UNREADABLE"
        return (None, "ARTIFACT_CHANGED_DURING_INVENTORY") if n != size else (f"sha256-file-v1:{h.hexdigest()}", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads = [k == "REGULAR_FILE" and w is None for k, w in zip(b.column("object_type").to_pylist(), b.column("limitation").to_pylist())]
            got = [digest(p, n) if r else (None, None) for r, p, n in zip(reads, b.column("path_bytes").to_pylist(), b.column("size_bytes").to_pylist())]
            why = [w if w is not None else g[1] for w, g in zip(b.column("limitation").to_pylist(), got)]
            columns = [pa.array(why, pa.string()) if n == "limitation" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[0] for g in got], pa.string())], [*names, "content_id"])

    from pyspark.sql.types import StringType, StructField, StructType

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content_id", StringType())]))


def scan(spark: SparkSession, root: str, max_file: int = 1 << 25, max_total: int = 1 << 30, **options) -> DataFrame:
    """The tree with content_id and limitation of every regular file, under a bound for one file and one for all in the order of their paths."""
    from curalis.operators.budgets import content_budgets
    from curalis.operators.duplicates import kept

    t = kept(read_tree(spark, root, **options)).withColumn("root", F.lit("."))
    files = content_budgets(t.filter("object_type = 'REGULAR_FILE'"), "root", "path_bytes", "size_bytes", F.lit(None).cast("string"), max_file, max_total).drop("content_id", "root")
    rest = t.filter("object_type <> 'REGULAR_FILE'").drop("root").withColumn("limitation", F.lit(None).cast("string")).withColumn("content_id", F.lit(None).cast("string"))
    return hashed(files, root).unionByName(rest)


def inventory_records(found: DataFrame, root: str, run_id: str, created_at: str, schema_version: str) -> DataFrame:
    """The 22 columns of an inventory record for each entry of scan(), numbered in the order of path bytes. root is the tree's name in identities; states of version control and pointers to large files are overlaid later."""
    from curalis.functions.columns import length_prefixed_hash
    from curalis.operators.duplicates import dense_ids

    n = dense_ids(found, ["path_bytes"], "artifact_id", f"art_{run_id}_", first=1)
    regular, none = F.col("object_type") == "REGULAR_FILE", F.lit(None)
    git = F.struct(F.lit(False).alias("ignored_included"), none.cast("string").alias("index_status"), *[none.cast("boolean").alias(c) for c in ("modified", "tracked", "untracked")])
    warnings = F.array_sort(F.array_distinct(F.array_compact(F.concat("warnings", F.array("limitation")))))
    return n.select(
        "artifact_id", "content_id", F.lit(created_at).alias("created_at"), F.coalesce(F.col("mode").bitwiseAND(0o111) != 0, F.lit(False)).alias("executable"), F.substring_index("content_id", ":", -1).alias("fingerprint"), F.substring_index("content_id", ":", 1).alias("fingerprint_scheme"),
        git.alias("git_state"), none.cast("string").alias("lineage_id"), F.lit("UNRESOLVED").alias("lineage_status"), none.cast("struct<oid:string,size_bytes:bigint>").alias("lfs_pointer"), length_prefixed_hash([F.lit(root), F.col("object_type"), F.col("path")]).alias("location_id"),
        F.col("mode").bitwiseAND(0o7777).alias("mode"), F.when(regular, F.col("mtime_ns")).alias("mtime_ns"), "object_type", F.when(F.col("content_id").isNotNull(), "ELIGIBLE").otherwise("NOT_APPLICABLE").alias("profile_eligibility"),
        F.when(F.col("path") == ".", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), "path")).alias("realpath"), F.col("path").alias("repository_relative_path"), F.lit(run_id).alias("run_id"), F.lit(schema_version).alias("schema_version"), F.when(regular, F.col("size_bytes")).alias("size_bytes"), "symlink_target_text", warnings.alias("warnings"))
