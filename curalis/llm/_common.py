"""Shared pieces of the text operators: durable tables, bounded filters, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_LOG2 = 25
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1000
ARROW_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 8 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29 = np.uint64(31), np.uint64(29)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers anywhere can import it. Every operator calls it.

    Whole texts pass to Python in batches of ARROW_ROWS rows and ARROW_BYTES bytes, unless the session asks for fewer: a batch of
    Spark's 10,000 rows is held several times over by both sides of each task. The two settings stay for the session, as
    the operators' results are lazy and read them when they run.
    """
    sc = spark.sparkContext
    for name, most in ((ARROW, ARROW_ROWS), (ARROW_SIZE, ARROW_BYTES)):
        got = spark.conf.get(name, None)
        if got is None or not got.isdigit() or not 0 < int(got) <= most:
            spark.conf.set(name, str(most))
    if getattr(sc, "_curalis_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="curalis-ship-"), "curalis.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._curalis_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on one machine (tests), and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_curalis_dir", None)
        if found is None:
            found = sc._curalis_dir = "file://" + tempfile.mkdtemp(prefix="curalis-shared-")
    return found.rstrip("/")


_stores: list[Callable[[], None]] = []
_owner: str | None = None


def store(clear: Callable[[], None]) -> None:
    """Name a function that empties a worker's store of words, scores or ids."""
    _stores.append(clear)


def enter(owner: str) -> None:
    """A task of an operator begins: what the worker holds of another operator goes back to the system."""
    global _owner
    if _owner not in (None, owner):
        for clear in _stores:
            clear()
        gc.collect()
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own counsel
            pass
    _owner = owner


_written: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(keep: str | None = None) -> None:
    """Delete the intermediate tables that this process wrote, but for the one at `keep`."""
    some = [x for x in _written if x[1] != keep]
    _written[:] = [x for x in _written if x[1] == keep]
    for spark, path in some:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the folder goes with its owner
            pass


atexit.register(drop_tables)


def materialize(df: DataFrame, label: str, alone: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends at files every executor can read.

    alone: the tables written before are no longer needed, and go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/curalis-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    if alone:
        drop_tables(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._curalis_path = path
    return got


def release(df: DataFrame | None) -> None:
    """Delete a table that materialize() gave and that nothing reads any more."""
    path = getattr(df, "_curalis_path", None)
    if path:
        _written[:] = [x for x in _written if x[1] != path]
        _remove(df.sparkSession, path)


HEAVY = 1000  # a key of more than one row in so many is broadcast: there are fewer than so many of them


def join_by_size(df: DataFrame, key: str, right: DataFrame, rows: str) -> DataFrame:
    """df left join right by key, where right has one row a key and in `rows` how many rows of df have it.

    Keys of more than a thousandth of all rows are fewer than a thousand whatever the data, and are broadcast; the others meet in a shuffle in which no key
    is large. Rows with a null key meet nothing and are not shuffled.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy, light = right.filter(F.col(rows) * HEAVY > total), right.filter(F.col(rows) * HEAVY <= total)
    new = [c for c in right.columns if c != key]
    a = df.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    b = a.filter(F.col("_heavy").isNull() & F.col(key).isNotNull()).drop("_heavy", *new).join(light, key, "left")
    return a.filter(F.col("_heavy").isNotNull() | F.col(key).isNull()).drop("_heavy").unionByName(b)


@dataclass
class Bits:
    """Hashed membership bits of a table's keys, as rows (_w, _m); rows is None where the keys are too many for a filter of bounded size."""

    rows: DataFrame | None
    log2: int = 0


def bitmap(keys: DataFrame, key: str) -> Bits:
    """A filter of eight bits a key or more, of at most 2**BITMAP_LOG2 bits (8 MB of rows at 25), for keys of a written table.

    Of more keys than a quarter of that no filter is made: it would let nearly all rows through.
    """
    n = keys.count()
    if 4 * n > 1 << BITMAP_LOG2:
        return Bits(None)
    log2 = min(BITMAP_LOG2, max(16, (8 * n).bit_length()))
    x = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << log2))
    return Bits(keys.select(x.alias("_x")).groupBy(F.shiftright("_x", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_x & 63 as int)))").alias("_m")), log2)


def split_by(df: DataFrame, key, bits: Bits) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the bitmap's keys, rows whose key surely is not). Broadcasts the bounded bitmap; without one all rows may be."""
    if bits.rows is None:
        return df, df.limit(0)
    x = F.pmod(F.xxhash64(key), F.lit(1 << bits.log2))
    j = df.withColumn("_w", F.shiftright(x, 6)).withColumn("_b", x.bitwiseAND(F.lit(63)).cast("int"))
    j = j.join(F.broadcast(bits.rows), "_w", "left")
    bit = F.coalesce(F.expr("shiftright(_m, _b) & 1"), F.lit(0)) == 1
    return j.filter(bit).drop("_w", "_b", "_m"), j.filter(~bit).drop("_w", "_b", "_m")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (wraps around)."""
    x = x * _M1
    x = (x ^ (x >> _S31)) * _M2
    return x ^ (x >> _S29)


class Words(dict):
    """word -> 64-bit hash of its normalised form, computed once per worker; 0 means 'no word'. Bounded: it empties when full."""

    def __init__(self, normal, limit: int = 100_000):
        super().__init__()
        self.normal, self.limit = normal, limit

    def __missing__(self, w):
        if len(self) >= self.limit:
            self.clear()
        n = self.normal(w)
        h = self[w] = (xxhash.xxh3_64_intdigest(n) or 1) if n else 0
        return h


_JUNK = re.compile(r"[\W_]+")


def plain(w: str) -> bytes:
    """Lower case, letters and digits only."""
    return (w.lower() if w.isalnum() else _JUNK.sub("", w.lower())).encode("utf-8", "surrogatepass")


PLAIN = Words(plain)
BYTES = Words(bytes)
store(PLAIN.clear)
store(BYTES.clear)


def plain_hashes(text: str | None) -> np.ndarray:
    """Hashes of the normalised words of text, empty ones left out."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.split()
    a = np.fromiter(map(PLAIN.__getitem__, parts), np.uint64, len(parts))
    return a[a != 0]


def ascii_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of text with A-Z lower-cased and nothing else changed."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(BYTES.__getitem__, parts), np.uint64, len(parts))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    acc = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        acc = mix(acc + words[i : n - k + 1 + i] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return acc


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

GOLD = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


def runs(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A hash of each run of words; heads are the runs' first places."""
    if not len(heads):
        return np.empty(0, np.uint64)
    n = np.diff(np.append(heads, len(words)))
    at = np.arange(len(words), dtype=np.uint64) - np.repeat(heads, n).astype(np.uint64)
    return mix(np.add.reduceat(mix(words + at * np.uint64(GOLD)), heads) + n.astype(np.uint64))


def order_of(docs: DataFrame) -> Column:
    """The place of a document among all: its doc_id; rows without one are documents by their text, after all others."""
    none = F.lit(LAST) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    return F.coalesce(F.col("doc_id").cast("long"), none)


def with_order(docs: DataFrame) -> DataFrame:
    """(_ord, text) of docs."""
    return docs.select(order_of(docs).alias("_ord"), "text")


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or with underscores behind it where docs has such a column already: the caller's columns are never replaced."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def rewrite(docs: DataFrame, removed: DataFrame, change, count: str, owner: str) -> DataFrame:
    """docs, with text changed where removed(_ord, hs) names the document: change(texts, sets of hashes) gives each new text and a count.

    Only documents that removed names may meet in a shuffle. n_chars, where there is one, follows the text; all other columns are carried in one struct, so no name can
    clash with a name used here. The count is named free_name(docs, count).
    """
    rest = [c for c in docs.columns if c != "text"]  # the text is carried once
    row = docs.select(order_of(docs).alias("_ord"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_doc"))
    maybe, stay = split_by(row, F.col("_ord"), bitmap(removed, "_ord"))

    @F.pandas_udf("struct<text string, n long>")
    def changed(texts, hs):
        import pandas as pd

        enter(owner)
        got = [(t, 0) for t in texts]
        some = [i for i, (t, h) in enumerate(zip(texts, hs)) if t is not None and h is not None]
        for k in range(0, len(some), 400):
            part = some[k : k + 400]
            new = change([got[i][0] for i in part], [{int(x) for x in hs.iloc[i]} for i in part])
            for i, x in zip(part, new):
                got[i] = x
        return pd.DataFrame(got, columns=["text", "n"])

    j = maybe.join(removed, "_ord", "left").withColumn("_c", changed("text", "hs"))
    new = {"text": F.col("_c.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_c.n") > 0, F.length("_c.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    name, old = free_name(docs, count), [F.col("text" if c == "text" else f"_doc.`{c}`").alias(c) for c in docs.columns]
    j = j.select(*[new.get(c, o).alias(c) for c, o in zip(docs.columns, old)], F.col("_c.n").alias(name))
    return stay.select(*old, F.lit(0).cast("long").alias(name)).union(j)
