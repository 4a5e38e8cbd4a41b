"""Compression of vectors into codes of parts: product quantisation by Lloyd rounds that are maintained by their changes.

Vectors become integers and are cut into PARTS parts; every part position has a codebook of ENTRIES entries. The table of vectors carries the codes of
the round before. A round reads it, assigns every part to its nearest entry, and writes it with both codes; sums and counts of the entries are
running integers, and only parts whose entry changed add to the new one and take away from the old one: a task adds these up before anything is
shuffled, so that at most PARTS x ENTRIES rows leave it. All arithmetic is in whole numbers, so results depend on no order or partition. Codebooks (some
thousand numbers whatever the data) are all that reaches the driver. A lost executor is made good from the table of the round before; older ones go.

Cases: rows whose vector is null, or holds a null, NaN or infinite component, are dropped, and so are those of another length than the first kept one (of
least vec_id) or of a length that is not a multiple of PARTS or 0; vec_ids that repeat are rows of their own, in the order of their vectors; a null vec_id comes after all others;
with fewer kept vectors than ENTRIES the codebooks are that short; equal distances go to the lower entry; an entry without parts stays; components
beyond LIMIT in size count as LIMIT; no kept row gives no row; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import enter, join_by_size, materialize, release, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = (1 << 28) - 1
_SMALL = 1 << 20  # below it sums of eight squared differences are exact in doubles
_CHUNK = 4096


def integers(batch: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integer components) of an array of lists of doubles; dim: only those of this length."""
    size = batch.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((size > 0) & (size % PARTS == 0) if dim is None else size == dim)
    if not len(rows):
        return rows, np.empty((0, dim or 0), np.int64)
    flat = batch.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    bad = np.add.reduceat(~np.isfinite(x), np.append(0, np.cumsum(size[rows]))[:-1]) > 0
    if dim is None:
        return rows[~bad], np.empty((0, 0), np.int64)
    v = np.floor(np.clip(x.reshape(-1, dim)[~bad] * SCALE, -LIMIT, LIMIT)).astype(np.int64)
    return rows[~bad], v


def distances(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, d) to entries (k, d), exact."""
    if max(np.abs(v).max(initial=0), np.abs(book).max(initial=0)) < _SMALL:
        a, b = v.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - e) ** 2).sum(1) for e in book], 1)


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, PARTS), errors (n,)) of vectors (n, dim) by books (PARTS, k, dim / PARTS); of equal distances the lower entry."""
    width = books.shape[2]
    codes, errors = np.zeros((len(v), PARTS), np.uint8), np.zeros(len(v), np.int64)
    for p in range(PARTS):
        d = distances(v[:, p * width : (p + 1) * width], books[p])
        codes[:, p] = d.argmin(1)
        errors += d[np.arange(len(v)), codes[:, p]]
    return codes, errors


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.int32).ravel()))


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1).astype(np.int64)


def kept_vectors(rows: DataFrame, vector: str, key: str, label: str) -> tuple[DataFrame, int]:
    """((id, label, v array<int>), length) of the rows that are kept."""
    some = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    kind = some.schema["label"].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _ = integers(b.column("x"), None)
            yield b.take(pa.array(at))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for b in batches:
            at, v = integers(b.column("x"), dim)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("label").take(take), _lists(v)], ["id", "label", "v"])

    first = some.mapInArrow(lengths, some.schema).orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    dim = len(first[0].x) if first else 0
    if not dim:
        return some.limit(0).select("id", "label", F.lit(None).cast("array<int>").alias("v")), 0
    return some.mapInArrow(whole, f"id long, label {kind}, v array<int>"), dim


def changes(state: DataFrame, width: int, entries: int) -> DataFrame:
    """(part, entry, n, s array<long>): what parts whose entry changed add to counts and sums, taken together in each task and then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        n, s = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for b in batches:
            v, new = _vectors(b.column("v")), _codes(b.column("code"))
            had = np.asarray(b.column("old").is_valid())
            old = np.full_like(new, 255)
            if had.any():
                old[had] = _codes(b.column("old").filter(pa.array(had)))
            for p in range(PARTS):
                moved = new[:, p] != old[:, p]
                for codes, sign, some in ((new, 1, moved), (old, -1, moved & had)):
                    np.add.at(n[p], codes[some, p], sign)
                    np.add.at(s[p], codes[some, p], sign * v[some, p * width : (p + 1) * width])
        p, e = np.nonzero((n != 0) | (s != 0).any(2))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(s[p, e].ravel()))], ["part", "entry", "n", "s"])

    some = state.filter(~F.col("code").eqNullSafe(F.col("old"))).select("v", "code", "old").mapInArrow(run, "part int, entry int, n long, s array<long>")
    return some.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))


def _assigned(state: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
    """state with new codes (and the codes before as `old`); last: (id, label, code, error) instead."""
    kind = state.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("vectors")
        for whole in batches:
            for i in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(i, _CHUNK)
                codes, errors = assign(_vectors(b.column("v")), books)
                if last:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _bytes(codes), pa.array(errors)], ["id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), _bytes(codes), b.column("code")], ["id", "label", "v", "code", "old"])

    columns = "code binary, error long" if last else "v array<int>, code binary, old binary"
    return state.mapInArrow(run, f"id long, label {kind}, {columns}")


def books_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(codebooks (PARTS, k, dim / PARTS), the table of vectors with the codes of the last round) after `rounds` rounds over vectors(id, label, v)."""
    width = dim // PARTS
    state = materialize(vectors.withColumn("code", F.lit(None).cast("binary")), "vectors")
    first = [r.v for r in state.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    n, s = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for r in range(rounds):
        before, state = state, materialize(_assigned(state, books, False), f"codes-{r}")
        release(before)
        for x in changes(state, width, books.shape[1]).collect():
            n[x.part, x.entry] += x.n
            s[x.part, x.entry] += np.array(x.s, np.int64)
        books = np.where(n[:, :, None] > 0, s // np.maximum(n, 1)[:, :, None], books)
    return books, state


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of the rows kept, as the module says. Labels go back to rows as join_by_size does."""
    spark = rows.sparkSession
    ship(spark)
    vectors, dim = kept_vectors(rows, vector, key, label)
    if not dim:
        return spark.createDataFrame([], f"{key} long, code string, error long, label_error long, codebooks_sha256 string")
    books, state = train(vectors, dim)
    mark = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    done = materialize(_assigned(state, books, True).withColumn("mark", mark).drop("label"), "codes")
    release(state)
    by_label = materialize(done.groupBy("mark").agg(F.count("*").alias("_n"), F.sum("error").alias("label_error")), "label-errors")
    j = join_by_size(done, "mark", by_label, "_n")
    return j.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))
