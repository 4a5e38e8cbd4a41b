"""Benchmark decontamination by size-partitioned MinHash containment (9), verified by exact shingle containment.

Items are partitioned by the size of their shingle sets, by powers of two. An item's MinHash sketch is its `sketch_size` smallest shingle hashes, and a
partition has its own sketch size and least number of sketch hits: one that an item contained to `percent` falls short of with a
chance below 1e-9. Containment MinHash sketches the short side only: in the minima of a long document a short item would
drown, so the document answers for each sketched hash whether it has it, and the share of hits estimates the containment. A document is
held against those partitions only whose items could be in it by their size, and one with enough hits is checked against the item's whole
set, so the estimate decides nothing by itself.

Items' sets are hashed on the executors and taken in blocks of at most BLOCK_SHINGLES shingles, which bounds what the driver holds and
what is sent to the executors; each block is one scan of the documents without a shuffle.

Cases: null and empty texts, and texts without words, match nothing; items of fewer than five words are one run of
their own width; repeated items and rows are each reported; a null doc_id is reported as null; extra columns pass through
`clean` whatever their names; an empty table on either side gives no match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import enter, plain_hashes, shingles, ship, signed

WIDTH = 5
BLOCK_SHINGLES = 2_000_000
MATCHES = "doc_id long, item_id long, shared long, n_shingles long, containment double"


def sketch_size(m: int) -> int:
    """How many smallest hashes an item of m shingles gives: grows with its size partition."""
    return min(m, 4 * m.bit_length() + 8)


def least_hits(m: int, percent: int, miss: float = 1e-9) -> int:
    """Hits below which an item of m shingles is contained to `percent` with a chance under `miss` only."""
    k, need = sketch_size(m), -(-percent * m // 100)
    if k == m:
        return max(1, need)
    tail, total = 0, math.comb(m, k)
    for h in range(k + 1):  # hypergeometric: hits among k draws of which `need` of m are present
        tail += math.comb(need, h) * math.comb(m - need, k - h)
        if tail > miss * total:
            return max(1, h)
    return k


class Block:
    """Sketches and whole sets of some items, by shingle width and size partition."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]], percent: int):
        self.percent = percent
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        self.need = [least_hits(len(s), percent) for s in self.sets]
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (_, w, s) in enumerate(items):
            groups.setdefault((w, len(s).bit_length()), []).append(k)
        self.by: dict[int, list[tuple]] = {}
        for (width, _), some in sorted(groups.items()):
            h = [self.sets[k][: sketch_size(len(self.sets[k]))] for k in some]  # sets are sorted: the smallest hashes
            of = np.repeat(some, [len(x) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            least = min(-(-percent * len(self.sets[k]) // 100) for k in some)
            bits = np.zeros(1 << max(12, (64 * len(h)).bit_length()), bool)
            shift = np.uint64(64 - (len(bits) - 1).bit_length())
            bits[(h >> shift).astype(np.int64)] = True
            self.by.setdefault(width, []).append((least, shift, bits, h, of))

    def matches(self, words: np.ndarray):
        """(item, shared) of each item that the document contains."""
        for width, parts in self.by.items():
            if len(words) < width:
                continue
            s, own = shingles(words, width), None
            for least, shift, bits, h, of in parts:
                if len(s) < least:  # a document has too few shingles for any item of this partition
                    continue
                x = s[bits[(s >> shift).astype(np.int64)]]
                if not len(x):
                    continue
                x = np.unique(x)
                lo, hi = np.searchsorted(h, x), np.searchsorted(h, x, side="right")
                hit = np.concatenate([of[a:b] for a, b in zip(lo, hi) if b > a] or [np.empty(0, np.int64)])
                if not len(hit):
                    continue
                for k, c in zip(*(v.tolist() for v in np.unique(hit, return_counts=True))):
                    if c >= self.need[k]:
                        own = np.unique(s) if own is None else own
                        shared = len(np.intersect1d(self.sets[k], own, assume_unique=True))
                        if 100 * shared >= self.percent * len(self.sets[k]):
                            yield k, shared


def item_sets(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, hashes) of the items that have words."""
    def run(batches):
        enter("sets")
        for b in batches:
            out = []
            for i, t in zip(b["item_id"].astype("Int64"), b["text"]):
                words = plain_hashes(t)
                if len(words):
                    w = min(WIDTH, len(words))
                    out.append((i, w, signed(np.unique(shingles(words, w)))))
            f = pd.DataFrame(out, columns=["item_id", "width", "hashes"])
            yield f.astype({"item_id": "Int64"})

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(run, "item_id long, width int, hashes array<long>")


def blocks(benchmark: DataFrame, percent: int) -> Iterator[Block]:
    """The items, block after block; the driver holds one block."""
    held, size = [], 0
    for r in item_sets(benchmark).toLocalIterator():
        s = np.array(r["hashes"], np.int64).view(np.uint64)
        held.append((r["item_id"], r["width"], s))
        size += len(s)
        if size >= BLOCK_SHINGLES:
            yield Block(held, percent)
            held, size = [], 0
    if held:
        yield Block(held, percent)


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment) of each item contained in a document to `percent` or more."""
    spark = docs.sparkSession
    ship(spark)
    d, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block in blocks(benchmark, percent):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            enter("sets")
            b = sent.value
            for f in batches:
                rows = []
                for i, t in zip(f["doc_id"].astype("Int64"), f["text"]):
                    for k, shared in b.matches(plain_hashes(t)):
                        rows.append((i, b.ids[k], shared, len(b.sets[k]), shared / len(b.sets[k])))
                got = pd.DataFrame(rows, columns=["doc_id", "item_id", "shared", "n_shingles", "containment"])
                yield got.astype({"doc_id": "Int64", "item_id": "Int64", "shared": "int64", "n_shingles": "int64", "containment": "float64"})

        one = d.mapInPandas(run, MATCHES)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], MATCHES) if out is None else out


def _free_of(sent):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        enter("sets")
        b = sent.value
        return pd.Series([next(b.matches(plain_hashes(t)), None) is None for t in texts], dtype=bool)

    return free


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that contain an item; no shuffle."""
    ship(docs.sparkSession)
    for block in blocks(benchmark, percent):
        docs = docs.filter(_free_of(docs.sparkSession.sparkContext.broadcast(block))("text"))
    return docs
