"""Ranked lexical search by Fagin's threshold algorithm over shards of documents.

Documents are tokenised once for a block of items: each becomes a row of the forward index (length, the items' terms it holds and how often),
written as a table. Document frequencies are counted from it. Then every shard of documents sorts the postings of each term by impact and runs the
threshold algorithm for each item: it reads the item's lists round-robin from the top, looks the full score of each new document up in the forward
index, and stops when the sum of the impacts at the present depth is strictly below the k-th score, as no document unseen can then reach or tie it. The
best k of a shard are merged in two steps; each step keeps k rows an item and task.

Items are the stated query set. They are read in blocks of at most BLOCK pairs of item and term, whose terms are broadcast to the tasks: one pass over
the texts for each block. Nothing else grows with the data outside the shards: a shard closes at SHARD postings.

Cases: a null or empty text has no terms and counts in no statistic; an item without terms, or whose terms no document holds, has no result; equal
scores rank by ascending doc_id, a null doc_id last; repeated rows of one doc_id are documents of their own, repeated rows of one item (and equal text) one item, rows with one
item_id and other texts are ranked apart; long texts are read whole; empty tables give no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LAST, enter, materialize, order_of, release, ship

BLOCK = 250_000  # pairs of item and term in a block
SHARD = 4_000_000  # postings in a shard
STEP = 16  # depth of the first round; each further one is twice as deep
SALTS = 64
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters outside ASCII, with A-Z lower-cased. All separators are ASCII, so bytes do."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """(k, q, term, times) of the items: k is the key, q a name of the item that is never null, made of the key and the text."""
    name = items.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        for b in batches:
            got = [(i, w, n) for i, t in enumerate(b.column("text").to_pylist()) for w, n in Counter(terms(t)).items()]
            at = pa.array([i for i, _, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), b.column("q").take(at), pa.array([w for _, w, _ in got], pa.binary()), pa.array([n for _, _, n in got], pa.int64())], ["k", "q", "term", "times"])

    k, text = F.col(f"`{key}`"), F.col("text").cast("string")
    some = items.select(k.alias("k"), F.concat(F.coalesce(k.cast("string"), F.lit("\0")), F.lit("|"), F.sha2(F.coalesce(text, F.lit("")), 256)).alias("q"), text.alias("text")).dropDuplicates(["q"])
    return some.mapInArrow(split, f"k {name}, q string, term binary, times long")


def blocks(pairs: DataFrame) -> DataFrame:
    """pairs with the number of their block: whole items, by a hash that deals them to as many blocks as their number asks for."""
    n = pairs.count()
    return pairs.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-2 * n // BLOCK) if n > BLOCK else 1))))


def forward_index(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc, n, ids, tf) of the rows of docs: terms with repeats, and of the broadcast vocabulary {term: id} those held, with their times."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        get = vocabulary.value.get
        for b in batches:
            n, ids, tf, ends = [], [], [], [0]
            for t in b.column("text").to_pylist():
                ws = terms(t)
                n.append(len(ws))
                a = np.fromiter((get(w, -1) for w in ws), np.int32, len(ws))
                u, c = np.unique(a[a >= 0], return_counts=True)
                ids.append(u)
                tf.append(c)
                ends.append(ends[-1] + len(u))
            at = pa.array(ends, pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0) for x in (ids, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(flat[1].astype(np.int32)))], ["doc", "n", "ids", "tf"])

    some = docs.select(F.when(F.col("doc_id").isNotNull(), order_of(docs)).otherwise(F.lit(LAST)).alias("doc"), F.col("text").cast("string"))
    return some.mapInArrow(index, "doc long, n long, ids array<int>, tf array<int>")


class Shard:
    """Postings of some documents: a forward index by document, and for each term a list of them by falling impact."""

    def __init__(self, doc, ends, term, impact):
        self.doc, self.ends, self.term, self.impact = doc, ends, term, impact
        self.row = np.repeat(np.arange(len(doc)), np.diff(ends))
        self.order = np.lexsort((-impact, term))
        self.heads = term[self.order]

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Random lookups: the full scores of rows, by the weight that the item gives each term."""
        first, n = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], np.cumsum(n) - n)

    def top(self, item: list[tuple[int, int]], weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, score) of the k best with a score above 0. weight is all 0 before and after."""
        ids = np.array([t for t, _ in item])
        times = np.array([n for _, n in item], np.int64)
        weight[ids] = times
        start, end = np.searchsorted(self.heads, ids), np.searchsorted(self.heads, ids, "right")
        seen = np.zeros(len(self.doc), bool)
        best, got, depth, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, STEP
        while True:
            take = [self.order[s + depth : min(s + depth + step, e)] for s, e in zip(start, end) if s + depth < e]
            rows = np.unique(self.row[np.concatenate(take)]) if take else np.empty(0, np.int64)
            rows = rows[~seen[rows]]
            seen[rows] = True
            if len(rows):
                best, got = np.append(best, self.doc[rows]), np.append(got, self.scores(rows, weight))
                keep = np.lexsort((best, -got))[:k]
                keep = keep[got[keep] > 0]
                best, got = best[keep], got[keep]
            depth, step = depth + step, step * 2
            at = start + depth - 1  # the last entry read of each list; a list that has ended adds nothing any more
            alive = start + depth < end
            threshold = int((times[alive] * self.impact[self.order[at[alive]]]).sum())
            if not alive.any() or len(got) == k and got[-1] > threshold:
                break
        weight[ids] = 0
        return best, got


def impacts(ids: np.ndarray, tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Of postings: the term's weight times its saturated occurrences, in whole numbers."""
    m = 25 + (75 * n * documents) // length
    return weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _shards(batches: Iterator[pa.RecordBatch], weight, documents: int, length: int) -> Iterator[Shard]:
    held, size = [], 0

    def shard() -> Shard:
        doc, n, count, ids, tf = (np.concatenate(x) for x in zip(*held))
        ends = np.append(0, np.cumsum(count))
        return Shard(doc, ends, ids, impacts(ids, tf.astype(np.int64), np.repeat(n, count), weight, documents, length))

    for b in batches:
        ids = b.column("ids")
        count = np.diff(ids.offsets.to_numpy())
        some = count > 0
        held.append((b.column("doc").to_numpy()[some], b.column("n").to_numpy()[some], count[some], ids.flatten().to_numpy(), b.column("tf").flatten().to_numpy()))
        size += len(held[-1][3])
        if size >= SHARD:
            yield shard()
            held, size = [], 0
    if size:
        yield shard()


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", k: int = 10) -> DataFrame:
    """(key, rank, doc_id, score): each item's k best documents by docs(doc_id, text), as the module says."""
    spark = docs.sparkSession
    ship(spark)
    pairs = materialize(blocks(materialize(item_terms(items, key), "item-terms")), "item-blocks")
    out = None
    for r in pairs.select("block").distinct().orderBy("block").toLocalIterator():
        part = _block(docs, pairs.filter(F.col("block") == r.block), k)
        out = part if out is None else out.unionByName(part)
    name = items.schema[key].dataType.simpleString()
    if out is None:
        return spark.createDataFrame([], f"{key} {name}, rank int, doc_id long, score long")
    doc = F.when(F.col("doc") < LAST, F.col("doc"))
    return out.select(F.col("k").alias(key), "rank", doc.alias("doc_id"), "score")


def _block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = pairs.select("q", "term", "times").toPandas()  # at most about BLOCK rows
    words = {w: i for i, w in enumerate(sorted(set(map(bytes, rows["term"]))))}
    number = {q: i for i, q in enumerate(sorted(set(rows["q"])))}
    asked: list[list[tuple[int, int]]] = [[] for _ in number]
    for q, w, n in zip(rows["q"], rows["term"], rows["times"]):
        asked[number[q]].append((words[bytes(w)], int(n)))
    vocabulary = sc.broadcast(words)
    index = materialize(forward_index(docs, vocabulary), "forward")
    vocabulary.unpersist()
    size = index.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    documents, length = size.documents, size.length or 1
    weight = np.zeros(len(words), np.int64)
    for x in index.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():
        weight[x.id] = math.floor(1000 * math.log((2 * documents + 2) / (2 * x["count"] + 1)))
    shared = sc.broadcast((weight, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        weight, asked = shared.value
        zero = np.zeros(len(weight), np.int64)
        for s in _shards(batches, weight, documents, length):
            got = [s.top(x, zero, k) for x in asked]
            item = np.repeat(np.arange(len(asked)), [len(d) for d, _ in got])
            doc, score = np.concatenate([d for d, _ in got]), np.concatenate([x for _, x in got])
            salt = (doc % SALTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(salt), pa.array(doc), pa.array(score)], ["item", "salt", "doc", "score"])

    found = index.mapInArrow(run, "item int, salt int, doc long, score long")
    best = materialize(_best(_best(found, ["item", "salt"], k).drop("rank"), ["item"], k).drop("salt"), "ranked")
    release(index)
    shared.unpersist()
    of = spark.createDataFrame([(i, q) for q, i in number.items()], "item int, q string").join(pairs.select("q", "k").distinct(), "q")
    return best.join(of, "item").select("k", F.col("rank").cast("int"), "doc", "score")
