"""Mixture-controlled packing (3): deficit round-robin over source queues, one round a window of sequences.

In each window every queue is granted its quantum, window * weight / weights, and the deficit it carries from the
windows before: what it was granted less what it has sent. Queues are visited in a fixed order and send whole tokens; the
fraction that a queue can't send is owed to it in its next turn, and the grant of all queues together is always whole, so every
window is full. A queue's deficit therefore stays below one token, and after j windows it is known in closed form:
j * quantum less the difference of two rounded cumulative quanta. So each task finds the deficits at the window where its own
documents begin from the queues' totals alone, and carries them on; nothing is handed from task to task. Where a queue runs dry
its share of that window goes to the others by weight, and a new phase with the remaining queues begins; there are at most two phases a queue.

The driver holds the totals of at most `most_queues` queues: the largest sources have one each, all smaller ones beyond that share the last,
in which they stand one after the other. Nulls, ties, repeats: a null or empty text is a document of the one end token; a null source is a queue
of its own; each input row is packed, repeated rows too; an empty table gives no pieces. Extra columns of
the input are not read. Queue order is the order of the tokenised table's parts and the rows in them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import enter, materialize, ship
from ._tokens import encoder

END = 1
WEIGHT_SUM = 1 << 16
OFFSETS_BROADCAST_ROWS = 200_000
TOKENS = "doc_id long, source string, part int, ids binary, n long, at long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"


def _tokenise(batches):
    from pyspark import TaskContext

    enter("tokens")
    part, enc, sent = TaskContext.get().partitionId(), encoder(), {}
    end = np.array([END], "<u2").tobytes()
    for b in batches:
        ids = [enc.encode(t) + end for t in b["text"]]
        n = [len(x) // 2 for x in ids]
        at = []
        for s, k in zip(b["source"], n):
            at.append(sent.get(s, 0))
            sent[s] = at[-1] + k
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "source": b["source"], "part": part, "ids": ids, "n": n, "at": at})


def weights(totals: np.ndarray, target: np.ndarray | None, window: int) -> np.ndarray:
    """Integer weights, at least 1 each, whose sum is at most the window, so that each queue's quantum is a token or more."""
    t = np.asarray(totals if target is None else target, float)
    whole = max(len(t), min(WEIGHT_SUM, window // 2))
    w = np.maximum(1, np.rint(t / t.sum() * whole)).astype(np.int64)
    if w.sum() > window:
        raise ValueError("more queues than tokens in a window")
    return w


def _rounded(t, c, total):
    """t * c / total, halves up, without passing 64 bits."""
    return t // total * c + (t % total * c + total // 2) // total


class Schedule:
    """Sent tokens of each queue before each window. Phases begin at window `at`; what queue s has sent since is the difference of
    the rounded cumulative quanta up[s+1] and up[s]; a phase of a single window in which a queue runs dry has its grants listed instead."""

    def __init__(self, totals: np.ndarray, weight: np.ndarray, window: int):
        self.n, self.window = np.asarray(totals, np.int64), window
        w, left, at = np.asarray(weight, np.int64), self.n.copy(), 0
        starts, bases, ups, sums, lists = [], [], [], [], []
        while left.sum() > 0:
            active = np.where(left > 0, w, 0)
            up, total = np.append(0, np.cumsum(active)), int(active.sum())
            with np.errstate(divide="ignore", invalid="ignore"):
                k = int(np.nanmin(np.where(active > 0, left * (total / window) / active, np.inf))) + 1
            while k and (np.diff(_rounded(k * window, up, total)) > left).any():
                k -= 1
            starts.append(at), bases.append(self.n - left), ups.append(up), sums.append(total)
            if k:
                lists.append(np.zeros(len(w) + 1, np.int64))
                left, at = left - np.diff(_rounded(k * window, up, total)), at + k
                continue
            give = np.zeros(len(w), np.int64)
            while (room := min(window, int(left.sum())) - int(give.sum())) > 0:
                more = np.where(left > give, w, 0)
                give += np.minimum(np.diff(_rounded(room, np.append(0, np.cumsum(more)), int(more.sum()))), left - give)
            lists.append(np.append(0, np.cumsum(give)))
            left, at = left - give, at + 1
        shape = (len(starts), -1)
        self.start, self.sum = np.array(starts, np.int64), np.array(sums, np.int64)
        self.base, self.up, self.list = (np.array(x, np.int64).reshape(shape) for x in (bases, ups, lists))
        self.listed = self.list[:, -1] > 0 if len(starts) else np.empty(0, bool)

    def _sent(self, p, q, j):
        """Tokens that queue q has sent before window j of phase p, and all queues before it."""
        t = j * self.window
        lo, hi = _rounded(t, self.up[p, q], self.sum[p]), _rounded(t, self.up[p, q + 1], self.sum[p])
        some = self.listed[p] & (j > 0)
        lo, hi = np.where(self.listed[p], np.where(some, self.list[p, q], 0), lo), np.where(self.listed[p], np.where(some, self.list[p, q + 1], 0), hi)
        return hi - lo, lo

    def slabs(self, q: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queue q and window j: its tokens sent before the window, after it, and where its slab begins in it."""
        p = np.searchsorted(self.start, j, side="right") - 1
        (a, la), (b, lb) = self._sent(p, q, j - self.start[p]), self._sent(p, q, j - self.start[p] + 1)
        return self.base[p, q] + a, self.base[p, q] + b, lb - la

    def window_of(self, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The window in which token i of queue q lies."""
        p = np.empty(len(i), np.int64)
        for s in np.unique(q):
            p[q == s] = np.searchsorted(self.base[:, s], i[q == s], side="right") - 1
        x, w = i - self.base[p, q], self.up[p, q + 1] - self.up[p, q]
        j = np.where(self.listed[p], 0, (x * (self.sum[p] / self.window) / np.maximum(w, 1)).astype(np.int64))
        while (over := ~self.listed[p] & (self._sent(p, q, j)[0] > x)).any():
            j -= over
        while (under := ~self.listed[p] & (self._sent(p, q, j + 1)[0] <= x)).any():
            j += under
        return self.start[p] + j

    def pieces(self, s: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int):
        """Pieces of documents [begin, begin+n) of queues s: (document, start in it, length, window, position among all tokens)."""
        first, last = self.window_of(s, begin), self.window_of(s, begin + n - 1)
        count = last - first + 1
        doc = np.repeat(np.arange(len(s)), count)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        before, after, slab = self.slabs(s[doc], j)
        lo, hi = np.maximum(begin[doc], before), np.minimum((begin + n)[doc], after)
        keep = hi > lo
        doc, j, lo, hi, before, slab = doc[keep], j[keep], lo[keep], hi[keep], before[keep], slab[keep]
        at = j * self.window + slab + lo - before
        cut = (at + hi - lo - 1) // length - at // length + 1
        row = np.repeat(np.arange(len(doc)), cut)
        k = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        p0 = np.maximum(at[row], (at[row] // length + k) * length)
        p1 = np.minimum((at + hi - lo)[row], (at[row] // length + k + 1) * length)
        start = (lo - begin[doc])[row] + p0 - at[row]
        return doc[row], start, p1 - p0, j[row], p0


def pack(docs: DataFrame, length: int = 2048, sequences_per_window: int = 64, target: dict[str, float] | None = None, most_queues: int = 1024) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens; only the last sequence can be short.

    target: share by source; sources it lacks, or all where it is None, get their natural share.
    """
    spark = docs.sparkSession
    ship(spark)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    t = materialize(t.mapInPandas(_tokenise, TOKENS), "tokens")
    part = materialize(t.groupBy("part", "source").agg(F.sum("n").alias("sum")), "parts")
    sums = part.groupBy("source").agg(F.sum("sum").alias("sum"))
    top = sums.orderBy(F.desc("sum"), "source").limit(most_queues).collect()
    if not top:
        return spark.createDataFrame([], PIECES)
    if len(top) == most_queues:
        top.pop()  # the last queue is for all others
    top.sort(key=lambda r: (r["source"] is not None, r["source"]))
    names, totals = [r["source"] for r in top], [r["sum"] for r in top]
    rest = part.agg(F.sum("sum")).first()[0] - sum(totals)
    if rest:
        totals.append(rest)
    n = np.array(totals, np.int64)
    share = n / n.sum()
    if target is not None:
        share = np.array([target.get(s, share[i]) for i, s in enumerate(names)] + list(share[len(names) :]), float)
    window = length * sequences_per_window
    sched = Schedule(n, weights(n, share, window), window)
    number = {s: i for i, s in enumerate(names)}
    from pyspark.sql import Window

    known = F.when(F.col("source").isin([s for s in names if s is not None]) | (F.col("source").isNull() if None in number else F.lit(False)), F.col("source")).otherwise("")
    order = Window.partitionBy(known, F.col("source").isNull()).orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.withColumn("base", F.coalesce(F.sum("sum").over(order), F.lit(0))).select(F.col("part").alias("p"), F.col("source").alias("s"), "base")
    if part.count() <= OFFSETS_BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = t.join(base, (t.part == base.p) & t.source.eqNullSafe(base.s)).select("doc_id", "source", "ids", "n", (F.col("at") + F.col("base")).alias("begin"))

    def cut(batches):
        enter("tokens")
        for b in batches:
            if not len(b):
                continue
            s = np.array([number.get(None if x is None or x != x else x, len(number)) for x in b["source"]])
            doc, start, size, j, at = sched.pieces(s, b["begin"].to_numpy(np.int64), b["n"].to_numpy(np.int64), length)
            ids, crc = list(b["ids"]), []
            for d, x, k in zip(doc.tolist(), start.tolist(), size.tolist()):
                crc.append(zlib.crc32(np.frombuffer(ids[d], "<u2", k, 2 * x).astype("<u4").tobytes()))
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64").take(doc).array, "start": start, "length": size, "ids_crc32": crc, "doc_tokens": b["n"].to_numpy()[doc],
                "sequence_id": at // length, "offset": at % length, "source": b["source"].to_numpy()[doc], "window": j})

    return placed.mapInPandas(cut, PIECES)
