"""Sliding sentence spans (10): every run of SPAN consecutive sentences is hashed and joined globally; sentences
covered by any non-first repeated span go.

A sentence ends after '.', '!' or '?' or at a line's end. One of over MOST_WORDS words is cut before each word whose hash,
taken with the next word's, is the least among NEAR words on both sides. That depends on those words alone, so in a repeated
stretch the cuts are the same but for NEAR words at its ends, wherever it stands in a sentence. What is still over MOST_WORDS
words, as in text of a few words over and over, is cut at every MOST_WORDS words. Nearly every stretch of 51 words inside long
sentences has a common span, not every one. Sentences of up to MOST_WORDS words are never cut, so of a passage that begins and
ends inside such sentences three whole ones must repeat. A text of fewer than SPAN sentences is one span of them all, whatever its
length. Words are compared in lower case, letters and digits only. First means the smallest doc_id, then the earlier place in it.

The spans' hashes are counted with partial sums, only hashes that a bounded bitmap lets through meet in the second
join, and a text is shuffled only if it may change. Nothing is collected; a passage that a third of all documents
share is one row for each task before the shuffle.

Cases: null and empty texts and those without a span are unchanged; rows of one doc_id are one document and
do not repeat each other; rows without a doc_id are documents by their text, after all others; removed sentences leave single spaces
in their line, lines that become empty go; other columns pass through whatever their names, and where one is called n_removed already
the count is n_removed_; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import GOLD, Words, bitmap, enter, materialize, mix, plain, rewrite, runs, ship, signed, split_by, store, with_order

SPAN = 3
MOST_WORDS = 20
NEAR = 3


class _Ends(Words):
    """Word hashes whose lowest bit says whether the word ends a sentence."""

    def __missing__(self, w):
        h = super().__missing__(w) & ~1 | (w.rstrip("\"')]»”*#$%&")[-1:] in ".!?" and w[-1:] != "")
        self[w] = h
        return h


_ENDS = _Ends(plain)
store(_ENDS.clear)


def _cuts(words: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where long sentences are cut; place of each word in its sentence and the sentence's size."""
    x = mix(words)
    x[:-1] = mix(x[:-1] + words[1:])
    cut = (size > MOST_WORDS) & (place > NEAR) & (size - place > NEAR)
    for k in range(1, NEAR + 1):
        cut[k:] &= x[k:] < x[:-k]
        cut[:-k] &= x[:-k] <= x[k:]
    return cut


def sentences(text: str) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words by line, all words' hashes, and for each sentence its first word's place and its line."""
    lines = [x.split() for x in text.split("\n")]
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = [w for x in lines for w in x]
    h = np.fromiter(map(_ENDS.__getitem__, flat), np.uint64, len(flat))
    if not len(h):
        return lines, h, np.empty(0, np.int64), np.empty(0, np.int64)
    line = np.repeat(np.arange(len(lines)), n)
    start = np.ones(len(h), bool)
    start[1:] = (h[:-1] & np.uint64(1)).astype(bool) | (line[1:] != line[:-1])
    at = np.arange(len(h))
    heads = np.flatnonzero(start)
    n = np.diff(np.append(heads, len(h)))
    if (n > MOST_WORDS).any():
        start |= _cuts(h >> np.uint64(1), at - np.repeat(heads, n), np.repeat(n, n))
    start |= (at - np.maximum.accumulate(np.where(start, at, 0))) % MOST_WORDS == 0
    heads = np.flatnonzero(start)
    return lines, h >> np.uint64(1), heads, line[heads]


def spans(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Hash of the span that begins at each sentence. A text of fewer than SPAN sentences is one span of them all."""
    s = runs(words, heads)
    if not len(s):
        return np.empty(0, np.int64)
    n = min(SPAN, len(s))
    acc = np.full(len(s) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix(acc + s[i : len(s) - n + 1 + i] + np.uint64((i + 1) * GOLD & 0xFFFFFFFFFFFFFFFF))
    return signed(acc)


def _spans_of(batches):
    enter("sentences")
    for b in batches:
        ids, hs = [], []
        for o, t in zip(b["_ord"], b["text"]):
            if not t:
                continue
            _, w, heads, _ = sentences(t)
            h = spans(w, heads)
            if len(h):
                u = np.unique(h)
                ids.append(np.full(len(u), o, np.int64))
                hs.append(u)
                if len(u) < len(h):  # 0 marks a document that repeats itself
                    ids.append(np.array([o], np.int64))
                    hs.append(np.zeros(1, np.int64))
        if ids:
            yield pd.DataFrame({"_ord": np.concatenate(ids), "h": np.concatenate(hs)})


def _without(text: str, gone: set[int]) -> tuple[str, int]:
    lines, w, heads, line = sentences(text)
    seen, drop = set(), np.zeros(len(heads), bool)
    for i, x in enumerate(spans(w, heads).tolist()):
        if x in gone or x in seen:
            drop[i : i + SPAN] = True
        seen.add(x)
    if not drop.any():
        return text, 0
    ends = np.append(heads, len(w))
    begin = np.cumsum([0, *map(len, lines)])
    raw, out, k = text.split("\n"), [], 0
    for i, x in enumerate(lines):
        first = k
        while k < len(heads) and line[k] == i:
            k += 1
        if not drop[first:k].any():
            out.append(raw[i])
            continue
        kept = [" ".join(x[heads[q] - begin[i] : ends[q + 1] - begin[i]]) for q in range(first, k) if not drop[q]]
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out), int(drop.sum())


def drop_repeated_sentences(docs: DataFrame) -> DataFrame:
    """docs with repeated sentences removed from text, and how many: n_removed."""
    ship(docs.sparkSession)
    d = with_order(docs)
    s = materialize(d.mapInPandas(_spans_of, "_ord long, h long"), "spans")
    dup = s.filter("h <> 0").groupBy("h").agg(F.min("_ord").alias("lo"), F.max("_ord").alias("hi")).filter("lo < hi").select("h", "lo")
    dup = materialize(dup, "repeated")
    some, _ = split_by(s.filter("h <> 0"), F.col("h"), bitmap(dup, "h"))
    later = some.join(dup, "h").filter("_ord > lo").select("_ord", "h").union(s.filter("h = 0").select("_ord", "h"))
    removed = materialize(later.groupBy("_ord").agg(F.collect_set("h").alias("hs")), "removed")
    return rewrite(docs, removed, lambda texts, gone: list(map(_without, texts, gone)), "n_removed", "sentences")
