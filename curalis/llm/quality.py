"""Quality by positive-unlabelled learning (1): the non-negative unbiased risk with an estimated class prior.

Trusted positives are documents marked good, the unlabelled ones are all web texts without a mark. A first classifier of
positives against unlabelled texts estimates the share of positives
among the unlabelled: for each threshold the unlabelled share above it over the positives' share above it is
an upper bound, and the least bound, widened by its sampling error, is taken. The scorer then minimises
prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss by Newton steps; where a step would take the part in the
maximum below zero, it is cut back to zero. Every unlabelled document counts in each expectation: their features are written once, and each
step is a pass of partial sums over them. Positives, and the marked documents by which the score is at last calibrated (a shift and a
scale of f, so that 0.7 means a share of 0.7), are samples of at most `most_labelled` rows of each mark, those with the smallest hash of doc_id.
Features are counts over the whole text.

Cases: null text counts as empty and is scored; without positives or unlabelled texts each score is 0.5; without documents marked bad the score is not
calibrated; each row is scored on its own, so repeated rows agree; a null doc_id counts as an empty one for the fold; several labels of
one document must agree for it to count as marked; extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, ship

PUNCT = np.frombuffer(string.punctuation.encode(), np.uint8)
WIDTH = 2 * 14 + 2 * len(PUNCT)


def features(text: str | None) -> np.ndarray:
    """Shares of symbols, case, digits and white space, word lengths and repetition over the whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h = np.bincount(raw, minlength=256)
    words = text.split()
    n, size = len(words), max(1, len(raw))
    upper, lower = h[65:91].sum(), h[97:123].sum()
    lines = text.split("\n")
    distinct = len(set(words))
    per_word = h[PUNCT] / max(1, n)
    base = [
        upper / max(1, upper + lower), h[48:58].sum() / size, (h[32] + h[9:14].sum()) / size, h[128:].sum() / size, h[PUNCT].sum() / size,
        distinct / max(1, n), math.log1p(distinct) / max(0.7, math.log1p(n)), len(set(lines)) / len(lines), math.log1p(n) / 10, size / max(1, n) / 20,
        h[10] / max(1, n), h.max() / size, float(n == 0), (h[:9].sum() + h[14:32].sum() + h[127]) / size,
    ]
    base = np.array(base, float)
    return np.concatenate([base, np.sqrt(base), np.minimum(per_word, 1.0), np.sqrt(np.minimum(per_word, 1.0))])


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), WIDTH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def moments(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a step needs of rows x, as one vector of sums: rows, loss, gradient, curvature."""
    f = x @ w
    s = _sigmoid(f)
    return np.concatenate([[len(x), _softplus(f).sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def _step(sums: np.ndarray, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    n = max(sums[0], 1)
    return sums[1] / n, sums[2 : 2 + size] / n, sums[2 + size :].reshape(size, size) / n


def fit_positive_unlabelled(pos: np.ndarray, of_unlabelled, steps: int = 6, l2: float = 1e-3) -> np.ndarray:
    """A plain logistic classifier of positives against unlabelled rows; of_unlabelled(w) gives their moments."""
    w = np.zeros(pos.shape[1])
    for _ in range(steps):
        _, gu, hu = _step(of_unlabelled(w), len(w))
        _, _, hp = _step(moments(pos, w), len(w))
        gp = -(1 - _sigmoid(pos @ w)) @ pos / len(pos)
        w = w - np.linalg.solve(hu + hp + l2 * np.eye(len(w)), gu + gp + l2 * w)
    return w


def prior_bound(positive: np.ndarray, above, unlabelled: int) -> float:
    """Share of positives among the unlabelled rows from scores of positives that no fit has seen; above(cuts) counts unlabelled scores at or over each cut."""
    if not len(positive) or not unlabelled:
        return 0.5
    sp = np.sort(positive)
    cuts = np.unique(sp)
    qp, qu = 1 - np.searchsorted(sp, cuts) / len(sp), above(cuts) / unlabelled
    err = math.sqrt(math.log(20) / 2 / len(sp)) + math.sqrt(math.log(20) / 2 / unlabelled)
    k = np.argmin((qu + err) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[k] / max(qp[k], 1e-9), 0.02, 0.98))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The same for rows at hand."""
    if len(pos) < 2 or not len(unl):
        return 0.5
    w = fit_positive_unlabelled(pos[::2], lambda w: moments(unl, w))
    su = np.sort(unl @ w)
    return prior_bound(pos[1::2] @ w, lambda cuts: len(su) - np.searchsorted(su, cuts), len(su))


def minimise_nonnegative(pos: np.ndarray, of_unlabelled, prior: float, steps: int = 10, ridge: float = 4.0) -> np.ndarray:
    """Weights that minimise the non-negative risk; of_unlabelled(w) gives the unlabelled rows' moments.

    With the logistic loss the unbiased risk is E_u[log(1 + e^f)] - prior * E_p[f], which is convex. The ridge weighs as much as `ridge` positives.
    """
    w, mean = np.zeros(pos.shape[1]), pos.mean(axis=0)
    got = of_unlabelled(w)
    l2 = ridge / len(pos)
    for _ in range(steps):
        _, g, h = _step(got, len(w))
        move = -np.linalg.solve(h + l2 * np.eye(len(w)), g - prior * mean + l2 * w)
        for _ in range(8):
            got = of_unlabelled(w + move)
            if _step(got, len(w))[0] - prior * _softplus(pos @ (w + move)).mean() >= 0:
                break
            move = move / 2
        else:
            break
        w = w + move
        if np.abs(move).max() < 1e-4:
            break
    return w


def fit_nonnegative(pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """The same for rows at hand."""
    return minimise_nonnegative(pos, lambda w: moments(unl, w), prior)


def calibrate(good: np.ndarray, bad: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(scale, shift) of f by logistic regression on marked rows, with targets kept off 0 and 1."""
    if not (len(good) and len(bad)):
        return 1.0, 0.0
    f = np.concatenate([good, bad])
    unit = max(float(np.abs(f).mean()), 1e-9)
    f, y = f / unit, np.repeat([(len(good) + 1) / (len(good) + 2), 1 / (len(bad) + 2)], [len(good), len(bad)])
    x, w = np.stack([f, np.ones(len(f))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        s = _sigmoid(x @ w)
        w = w - np.clip(np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (s - y)), -2, 2)
    return (float(w[0] / unit), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class Model:
    """Standardised features, weights, the prior they were fitted with and the calibration; w is None where nothing could be learned."""

    def __init__(self, mean=None, scale=None, w=None, prior: float = 0.5, to_share: tuple[float, float] = (1.0, 0.0)):
        self.mean, self.scale, self.w, self.prior, self.to_share = mean, scale, w, prior, to_share

    def x(self, m: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((m - self.mean) / self.scale, -8, 8), np.ones((len(m), 1))])

    def scores(self, texts) -> np.ndarray:
        if self.w is None or not len(texts):
            return np.full(len(texts), 0.5)
        a, b = self.to_share
        return _sigmoid(a * (self.x(feature_matrix(texts)) @ self.w) + b)


def _rows(batch: pd.DataFrame) -> np.ndarray:
    return np.array(list(batch["x"]), np.float64).reshape(len(batch), WIDTH)


def _summed(rows: DataFrame, value) -> np.ndarray:
    """The sum over all batches of value(features), a vector; what is shuffled is one row for each of its places and task."""
    def run(batches):
        total = 0
        for b in batches:
            if len(b):
                total = total + value(_rows(b))
        if not np.isscalar(total):
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = rows.select("x").mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    return got["v"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, quality); the caller gives only rows that may be learned from."""
    ship(docs.sparkSession)
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    d = docs.filter("doc_id is not null")
    ids = d.select("doc_id", F.xxhash64("doc_id").alias("h")).join(marks.select("doc_id", F.col("lo").alias("y")), "doc_id")
    some = [ids.filter(F.col("y") == y).orderBy("h", "doc_id").limit(most_labelled).select("doc_id", F.lit(y).alias("y")) for y in (0, 1)]
    ids = materialize(some[0].union(some[1]).distinct(), "marked")  # at most most_labelled rows of each mark

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": list(feature_matrix(b["text"]).astype(np.float32))})

    known = d.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", "text").mapInPandas(run, "y int, x array<float>").toPandas()
    x, y = _rows(known), known["y"].to_numpy()
    order = np.lexsort(x.T[::-1]) if len(x) else np.arange(0)  # the same fit for any order of rows
    x, y = x[order], y[order]
    def features(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": list(feature_matrix(b["text"]).astype(np.float32))})

    # features first: what the anti join may shuffle is a few numbers a document, never its text
    free = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(features, "doc_id long, x array<float>")
    free = materialize(free.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("x"), "features")
    pos = x[y == 1]
    sums = _summed(free, lambda m: np.concatenate([[len(m)], m.sum(axis=0), (m * m).sum(axis=0)])) if len(pos) else np.empty(0)
    if not len(pos) or not len(sums):
        return Model()
    n = int(sums[0])
    mean = sums[1 : 1 + WIDTH] / n
    model = Model(mean, np.sqrt(np.maximum(sums[1 + WIDTH :] / n - mean * mean, 0)) + 1e-3)
    p = model.x(pos)

    def of_unlabelled(w):
        return _summed(free, lambda m: moments(model.x(m), w))

    w = fit_positive_unlabelled(p[::2], of_unlabelled)
    model.prior = prior_bound(p[1::2] @ w, lambda cuts: _summed(free, lambda m: len(m) - np.searchsorted(np.sort(model.x(m) @ w), cuts).astype(float)), n)
    model.w = minimise_nonnegative(p, of_unlabelled, model.prior)
    f = model.x(x) @ model.w
    model.to_share = calibrate(f[y == 1], f[y == 0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.scores(list(b["text"]))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
