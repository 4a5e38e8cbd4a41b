"""Blocks of the same lines are one bucket, lines just under the threshold do not pass, and lines are cut by their numbers."""

import numpy as np

from curalis.llm import line_dedup as L
from curalis.llm._common import signed


def _line(i, words):
    s, (bits, _) = L.parity(words, np.array([0])), L.wide_parity(words, np.array([0]), L.FINE)
    return (i, len(words), *[int(x) for x in signed(s[0].copy())], [int(x) for x in signed(bits)] or None)


def test_blocks_of_the_same_lines_are_one_bucket(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 62, 12).astype(np.uint64)
    b = a.copy()
    b[-1] += np.uint64(1)
    keys = [(int(k), i) for i, w in ((1, a), (2, b)) for k in L.blocks(w, np.array([0]))[1]]
    assert len({k for k, i in keys if i == 1} & {k for k, i in keys if i == 2}) > 1
    lines = spark.createDataFrame([_line(1, a)[:4], _line(2, b)[:4]], "id long, m long, s0 long, s1 long")
    got = L._buckets(spark.createDataFrame(keys, "bid long, id long"), lines, spark.createDataFrame([], "id long, wide array<long>")).collect()
    assert sorted(r.id for r in got) == [1, 2] and len({r.bid for r in got}) == 1 and {r.n for r in got} == {2}


def test_lines_just_under_the_threshold_do_not_pass(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(40):
        words = rng.integers(1, 1 << 62, 100).astype(np.uint64)
        for k, edits in enumerate((0, 20, 24)):
            other = words.copy()
            other[rng.choice(100, edits, replace=False)] += np.uint64(1)
            rows.append(_line(3 * i + k, other))
    df = spark.createDataFrame(rows, "id long, m long, s0 long, s1 long, wide array<long>")
    x = df.toDF(*[f"x_{c}" for c in df.columns]).filter("x_id % 3 = 0")
    got = [r.id % 3 for r in x.join(df, (x.x_id < df.id) & (df.id < x.x_id + 3) & L._close("", "x_")).select("id").collect()]
    assert got.count(1) == 40 and got.count(2) <= 4


def test_lines_are_cut_without_python_and_texts_of_one_document_keep_theirs_apart(spark):
    rows = [(1, "one two three\nx\none two three", "a"), (1, "x\none two three\n\n", "b"), (2, "head\none two three\ntail", "c"), (2, None, "d"), (3, "x", "e"), (4, "", "f")]
    out = L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, tag string"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.tag: (r.text, r.n_removed) for r in out.collect()}
    assert got == {"a": ("one two three\nx", 1), "b": ("x\none two three\n\n", 0), "c": ("head\ntail", 1), "d": (None, 0), "e": ("", 1), "f": ("", 0)}
