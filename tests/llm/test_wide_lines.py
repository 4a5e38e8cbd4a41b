"""Wide sketches of long lines: no linked pair is lost, unlike lines that share a block do not pass."""

import numpy as np

from curalis.llm import line_dedup as L
from curalis.llm._common import signed


def _row(i, words):
    s, (bits, _) = L.parity(words, np.array([0])), L.wide_parity(words, np.array([0]))
    return (i, len(words), *[int(x) for x in signed(s[0].copy())], [int(x) for x in signed(bits)] or None)


def test_unlike_long_lines_do_not_pass_and_near_ones_do(spark):
    rng, rows, near = np.random.default_rng(5), [], []
    for i, n in enumerate([150, 150, 300, 300, 1000, 1000]):
        rows.append(_row(i, rng.integers(1, 1 << 62, n).astype(np.uint64)))
    for i, n in enumerate([66, 70, 127, 129, 150, 300, 1030]):
        words = rng.integers(1, 1 << 62, n).astype(np.uint64)
        d, other = n // 5, words.copy()
        other[rng.choice(n, d - d // 2, replace=False)] += np.uint64(1)  # substitutions, then words left out: sizes of sketches differ at the powers of two
        near += [_row(100 + 2 * i, words), _row(101 + 2 * i, np.delete(other, rng.choice(n, d // 2, replace=False)))]
    schema = "id long, m long, s0 long, s1 long, wide array<long>"
    df = spark.createDataFrame(rows + near, schema)
    x = df.toDF(*[f"x_{c}" for c in df.columns])
    got = {(r.x_id, r.id) for r in x.join(df, (x.x_id < df.id) & L._close("", "x_")).select("x_id", "id").collect()}
    assert got == {(100 + 2 * i, 101 + 2 * i) for i in range(7)}


def test_short_lines_have_no_wide_sketch():
    bits, size = L.wide_parity(np.arange(1, 300, dtype=np.uint64), np.array([0, 64, 129]))
    assert size.tolist() == [0, 4, 8] and len(bits) == 12
