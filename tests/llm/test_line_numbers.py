"""Long lines of the same few words over and over are told apart by their numbers; no pair at 0.8 is lost; lines are letters without a loop."""

import numpy as np

from curalis.llm import line_dedup as L
from curalis.llm._common import signed


def _passing(spark, lines):
    heads, rows = np.array([0]), []
    for i, words in enumerate(lines):
        (s,), (wide, _) = L.parity(words, heads), L.wide_parity(words, heads, L.FINE)
        rows.append((i, len(words), *[int(x) for x in signed(s.copy())], [int(x) for x in signed(wide)] or None))
    df = spark.createDataFrame(rows, "id long, m long, s0 long, s1 long, wide array<long>")
    both = df.toDF(*[f"x_{c}" for c in df.columns]).crossJoin(df).filter("x_id < id")
    return {(r.x_id, r.id) for r in both.filter(L._close("", "x_")).select("x_id", "id").collect()}


def test_lines_of_other_words_repeated_do_not_pass(spark):
    rng = np.random.default_rng(5)
    assert _passing(spark, [np.tile(rng.integers(1, 1 << 62, 8).astype(np.uint64), 40) for _ in range(6)]) == set()


def test_pairs_at_the_threshold_pass(spark):
    rng = np.random.default_rng(6)
    for n in (65, 66, 80, 128, 129, 300, 1030):
        for base in (rng.integers(1, 1 << 62, n).astype(np.uint64), rng.integers(1, 9, n).astype(np.uint64)):
            d = n // 5
            swapped, less, more = base.copy(), np.delete(base, rng.choice(n, d, replace=False)), np.insert(base, rng.choice(n, d, replace=False), rng.integers(1, 1 << 62, d).astype(np.uint64))
            swapped[np.arange(d) * 3 + 1] += np.uint64(1)
            assert {(0, 1), (0, 2), (0, 3)} <= _passing(spark, [base, swapped, less, more]), n


def test_letters_of_lines():
    w = np.array([0, 1, 0xCFFFF, 0xD0000, 1 << 63, 12345], np.uint64)
    want = [chr(int(x) % 0xD0000 + 0x10000) for x in w]
    assert L._letters(w, np.array([0, 2, 3])).to_pylist() == ["".join(want[:2]), want[2], "".join(want[3:])]
