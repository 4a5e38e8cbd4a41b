import random

import pytest
from pyspark.sql import functions as F

from curalis.operators import budgets


def _fold(rows, most):
    left, taken = {}, set()
    for p, o, n in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[1])):
        if n <= left.setdefault(p, most):
            left[p] -= n
            taken.add((p, o))
    return taken


@pytest.mark.parametrize("block", [4, 64, 1024])
def test_blocks_equal_a_fold(spark, monkeypatch, block):
    monkeypatch.setattr(budgets, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(p, o, rng.choice([0, 1, rng.randrange(60), rng.randrange(900), None])) for p, k in (("hot", 600), ("b", 40), ("one", 1), (None, 30)) for o in range(k)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "p string, o int, n int")
    taken, rounds = budgets.greedy_rounds(d, "p", "o", "n", 5000)
    assert {(r._p, r._o) for r in taken.collect()} == _fold(rows, 5000)
    assert rounds <= 12 and (block < 1024 or rounds == 2)
    assert budgets.greedy_budget(d, "p", "o", "n", 5000).count() == len(_fold(rows, 5000))


def test_a_tight_budget_goes_on_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(budgets, "BLOCK_ROWS", 2)
    rows = [("a", i, 100 - i) for i in range(40)]  # each skip leaves room for a later row
    taken, rounds = budgets.greedy_rounds(spark.createDataFrame(rows, "p string, o int, n int"), "p", "o", "n", 250)
    assert {(r._p, r._o) for r in taken.collect()} == _fold(rows, 250) and rounds <= 21
    assert budgets.greedy_rounds(spark.createDataFrame([], "p string, o int, n int"), "p", "o", "n", 5)[0].count() == 0


def test_content_budgets_name_their_limit(spark):
    d = spark.createDataFrame([("r", 1, 9), ("r", 2, 50), ("r", 3, 4), ("r", 4, 3), ("r", 5, 1)], "p string, o int, n int")
    got = budgets.content_budgets(d, "p", "o", "n", F.lit("id"), 40, 13).orderBy("o").collect()
    assert [(r.limitation, r.content_id) for r in got] == [(None, "id"), (budgets.TOO_LARGE, None), (None, "id"), (budgets.NO_BUDGET, None), (budgets.NO_BUDGET, None)]


def test_nothing_is_listed_below_a_wide_directory(spark):
    rows = [(".", None), ("a", "."), ("b", "."), ("a/1", "a"), ("a/2", "a"), ("a/d", "a"), ("a/d/x", "a/d"), ("b/1", "b"), ("b/d", "b"), ("b/d/y", "b/d"), ("ab", ".")]
    d = spark.createDataFrame(rows, "path string, parent string")
    got = {r.path: r.warnings for r in budgets.bounded_listing(d, "parent", "path", 2).collect()}
    assert got == {".": ["DIRECTORY_ENTRY_LIMIT"]}
    got = {r.path: r.warnings for r in budgets.bounded_listing(d.filter("path != 'ab'"), "parent", "path", 2).collect()}
    assert got == {".": [], "a": ["DIRECTORY_ENTRY_LIMIT"], "b": [], "b/1": [], "b/d": [], "b/d/y": []}
