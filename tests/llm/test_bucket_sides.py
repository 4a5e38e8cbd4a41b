"""The last step of bucket_links compares members of different components, not all members of a bucket."""

from pyspark.sql import functions as F

from curalis.llm import _graph as G


def _compared(b):
    y, x = G._sides(b, b.select("id", (F.col("id") % 7).alias("v")).distinct())
    return y.join(x, (F.col("bid") == F.col("x_bid")) & (F.col("part") == F.col("x_part"))).select("bid", "id", "c", "few", "x_id", "x_c")


def test_a_large_component_does_not_meet_itself(spark):
    rows = [(1, i, 600, 0 if i < 590 else i, False) for i in range(600)] + [(2, i, 3, i, False) for i in (1, 2, 3)]
    got = _compared(spark.createDataFrame(rows, "bid long, id long, n long, c long, led boolean")).cache()
    assert got.filter("bid = 1").count() == 600 * 10
    once = got.filter("c <> x_c and (not few or x_c < c)")
    pairs = [(r.bid, *sorted((r.id, r.x_id))) for r in once.collect()]
    want = {(b, i, j) for b, i, _, c, _ in rows for b2, j, _, c2, _ in rows if b == b2 and i < j and c != c2}
    assert len(pairs) == len(want) and set(pairs) == want


def test_links_are_those_of_all_pairs(spark):
    near = lambda i, j: i // 10 == j // 10 and abs(i - j) <= 3
    b = spark.createDataFrame([(i // 40, i) for i in range(120)], "bid long, id long")
    confirm = lambda p: p.filter("floor(a / 10) = floor(b / 10) and abs(a - b) <= 3")
    links = G.bucket_links(b, confirm, b.select("id", F.col("id").alias("v")), lambda p, q: F.abs(p("v") - q("v")) <= 9, lambda p, q: F.abs(p("v") - q("v")))
    assert all(near(r.a, r.b) for r in links.collect())
    got = {r.id: r.component for r in G.components(links).collect()}
    assert got == {i: i // 10 * 10 for i in range(120)}
