"""Lines and status records are read in the row of their file: nothing is sorted or shuffled, and no record is read again for each use."""

from pyspark.sql import functions as F

from curalis.operators import lexical as X
from curalis.operators import observers as O
from curalis.operators import rawrecords as R


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_lines_stay_in_their_rows(spark):
    d = spark.createDataFrame([("a", "stages:\n  x:\n    deps:\n    cmd: 1\n    deps:\nstages:\n  y:\nend:\n  z:"), ("b", None), ("c", "no"), ("d", "stages:\n    cmd: of none\n")], "k string, text string")
    for f in (X.stages, X.locked_stages, X.manifest_entries):
        assert not any(w in _plan(f(d, "k")) for w in ("Window", "Join", "Aggregate", "Sort"))
    assert sorted(tuple(r) for r in X.stages(d, "k").collect()) == [("a", 1, "x", ["deps", "cmd"]), ("a", 2, "y", [])]
    assert sorted(tuple(r) for r in X.locked_stages(d, "k").collect()) == [("a", 1), ("b", 0), ("c", 0), ("d", 0)]


def test_status_records_are_split_once(spark):
    h = "a" * 40
    d = spark.createDataFrame([(f"1 T. N... 120000 100644 100644 {h} {h} a b\x001 A. N... 000000 100644 100644 {h} {h} c\x00",)], "p string").select(R.hygiene_status(F.col("p")).alias("r"))
    assert _plan(d).count("split(") <= 2 and "regexp_extract(" not in _plan(d)
    r = d.first().r
    assert (r.added, [tuple(x) for x in r.findings], r["count"]) == (["c"], [("a b", "100644", "CONTENT_ID_EQUAL")], 1)


def test_a_history_is_split_once(spark):
    h, g = "a" * 40, "b" * 40
    d = spark.createDataFrame([("ok", f"{h}\x00{g}  {h}\x005\x00{g}\x00\x006\x00"), ("bad", f"{h}\x00\x00soon\x00"), ("short", h), ("none", ""), ("null", None)], "k string, p string").select("k", O.parse_history(F.col("p")).alias("r"))
    assert _plan(d).count("split(") == 2  # the log, and each record's parents
    got = {r.k: r.r for r in d.collect()}
    assert [tuple(x) for x in got["ok"]] == [(h, [g, h], 5), (g, [], 6)] and got["none"] == got["null"] == [] and got["bad"] is got["short"] is None
