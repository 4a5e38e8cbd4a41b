"""Near pairs: sets go to the tiles of a cluster and not with each pair; tokens are ranked in their rows."""

import random

from pyspark.sql import functions as F

from curalis.operators import duplicates


def test_sets_go_to_few_tiles(spark):
    ids = list(range(0, 3000, 10))  # all of them near each other: 44,850 pairs
    c = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "ia long, ib long")
    t = duplicates._tiles(c).cache()
    assert {(r.ia, r.ib) for r in t.collect()} == {(a, b) for a in ids for b in ids if a < b} and t.count() == 300 * 299 // 2
    goes = t.select("tile", F.col("ia").alias("id")).union(t.select("tile", F.col("ib").alias("id"))).distinct()
    assert goes.count() <= 300 * 5  # five parts, and not 89,700 sets
    assert max(r["count"] for r in goes.groupBy("tile").count().collect()) < 300


def test_large_clusters_over_several_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE", 4)
    monkeypatch.setattr(duplicates, "BUCKETS", 8)  # many tokens share a bucket
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.sample(words, 40) for _ in range(4)]
    texts = [" ".join(rng.sample(b, 36) + rng.sample(words, rng.randrange(6))) for b in base for _ in range(25)]
    paths = ["x.md" if i % 5 else "x.txt" for i in range(len(texts))]
    d = spark.createDataFrame([(f"a{i:03d}", paths[i], 1000, str(i), t) for i, t in enumerate(texts)], "artifact_id string, path string, size_bytes long, content_id string, text string")
    pairs, _ = duplicates.near_classes(d)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    sets = [set(t.split()) for t in texts]
    want = {}
    for i in range(len(sets)):
        for j in range(i):
            n, u = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if paths[i] == paths[j] and 10 * n >= 7 * u:
                want[frozenset((str(i), str(j)))] = round(n / u, 6)
    got = pairs.collect()
    assert {frozenset((r.ca, r.cb)): r.similarity for r in got} == want and len(got) == len(want) > 100
