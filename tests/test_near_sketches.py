"""Pairs that may be near meet by sketches, which lose none, before their token sets do."""

import random

from pyspark.sql import functions as F

from curalis.operators.duplicates import near_classes, parity


def test_sketches_differ_by_no_more_than_their_sets(spark):
    rng = random.Random(5)
    pool = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(600)]
    rows = [(sorted(rng.sample(pool, rng.randrange(600))), sorted(rng.sample(pool, rng.randrange(600)))) for _ in range(100)]
    d = spark.createDataFrame(rows, "a array<long>, b array<long>")
    bits = F.aggregate(F.zip_with(parity("a"), parity("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    for r in d.select("a", "b", bits.alias("bits")).collect():
        n = len(set(r.a) ^ set(r.b))
        assert r.bits <= n and r.bits % 2 == n % 2 and (n > 60 or r.bits >= n - 8)


def test_token_sets_travel_with_sketched_pairs_only(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(60)]
    texts += [" ".join(t.split()[:180] + rng.sample(words, 10)) for t in texts[:20]]
    d = spark.createDataFrame([(f"a{i:03d}", "x.md", 1000, str(i), t) for i, t in enumerate(texts)], "artifact_id string, path string, size_bytes long, content_id string, text string")
    pairs, _ = near_classes(d)
    assert "bit_count" in pairs._jdf.queryExecution().optimizedPlan().toString()
    sets = [set(t.split()) for t in texts]
    want = {(str(i), str(j)) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    assert {tuple(sorted(p, key=int, reverse=True)) for p in ((r.ca, r.cb) for r in pairs.collect())} == want and len(want) >= 20
