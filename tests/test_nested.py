import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from curalis.functions import columns as C
from curalis.functions import nested as N
from curalis.operators import graphs as G
from curalis.plans.nested import _records

DATA = "/root/testdata/sf0.001"


def canonical(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"))


def _value(rng, depth=0):
    k = rng.randrange(9 if depth < 6 else 6)
    if k == 0:
        return rng.choice([0, -1, 10 ** rng.randrange(25), rng.randrange(10**6), -5])
    if k == 1:
        return rng.choice([1.5, 1e23, 2e-5, 1e16, 123456789012345.6, 9007199254740993.0, 5e-324, rng.random(), rng.random() * 10.0 ** rng.randrange(-20, 30), -0.0, 100.0, 0.0001])
    if k == 2:
        return rng.choice([True, False, None])
    if k < 6:
        return rng.choice(["", "a", "é\n", "🙂\"\\/", "token=abc x", '{"a":1}', "[", "\x7f", "\x00\x1f"])
    if k == 6:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "Z", "é", "🙂", "", 'x"y', "@id"]) + str(rng.randrange(3)): _value(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_canonical_json_equals_python(spark):
    rng = random.Random(7)
    values = [_value(rng) for _ in range(400)] + [[], {}, [[]], [{}], {"a": []}, "x", 1, None, True, 1.25, json.loads("[" * 40 + "]" * 40)]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), indent=2 if i % 3 == 0 else None) for i, v in enumerate(values)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "{"), (1003, "nope"), (1004, '{"a":1,"a":2}'), (1005, '[1] x')]
    got = {r.i: r.o for r in N.canonical_json(spark.createDataFrame(rows, "i int, j string"), "j", "o").collect()}
    assert [got[i] for i in range(len(values))] == [canonical(v) for v in values]
    assert [got[i] for i in (1000, 1001, 1002, 1003, 1005)] == [None] * 5


def _redacted(v):
    """The same by recursion over Python values."""
    found = set()

    def clean(x):
        if isinstance(x, str):
            for name, p in C.SECRETS:
                if re.search(p, x):
                    found.add(name)
            for name, p in C.SECRETS:
                x = re.sub(p, f"[REDACTED:{name}]", x)
            return x
        return [clean(y) for y in x] if isinstance(x, list) else {k: clean(y) for k, y in x.items()} if isinstance(x, dict) else x

    return canonical(clean(v)), sorted(found)


def test_redaction_reaches_every_string(spark):
    fixtures = [{"a": ["token=abc", {"password=x": "password=hunter2 y"}], "n": 1}, ["plain", [["api_key=sk-1"]]], "cookie=z", {"k": {"k": {"k": "ghp_" + "a" * 36}}}, 5]
    records = [r.json for r in _records(lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")).collect()]
    texts = [json.dumps(f) for f in fixtures] + records
    d = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {r.i: (r.o, r.c) for r in N.canonical_json(d, "j", "o", change=C.redact, gather=("c", C.secret_categories)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _redacted(json.loads(t)), t[:200]
    plain = {r.i: r.h for r in N.canonical_json(d, "j", "o").select("i", F.sha2("o", 256).alias("h")).collect()}
    assert all(plain[i] == hashlib.sha256(canonical(json.loads(t)).encode()).hexdigest() for i, t in enumerate(texts))


def test_references_at_any_depth(spark):
    graph = {"@context": 1, "@graph": [
        {"@id": "ro-crate-metadata.jsonld", "@type": ["CreativeWork"], "about": {"@id": "./"}}, {"@id": "./", "@type": "Dataset", "z": [[{"@id": "b", "inner": {"@id": "never"}}], {"k": {"@id": ""}, "m": {"@id": "./x"}}], "a": "b", "@rev": {"@id": "no"}},
        {"@id": "b", "s": '{"@id":"text"}', "o": {"y": {"@id": "https://x.org"}, "x": [{"@id": "./"}, {"@id": 5, "v": {"@id": "b"}}]}}, {"@id": "b"}, 3, {"name": "none"}]}
    wide = {"@context": 1, "@graph": [{"@id": "d", "p": [{"@id": f"t{i % 70:02d}"} for i in range(600)], "q": [[]] * 9000, "z": {"@id": "late"}}]}
    rows = [("g", json.dumps(graph)), ("w", json.dumps(wide)), ("n", "[]"), ("e", '{"@context":1,"@graph":[]}'), ("m", None)]
    got = {r.graph: r for r in G.observe(spark.createDataFrame(rows, "graph string, json string")).collect()}
    g = got["g"]
    assert [tuple(x) for x in g.references] == [("./", "z", "./x", False), ("./", "z", "b", True), ("b", "o", "./", True), ("b", "o", "b", True), ("b", "o", "https://x.org", False), ("ro-crate-metadata.jsonld", "about", "./", True)]
    assert g.limitations == ["RO_CRATE_DUPLICATE_ENTITY_ID", "RO_CRATE_ENTITY_MALFORMED", "RO_CRATE_EXTERNAL_REFERENCE_NOT_RETRIEVED", "RO_CRATE_REFERENCE_UNRESOLVED"]
    assert (g.descriptor_id, g.root_id, g.unresolved_ids, g.external_ids) == ("ro-crate-metadata.jsonld", "./", ["./x"], ["https://x.org"])
    w = got["w"]
    assert w.reference_count == 512 and w.limitations == ["RO_CRATE_DESCRIPTOR_MISSING", "RO_CRATE_REFERENCE_LIMIT", "RO_CRATE_REFERENCE_UNRESOLVED", "RO_CRATE_UNRESOLVED_REFERENCE_LIMIT", "RO_CRATE_VALUE_NODE_LIMIT"]
    assert len(w.unresolved_ids) == 64 and "late" not in w.unresolved_ids
    assert got["n"].limitations == got["m"].limitations == ["RO_CRATE_GRAPH_SHAPE_INVALID"] and got["n"].status == "UNAVAILABLE"
    assert got["e"].limitations == ["RO_CRATE_DESCRIPTOR_MISSING"] and got["e"].status == "OBSERVED_WITH_LIMITATIONS"
