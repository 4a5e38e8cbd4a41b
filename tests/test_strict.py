import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from curalis.sources import canonical, strict


def _put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for n, b in files.items():
        os.makedirs(os.path.dirname(os.path.join(folder, n)), exist_ok=True)
        with open(os.path.join(folder, n), "wb") as f:
            f.write(b if isinstance(b, bytes) else b.encode())
    return str(folder)


def test_strict_values(spark):
    rows = ['{"a":1}', ' {"a":{"b":[1,{"c":null}]}} ', '{"a":1,"a":2}', '{"x":{"a":1,"a":2}}', '{"a":NaN}', '{"a":[Infinity]}', '{"a":-Infinity}', '{"a":1} x', '{"a":1}{}', "[1]", "", "null", '{"a":01}', "{'a':1}", '{"a":"\t"}', '{"a":1,}', None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: (r.a is not None, r.b is not None) for r in d.select("i", strict.strict_object(F.col("t")).alias("a"), strict.strict_object(F.col("t"), unique=True).alias("b")).collect()}
    for i, r in enumerate(rows):
        try:
            ok = isinstance(json.loads(r, parse_constant=lambda x: 1 / 0), dict)
        except (ValueError, TypeError, ZeroDivisionError):
            ok = False
        assert got[i] == (ok, ok and i not in (2, 3)), r


def test_jsonl(spark, tmp_path):
    root = _put(tmp_path / "a", {"x.jsonl": '{"k":1,"s":"a"}\n{"k":2,"s":null}\n', "y.jsonl": '{"k":3}', "z.jsonl": "", "other.txt": "no"})
    read = lambda **o: strict.read_jsonl(spark, root, "k int, s string", **o)
    assert {(r.file, r.k, r.s) for r in read().collect()} == {("x.jsonl", 1, "a"), ("x.jsonl", 2, None), ("y.jsonl", 3, None)}
    for o, message in (({"max_files": 1}, "2 files"), ({"max_file": 20}, "file byte limit"), ({"max_total": 35}, "total byte limit"), ({"max_records": 1}, "record limit")):
        with pytest.raises(ValueError, match=message):
            read(**o)
    for bad in ('{"k":1}\n\n{"k":2}', "[1]\n", '{"k":NaN}', '{"k":"text"}', b'{"s":"\xff"}', '{"k":1} 2'):
        with pytest.raises(Exception, match="(?i)strict UTF-8|MALFORMED|cannot be parsed"):
            strict.read_jsonl(spark, _put(tmp_path / hashlib.sha1(str(bad).encode()).hexdigest(), {"x.jsonl": bad}), "k int, s string").collect()


def test_arrays_and_registries(spark, tmp_path):
    root = _put(tmp_path, {"a.json": '[{"k":1},\n {"k":2}]', "b.json": '[{"k":1},3]', "c.json": '{"k":1}', "d.json": '[{"k":1,"z":2}]', "r.json": json.dumps({"me": "sha256:" + "a" * 64}), "bad.json": '{"me":"sha256:1"}', "empty.json": "[]"})
    assert [(r.pos, r.k) for r in strict.read_array(spark, f"{root}/a.json", "k int", ["k"]).orderBy("pos").collect()] == [(0, 1), (1, 2)]
    assert strict.read_array(spark, f"{root}/empty.json", "k int", ["k"]).count() == 0
    for n, message in (("b", "only JSON objects"), ("c", "JSON array"), ("d", "other keys")):
        with pytest.raises(Exception, match=message):
            strict.read_array(spark, f"{root}/{n}.json", "k int", ["k"]).collect()
    with pytest.raises(ValueError, match="file limit"):
        strict.read_array(spark, f"{root}/a.json", "k int", limit=5)
    assert [tuple(r) for r in strict.read_registry(spark, f"{root}/r.json").collect()] == [("me", "sha256:" + "a" * 64)]
    with pytest.raises(Exception, match="nonempty reviewer IDs"):
        strict.read_registry(spark, f"{root}/bad.json").collect()


def test_manifests_are_rows(spark, tmp_path):
    root = _put(tmp_path, {"experiment-manifest.json": '{"a":[1]}', "p/experiment-manifest.json": "[1]", "p/document-manifest.json": b'{"a":"\xff"}', "q/relationship-manifest.json": '{"a":"' + "x" * 200 + '"}', "q/other.json": "{}"})
    tree = spark.createDataFrame([("s/document-manifest.json", "SYMLINK"), ("experiment-manifest.json", "REGULAR_FILE")], "path string, object_type string")
    got = {r.path: (r.json, r.limitation) for r in strict.read_manifests(spark, root, limit=100, tree=tree).collect()}
    assert got == {"experiment-manifest.json": ('{"a":[1]}', None), "p/experiment-manifest.json": (None, "EXPERIMENT_MANIFEST_MALFORMED"), "p/document-manifest.json": (None, "DOCUMENT_MANIFEST_MALFORMED"),
                   "q/relationship-manifest.json": (None, "RELATIONSHIP_MANIFEST_SIZE_LIMIT"), "s/document-manifest.json": (None, "DOCUMENT_MANIFEST_UNAVAILABLE")}


def test_canonical_sink(spark, tmp_path):
    rows = [(i % 37, f"é{i % 50}\n", None if i % 3 else 1.5, [i, None]) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, s string, f double, a array<int>")
    first = canonical.write_canonical(d.repartition(7), str(tmp_path / "one"), ["k"], part_rows=120)
    second = canonical.write_canonical(d.orderBy(F.rand(1)).repartition(3), str(tmp_path / "two"), ["k"], part_rows=120)
    assert first == second and first["records"] == 500 and [f["records"] for f in first["files"]] == [120] * 4 + [20]
    want = b"".join(sorted((json.dumps(dict(zip("ksfa", r)), sort_keys=True, separators=(",", ":")).encode() + b"\n" for r in rows), key=lambda x: (json.loads(x)["k"], x)))
    got = b"".join((tmp_path / "one" / f["name"]).read_bytes() for f in first["files"])
    assert got == want and sorted(os.listdir(tmp_path / "one")) == ["manifest.json", *[f["name"] for f in first["files"]]]
    assert first["files"][0]["sha256"] == hashlib.sha256((tmp_path / "one" / "part-000000.jsonl").read_bytes()).hexdigest()
    with pytest.raises(FileExistsError):
        canonical.write_canonical(d, str(tmp_path / "one"), ["k"])
    assert canonical.read_canonical(spark, str(tmp_path / "one"), "k int, s string, f double, a array<int>").count() == 500
    with open(tmp_path / "two" / "part-000001.jsonl", "ab") as f:
        f.write(b"{}\n")
    with pytest.raises(ValueError, match="CHANGED"):
        canonical.read_canonical(spark, str(tmp_path / "two"), "k int")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    d = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).cast("string").alias("x"))
    with pytest.raises(Exception, match="stop"):
        canonical.write_canonical(d, str(tmp_path / "x"), ["id"])
    assert not os.path.exists(tmp_path / "x")
    assert canonical.write_canonical(d.limit(0), str(tmp_path / "x"), ["id"]) == {"files": [], "records": 0}


def test_a_graph_in_parts(spark, tmp_path):
    rows = [(f"#e/{i:03d}é", json.dumps({"@id": f"#e/{i:03d}é", "n": i}, sort_keys=True, separators=(",", ":"))) for i in range(57)]
    root = {"@id": "./", "name": "n", "about": 1}
    for name, some, parts in (("a", rows, 10), ("b", rows, 1000), ("none", [], 10)):
        d = spark.createDataFrame(some, "id string, json string").repartition(3)
        canonical.write_graph(d, str(tmp_path / name), "c", {"@id": "d"}, root, part_rows=parts)
        canonical.join_parts(str(tmp_path / name), str(tmp_path / f"{name}.json"))
        want = {"@context": "c", "@graph": [{"@id": "d"}, {**root, "hasPart": [{"@id": i} for i, _ in some]}, *[json.loads(j) for _, j in some]]}
        assert (tmp_path / f"{name}.json").read_text() == json.dumps(want, sort_keys=True, separators=(",", ":"))
    with pytest.raises(FileExistsError):
        canonical.join_parts(str(tmp_path / "a"), str(tmp_path / "a.json"))


def test_plain_rows_are_written_without_parsing_and_dealt_first(spark, tmp_path, monkeypatch):
    rows = [(i, None if i % 5 == 0 else f"é\U0001f600\x7f  \\u001B \x1b\x0b\"{i}\t/", i % 2 == 0, None if i % 3 else -i) for i in range(60)]
    d = spark.createDataFrame(rows, "k long, t string, b boolean, n int").coalesce(1)
    monkeypatch.setattr(canonical, "canonical_json", None)  # documents of other types only
    seen, keep = [], canonical.kept
    monkeypatch.setattr(canonical, "kept", lambda lines: (seen.append(lines), keep(lines))[1])
    whole = canonical.write_canonical(d, str(tmp_path / "x"), ["k"], part_rows=25)
    got = b"".join((tmp_path / "x" / f["name"]).read_bytes() for f in whole["files"])
    assert got == b"".join(json.dumps(dict(zip("ktbn", r)), sort_keys=True, separators=(",", ":")).encode() + b"\n" for r in rows)
    assert "RepartitionByExpression" in seen[0]._jdf.queryExecution().optimizedPlan().toString()  # a file of one block is read by one task
