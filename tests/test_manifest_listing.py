"""Manifests are found by tasks at any depth, their names never held by the driver."""

import os

from curalis.sources import strict

NAME = "document-manifest.json"


def test_manifests_are_listed_by_tasks(spark, tmp_path):
    for i, d in enumerate(["", "a", "a/b", "a/b/c/d", "x y/é%20", "_hidden", ".h", "_k=1", "e"]):
        os.makedirs(tmp_path / d, exist_ok=True)
        if d != "e":
            (tmp_path / d / NAME).write_text('{"i":%d}' % i)
        (tmp_path / d / "other.json").write_text("{}")
    os.makedirs(tmp_path / "dir" / NAME)
    (tmp_path / "dir" / NAME / NAME).write_bytes(b"x" * 100)
    os.mkfifo(tmp_path / "e" / NAME)
    os.symlink("gone", tmp_path / "e" / "experiment-manifest.json")
    os.symlink(tmp_path / "a" / NAME, tmp_path / "e" / "relationship-manifest.json")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        r = strict.read_manifests(spark, root, limit=50)
        assert "binaryFile" not in r._jdf.queryExecution().optimizedPlan().toString()
        got = {x.path: (x.json, x.limitation) for x in r.collect()}
        want = {f"{d}/{NAME}".lstrip("/"): ('{"i":%d}' % i, None) for i, d in enumerate(["", "a", "a/b", "a/b/c/d", "x y/é%20"])} | {f"_k=1/{NAME}": ('{"i":7}', None), f"dir/{NAME}/{NAME}": (None, "DOCUMENT_MANIFEST_SIZE_LIMIT"), "e/relationship-manifest.json": ('{"i":1}', None)}
        assert got == want


def test_an_empty_folder_has_no_manifests(spark, tmp_path):
    assert strict.read_manifests(spark, str(tmp_path)).count() == 0
