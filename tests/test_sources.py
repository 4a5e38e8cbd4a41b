import hashlib
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from curalis.operators import scans
from curalis.sources import archives, trees


@pytest.fixture
def root(tmp_path):
    for d in ("a/deep/er", "wide", ".git", "sub/.git", "venv/lib", "empty"):
        os.makedirs(tmp_path / d)
    for f in ("a/x", "a/deep/y", "a/deep/er/z", "wide/1", "wide/2", "wide/3", ".git/HEAD", "sub/.git/HEAD", "sub/in", "venv/pyvenv.cfg", "venv/lib/p.py", "top"):
        (tmp_path / f).write_bytes(f.encode() * 3)
    (tmp_path / ".skip").mkdir()
    (tmp_path / ".skip/hidden").write_bytes(b"1")
    os.symlink("a/x", tmp_path / "link")
    os.symlink("../../out", tmp_path / "a/out")
    os.mkfifo(tmp_path / "pipe")
    with open(os.path.join(os.fsencode(tmp_path), b"bad\xff"), "wb") as f:
        f.write(b"raw")
    return str(tmp_path)


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_tree_equals_a_walk(spark, root, slices):
    got = {bytes(r.path_bytes): r for r in trees.read_tree(spark, root, max_entries=20, exclude=".skip", slices=slices).collect()}
    want = {b"."}
    for top, dirs, files in os.walk(os.fsencode(root)):
        rel = os.path.relpath(top, os.fsencode(root))
        if rel == b".":
            dirs.remove(b".skip")
        want |= {os.path.normpath(os.path.join(rel, n)) for n in dirs + files}
    assert set(got) == want
    assert got[b"bad\xff"].path == "bad\\xff" and got[b"link"].symlink_target_text == "a/x" and got[b"link"].object_type == "SYMLINK"
    assert (got[b"pipe"].object_type, got[b"pipe"].warnings) == ("SPECIAL_FILE", ["SPECIAL_FILE_NOT_READ"])
    assert got[b"a/deep/y"].size_bytes == 24 and got[b"."].object_type == "DIRECTORY"


def test_tree_bounds(spark, root):
    got = {r.path: r for r in trees.read_tree(spark, root, max_entries=2, slices=2).collect()}
    assert set(got) == {"."} and got["."].warnings == ["DIRECTORY_ENTRY_LIMIT"]
    got = {r.path: r for r in trees.read_tree(spark, root, max_depth=2, slices=50).collect()}
    assert got["a/deep"].warnings == ["INVENTORY_DEPTH_LIMIT"] and "a/deep/y" not in got and "a/x" in got
    some = trees.read_tree(spark, root, prefix="a/", object_types="REGULAR_FILE,SYMLINK").collect()
    assert {r.path for r in some} == {"a/x", "a/deep/y", "a/deep/er/z", "a/out"}


def test_rules_run_on_a_scanned_tree(spark, root):
    t = trees.read_tree(spark, root)
    b = {r.path: r.warning for r in scans.boundaries(t).collect()}
    assert b[".git"] == "PROTECTED_GIT_CONTROL" and b["sub"] == b["sub/.git"] == "NESTED_REPOSITORY_BOUNDARY" and b["venv"] == "PYTHON_VIRTUAL_ENVIRONMENT_BOUNDARY_NOT_RECURSED"
    assert not {"sub/in", "venv/lib", "venv/lib/p.py", ".git/HEAD"} & set(b)
    links = t.filter("object_type = 'SYMLINK'").select("path", F.col("symlink_target_text").alias("target"))
    assert {r.path: r.warning for r in scans.link_warnings(links, t).collect()} == {"link": None, "a/out": "SYMLINK_TARGET_OUTSIDE_ROOT"}


def test_scan_hashes_under_budgets(spark, root):
    got = {r.path: r for r in trees.scan(spark, root, max_file=30, max_total=40, exclude=".skip").collect()}
    assert got["a/deep/er/z"].limitation == "CONTENT_HASH_SKIPPED_SIZE_LIMIT" and got["sub/.git/HEAD"].limitation == "CONTENT_HASH_SKIPPED_SIZE_LIMIT"
    assert got[".git/HEAD"].content_id == "sha256-file-v1:" + hashlib.sha256(b".git/HEAD" * 3).hexdigest()
    assert got["a/deep/y"].limitation == "CONTENT_HASH_SKIPPED_TOTAL_BYTES_LIMIT" and got["a/x"].content_id and got["bad\\xff"].content_id is not None
    assert got["link"].content_id is None and got["link"].limitation is None
    listed = trees.read_tree(spark, root, object_types="REGULAR_FILE").withColumn("limitation", F.lit(None).cast("string")).withColumn("size_bytes", F.col("size_bytes") - 1)
    assert {r.limitation for r in trees.hashed(listed, root).collect()} == {"ARTIFACT_CHANGED_DURING_INVENTORY"}


def _zip(names, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **more) as z:
        for n, b in names:
            z.writestr(zipfile.ZipInfo(n), b)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = _zip([("b", "22"), ("a/é.txt", "1")])
    many = _zip([(f"{'n' * 200}{i}", "") for i in range(6000)])
    files = {"good": good, "late": b"PK\x03\x04junk" + good, "cut": good[:-3], "none": _zip([]), "text": b"no archive", "tiny": b"PK\x03\x04", "rar": b"Rar!\x1a\x07\x01", "commented": good, "many": many, "evil": _zip([("x/../../y", "")]), "seven": b"7z\xbc\xaf\x27\x1c..", "odd": good[:-22].replace(b"PK\x01\x02", b"PK\x01\x03") + good[-22:]}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    rows = archives.read_archives(spark, str(tmp_path))
    got = {r.archive: r for r in archives.observations(rows).collect()}
    assert set(got) == set(files) - {"text"}
    assert {n: got[n].limitation for n in got} == {"good": None, "late": None, "cut": "ARCHIVE_MALFORMED", "none": None, "tiny": "ARCHIVE_MALFORMED", "rar": "UNSUPPORTED_FORMAT", "commented": None, "many": "RESOURCE_LIMIT_REACHED", "evil": "ARCHIVE_PATH_UNSAFE", "seven": "UNSUPPORTED_FORMAT", "odd": "ARCHIVE_MALFORMED"}
    assert got["good"].member_manifest_id == got["late"].member_manifest_id and (got["good"].member_count, got["none"].member_count) == (2, 0)
    m = {r.name: (r.ordinal, r.file_size) for r in rows.filter("archive = 'good'").collect()}
    assert m == {i.filename: (k, i.file_size) for k, i in enumerate(zipfile.ZipFile(io.BytesIO(good)).infolist())}
