import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from curalis import registry
from curalis.functions import columns as C
from curalis.operators import budgets, decisions, duplicates, evaluation, ledgers, relationships, snapshots
from curalis.sources import records

DATA = "/root/testdata/sf0.001"


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "N"
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, oracle, name):
    got = registry.queries()[name](spark, DATA)
    want = oracle.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    w = sorted(tuple(map(_plain, r)) for r in want.fetchall())
    assert sorted(tuple(map(_plain, (r[c] for c in cols))) for r in got.collect()) == w


def test_greedy_budget_skips_and_goes_on(spark):
    d = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("b", 1, 101)], "p string, k int, n int")
    assert {(r.p, r.k) for r in budgets.greedy_budget(d, "p", "k", "n", 100).collect()} == {("a", 1), ("a", 3)}


def test_near_pairs_share_five_of_seven(spark):
    d = spark.createDataFrame([("1", "a.txt", 30, "x", "one two three four five six"), ("2", "b.txt", 30, "y", "one two three four five seven"), ("3", "c.txt", 30, "z", "other words are here now yes")], "artifact_id string, path string, size_bytes long, content_id string, text string")
    r = duplicates.near_pairs(d).collect()
    assert [(x.left_id, x.right_id, x.similarity) for x in r] == [("1", "2", 0.714286)]


def test_metrics_golden(spark):
    c = [("ASSERTED", ["SUPPORTED"] * 2), ("ASSERTED", ["UNSUPPORTED"] * 2), ("ABSTAINED", ["SUPPORTED"] * 2), ("UNRESOLVED", ["SUPPORTED", "UNSUPPORTED"]), ("ASSERTED", ["SUPPORTED"])]
    r = evaluation.slice_metrics(spark.createDataFrame([("k", p, l) for p, l in c], "k string, prediction string, labels array<string>"), ["k"]).first()
    assert (r.candidates, r.consensus, r.disagreement, r.unreviewed) == (5, 3, 1, 1)
    assert (r.precision, r.recall, r.coverage, r.abstention, r.unresolved) == (0.5, 0.5, 0.6, 0.2, 0.2)


def test_risk_coverage_golden(spark):
    c = [("ASSERTED", "HIGH", ["SUPPORTED"] * 2), ("ASSERTED", "MEDIUM", ["UNSUPPORTED"] * 2), ("ABSTAINED", "LOW", ["SUPPORTED"] * 2)]
    d = spark.createDataFrame([("k", p, f, l) for p, f, l in c], "k string, prediction string, confidence string, labels array<string>")
    r = {x.threshold: (x.accepted, x.coverage, x.selective_risk) for x in evaluation.risk_coverage(d, ["k"]).collect()}
    assert r == {"HIGH": (1, 0.333333333333, 0.0), "MEDIUM": (2, 0.666666666667, 0.5), "LOW": (2, 0.666666666667, 0.5)}


def test_snapshot_golden(spark):
    a = spark.createDataFrame([("old.py", "1"), ("current.py", "2"), ("moved.py", "3"), ("n", None)], "path string, content_id string")
    b = spark.createDataFrame([("new.py", "4"), ("current.py", "5"), ("renamed.py", "3"), ("n", None)], "path string, content_id string")
    assert {(r.change, r.n) for r in snapshots.summarize(a, b).collect()} == {("ADDED", 1), ("REMOVED", 1), ("CHANGED", 1), ("MOVED", 1)}


def test_scalars(spark):
    d = spark.createDataFrame([("a/.env", "token=abc x"), ("a/b.tar.gz", "-----BEGIN RSA PRIVATE KEY-----\nq\n-----END RSA PRIVATE KEY-----")], "path string, text string")
    r = d.select(C.suffix(F.col("path")).alias("s"), C.redact(F.col("text")).alias("t"), C.secret_categories(F.col("text")).alias("c")).collect()
    assert [tuple(x) for x in r] == [("", "[REDACTED:TOKEN] x", ["TOKEN"]), (".gz", "[REDACTED:PRIVATE_KEY]", ["PRIVATE_KEY"])]


def test_records_are_published_whole(spark, tmp_path):
    d = spark.createDataFrame([("x", 1)], "a string, b int")
    records.write_records(d, f"file://{tmp_path}/out")
    assert records.read_jsonl(spark, f"file://{tmp_path}/out", d.schema).collect() == d.collect()
    with pytest.raises(FileExistsError):
        records.write_records(d, f"file://{tmp_path}/out")
    assert records.read_tree(spark, f"{tmp_path}/out").filter("path like '%.json'").count() == 1


EMPTY = {"mainline": "artifact_id string, ordinal int, status string, support array<string>, counter array<string>, uncertainty array<string>", "roles": "artifact_id string, ordinal int, role string, support array<string>, limits array<string>",
         "attempts": "path string, ordinal int, result string, support array<string>, limits array<string>", "candidates": "path string", "comparisons": "left_path string, right_path string, subtype string", "members": "artifact_id string, bundle string, completeness string",
         "duplicates": "artifact_id string, support array<string>", "declarations": "artifact_id string, support array<string>, limits array<string>"}


def _decide(spark, inventory, **tables):
    frames = {k: spark.createDataFrame(tables.get(k, []), v) for k, v in EMPTY.items()}
    inv = spark.createDataFrame([(x, x, k, w) for x, k, w in inventory], "artifact_id string, path string, object_type string, warnings array<string>")
    c = decisions.classify(decisions.fan_in(inv, **frames))
    return {r.artifact_id: (r.state, r.recommendation, r.limitations) for r in decisions.recommend(c).collect()}


def test_guards_leave_an_artifact_unresolved(spark):
    names = "role document warning intent bundle".split()
    active = [(n, 1, "ACTIVE_MAINLINE", ["m"], [], []) for n in names if n != "intent"] + [("intent", 1, "UNRESOLVED", [], ["c"], [])]
    got = _decide(
        spark, [(n, "REGULAR_FILE", ["CASE_COLLISION"] if n == "warning" else []) for n in names], mainline=active, roles=[("role", 1, "HISTORICAL_EVIDENCE", ["r"], [])], comparisons=[("document", "x", "DO_NOT_MERGE")],
        members=[("bundle", "b1", "MISSING_REQUIRED_LINK")], attempts=[("intent", 1, "ACCEPTED", ["a"], [])])
    why = {"role": "MATERIAL_ROLE_CONFLICT", "document": "MATERIAL_DOCUMENT_CONFLICT", "warning": "INVENTORY_COVERAGE_LIMITATION", "intent": "MATERIAL_INTENT_CONFLICT", "bundle": "BUNDLE_MOVEMENT_GUARD"}
    for n in names:
        assert got[n][:2] == ("UNRESOLVED", "MANUAL_REVIEW") and why[n] in got[n][2]


def test_duplicates_are_reviewed_but_not_under_a_guard(spark):
    names = ["plain", "conflict", "roles"]
    got = _decide(
        spark, [(n, "REGULAR_FILE", []) for n in names], duplicates=[(n, ["d"]) for n in names], comparisons=[("conflict", "x", "DO_NOT_MERGE")],
        mainline=[("roles", 1, "ACTIVE_MAINLINE", ["m"], [], [])], roles=[("roles", 1, "HISTORICAL_EVIDENCE", ["r"], [])])
    assert [got[n][:2] for n in names] == [("EXACT_DUPLICATE_REVIEW", "REVIEW_EXACT_DUPLICATE"), ("UNRESOLVED", "MANUAL_REVIEW"), ("EXACT_DUPLICATE_REVIEW", "REVIEW_EXACT_DUPLICATE")]


def test_absence_alone_keeps_and_bundles_do_not_move(spark):
    got = _decide(
        spark, [("none", "REGULAR_FILE", []), ("bare", "REGULAR_FILE", []), ("old", "REGULAR_FILE", []), ("bound", "REGULAR_FILE", []), ("dir", "DIRECTORY", []), ("link", "SYMLINK", [])],
        mainline=[("none", 1, "UNRESOLVED", [], [], ["NO_MAINLINE_EVIDENCE"])] + [(n, 1, "HISTORICAL_EVIDENCE", ["m"], [], []) for n in ("old", "bound")], roles=[("none", 1, "UNRESOLVED", [], ["NO_ROLE_EVIDENCE"])], members=[("bound", "b2", "COMPLETE_IN_ANALYZED_SCOPE")])
    assert {k: v[:2] for k, v in got.items()} == {"none": ("UNRESOLVED", "KEEP"), "bare": ("UNRESOLVED", "MANUAL_REVIEW"), "old": ("HISTORICAL_EVIDENCE", "ARCHIVE"), "bound": ("HISTORICAL_EVIDENCE", "MANUAL_REVIEW"), "dir": ("PROTECTED", "KEEP"), "link": ("UNRESOLVED", "MANUAL_REVIEW")}
    assert "BUNDLE_GUARD:b2" in got["bound"][2] and "NO_CLASSIFICATION_EVIDENCE" in got["bare"][2]


def test_later_declarations_replace_earlier_ones(spark):
    got = _decide(spark, [("a", "REGULAR_FILE", [])], attempts=[("a", 1, "FAILED", ["x"], []), ("a", 2, "ACCEPTED", ["y"], [])])
    assert got["a"][0] == "EXPERIMENTAL_ACTIVE"


def test_transitions_golden(spark):
    t = lambda x: spark.createDataFrame(x, "path string, status string")
    a = t([("README.md", "UNRESOLVED"), ("a", "UNRESOLVED"), ("b", "REQUIRED"), ("c", "REQUIRED"), ("d", None), ("gone", "UNRESOLVED")])
    b = t([("README.md", "UNRESOLVED"), ("a", "ACTIVE_MAINLINE"), ("b", "UNRESOLVED"), ("c", "ACTIVE_MAINLINE"), ("d", None), ("new", "UNRESOLVED")])
    assert {tuple(r) for r in snapshots.status_transitions(a, b).collect()} == {("README.md", "STILL_UNRESOLVED"), ("a", "NEWLY_LINKED"), ("b", "NEWLY_CONFLICTING"), ("d", "STILL_UNRESOLVED")}


def test_gates_golden(spark):
    case = "case_id long, claim_type string, confidence string, language string, prediction string, repository_type string, labels array<string>, repository_id string, repository_family string"
    rows = [(i, "exact_byte_duplicate", None, "py", "UNRESOLVED" if i % 5 == 0 else "ASSERTED", "lib", ["UNSUPPORTED" if i % 5 == 0 else "SUPPORTED"] * 2, f"r{i % 6}", f"f{i % 3}") for i in range(1200)]
    rows += [(5000 + i, "capability_family", "HIGH" if i % 2 else "LOW", "py", "ASSERTED", "lib", ["SUPPORTED" if i % 2 else "UNSUPPORTED"] * 2, f"r{i % 7}", f"f{i % 3}") for i in range(400)]
    rows += [(9000 + i, "change_episode", "STRONG", "py", "ASSERTED", "lib", ["SUPPORTED"] * 2, "r1", "f1") for i in range(200)]
    v2 = spark.createDataFrame(rows, case)
    c = evaluation.normalize_cases(v2.limit(0), v2)
    got = {r.gate: (r.status, r.reason) for r in evaluation.metric_gates(c).collect()}
    assert got == {"inventory-recall": ("BLOCKED", "NO_REVIEWED_CASES"), "exact-byte-duplicate-precision": ("PASSED", None), "capability-family-high-precision": ("PASSED", None), "change-episode-strong-precision": ("BLOCKED", "INSUFFICIENT_REPOSITORY_DIVERSITY")}
    first = {r.gate: r.reason for r in evaluation.metric_gates(evaluation.normalize_cases(v2, v2.limit(0))).collect()}
    assert first["exact-byte-duplicate-precision"] == "INSUFFICIENT_REPOSITORY_DIVERSITY"
    with pytest.raises(Exception, match="EVALUATION_CASE_DUPLICATE"):
        evaluation.unique_cases(c.union(c)).collect()
    m = spark.createDataFrame([("x", "ARCHIVE", True, False), ("x", "ARCHIVE", True, False)], "candidate_id string, operation_class string, invariants_passed boolean, unsafe_false_positive boolean")
    none = spark.createDataFrame([], "candidate_id string, operation_class string, outcome string, invariants array<string>, repository_id string, repository_family string")
    with pytest.raises(Exception, match="EVALUATION_RISK_CASE_DUPLICATE"):
        evaluation.mutation_gates(evaluation.normalize_mutations(m, none)).collect()
    v1 = spark.createDataFrame([(f"c{i}", "ARCHIVE", True, False) for i in range(2999)], m.schema)
    assert {r.gate: (r.status, r.reason) for r in evaluation.mutation_gates(evaluation.normalize_mutations(v1, none)).collect()} == {"mutation-risk-corpus:ARCHIVE": ("BLOCKED", "INSUFFICIENT_REPOSITORY_DIVERSITY"), "mutation-risk-corpus:QUARANTINE": ("BLOCKED", "NO_RISK_CASES")}


def test_dense_ids_over_many_partitions_and_wide_rows(spark):
    d = spark.range(30_000).select(F.concat(F.lit("k"), F.sha1(F.col("id").cast("string"))).alias("k"), F.repeat(F.lit("x"), F.lit(400)).alias("wide")).repartition(40)
    got = duplicates.dense_ids(d, ["k"], "n", "ev_").select("k", "n").collect()
    assert sorted(got, key=lambda r: r.n) == sorted(got, key=lambda r: r.k) and [r.n for r in sorted(got, key=lambda r: r.n)] == [f"ev_{i:08d}" for i in range(30_000)]


def test_deep_trees_keep_all_levels(spark):
    import hashlib
    import json

    some = [("é/g", "REGULAR_FILE", "sha256-file-v1:2", True, None, []), ("bad/h", "REGULAR_FILE", None, False, None, ["RESOURCE_LIMIT_REACHED"]), ("p/q/r/s/f", "REGULAR_FILE", "sha256-file-v1:1", False, None, [])]
    dirs = {p for f in some for k in range(f[0].count("/")) for p in ["/".join(f[0].split("/")[: k + 1])]} | {".", "empty"}
    nodes = spark.createDataFrame(some + [(d, "DIRECTORY", None, True, None, []) for d in dirs], "path string, object_type string, content_id string, executable boolean, symlink_target_text string, warnings array<string>")
    got = {r.path: (r.content_id, r.warnings) for r in ledgers.merkle_directories(nodes).collect()}
    kids, ids = {}, {f[0]: f[2] for f in some}
    for p in set(ids) | dirs - {"."}:
        kids.setdefault(p.rsplit("/", 1)[0] if "/" in p else ".", []).append(p)
    for d in sorted(dirs - {"."}, key=lambda x: -x.count("/")) + ["."]:
        own = sorted(kids.get(d, []), key=lambda x: x.rsplit("/", 1)[-1].encode())
        ok = all(ids[c] for c in own)
        m = [{"content_id": ids[c], "executable": c in dirs or c == "é/g", "name": c.rsplit("/", 1)[-1], "object_type": "DIRECTORY" if c in dirs else "REGULAR_FILE", "symlink_target_text": None} for c in own]
        ids[d] = "merkle-dir-v1:" + hashlib.sha256(json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest() if ok else None
        assert got[d] == (ids[d], [] if ok else ["RESOURCE_LIMIT_REACHED"])


def test_json_and_folding_follow_the_language(spark):
    import json

    texts = ["plain", 'q"\\/', "é漢😀", "a\nb\tc", "", "Straße ΣΑΣ ς ﬁ Ǆ ſ K İ ẞ"]
    r = spark.createDataFrame([(x,) for x in texts], "x string").select("x", C.json_string(F.col("x")).alias("j"), C.casefold(F.col("x")).alias("c"), C.collision_key(F.col("x")).alias("k")).collect()
    import unicodedata

    assert all(v.j == json.dumps(v.x) and v.c == v.x.casefold() and v.k == unicodedata.normalize("NFC", v.x).casefold() for v in r)


def test_controls_are_the_greedy_pairs(spark):
    import random

    from curalis.operators import observers

    rng = random.Random(4)
    rows = [(f"s{p}", f"a{i:03d}", f"c{rng.choice([0, 0, 0, 1, 2, 3])}") for p in range(6) for i in range(rng.randrange(1, 40))]
    want = set()
    for p in {r[0] for r in rows}:
        own, used, n = sorted(r[1:] for r in rows if r[0] == p), set(), 0
        for i, (a, c) in enumerate(own):
            for b, d in own[i + 1 :]:
                if n < 5 and a not in used and b not in used and c != d:
                    want.add((p, a, b))
                    used |= {a, b}
                    n += 1
    assert {tuple(r) for r in observers.controls(spark.createDataFrame(rows, "source string, artifact_id string, content_id string"), "source", 5).collect()} == want


def test_bundle_with_a_missing_member(spark):
    m = relationships.resolve_members(spark.createDataFrame([("b", "x"), ("b", "y")], "bundle string, path string"), spark.createDataFrame([("x", "1")], "path string, artifact_id string"), "path")
    assert relationships.bundle_completeness(m, "bundle").first().completeness == "INCOMPLETE"
