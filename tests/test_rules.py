import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from curalis.functions import columns as C
from curalis.operators import graphs as G
from curalis.operators import approvals, ledgers, observers, relationships
from curalis.plans.bindings import query


def test_folding_is_full(spark):
    letters = [chr(k) for k in range(1, 0x20000) if unicodedata.category(chr(k)) not in ("Cn", "Cs")]  # Spark knows some letters that Python does not
    words = ["".join(letters[i : i + 40]) for i in range(0, len(letters), 40)] + ["Straße", "ᾳ ᾈ", "Σίσυφος", "ΐ", "ﬃ", "İstanbul", "ﬗ", "", "plain"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", C.casefold(F.col("w")).alias("f")).orderBy("i").collect()]
    wrong = [(a, b, g) for w, g in zip(words, got) for a, b, g in [(w, w.casefold(), g)] if b != g]
    assert wrong == []


def _chain(rows):
    return [(p, s, prev, own, own) for p, s, prev, own in rows]


def test_chains_begin_at_zero(spark):
    z = ledgers.ZERO
    rows = [("ok", 1, z, "a"), ("ok", 2, "a", "b"), ("free", 1, None, "a"), ("gap", 1, z, "a"), ("gap", 3, "a", "b"), ("twice", 1, z, "a"), ("twice", 2, "a", "b"), ("twice", 2, "a", "c"), ("late", 2, z, "a"), ("false", 1, z, "a"), ("false", 2, "x", "b"), ("hole", 1, z, "a"), ("hole", 2, "a", "b"), ("hole", 2, "a", "b"), ("hole", 4, "b", "c")]
    d = spark.createDataFrame(_chain(rows), "p string, s int, prev string, own string, h string")
    got = {r.p: (r.events, r.contiguous, r.linked, r.hashed) for r in ledgers.verify_chain(d, "p", "s", "prev", "own", F.col("h")).collect()}
    assert got == {"ok": (2, True, True, True), "free": (1, True, False, True), "gap": (2, False, False, True), "twice": (3, False, True, True), "late": (1, False, False, True), "false": (2, True, False, True), "hole": (4, False, False, True)}
    assert ledgers.verify_chain(d.filter("p = 'free'"), "p", "s", "prev", "own", F.col("h"), genesis=None).first().linked


@pytest.mark.parametrize("path, kind, family", [("data/x.dvc", "REGULAR_FILE", "DVC"), ("data/x.dvc", "DIRECTORY", None), ("a/b/Snakefile", "REGULAR_FILE", "SNAKEMAKE"), ("mlproject", "REGULAR_FILE", "MLFLOW"), ("x/MLproject", "REGULAR_FILE", None), (".noworkflow/db", "REGULAR_FILE", "NOWORKFLOW"), ("CITATION.cff", "SYMLINK", None), ("codemeta.json", "REGULAR_FILE", "CODEMETA"), ("x", "REGULAR_FILE", None)])
def test_families(spark, path, kind, family):
    assert spark.createDataFrame([(path, kind)], "p string, k string").select(observers.declaration_family(F.col("p"), F.col("k"))).first()[0] == family


def test_states_of_files_and_links_alone(spark):
    a = spark.createDataFrame([("d", "DIRECTORY"), ("d/f", "REGULAR_FILE"), ("l", "SYMLINK")], "path string, object_type string")
    t = spark.createDataFrame([("l",)], "path string")
    s = spark.createDataFrame([("d/", "!!")], "path string, code string")
    got = {r.path: (r.tracked, r.ignored_included, r.index_status) for r in relationships.overlay_status(a, t, s).collect()}
    assert got == {"d": (None, None, None), "d/f": (False, True, "!!"), "l": (True, False, None)}


def test_cuts_are_said(spark):
    o = spark.createDataFrame([("b", i, "p") for i in range(5)], "blob string, commit_id int, path string")
    b = spark.createDataFrame([("b", "token=x")], "blob string, text string")
    assert {r.limitation for r in observers.history_findings(o, b, C.secret_categories, most=5).collect()} == {None}
    cut = observers.history_findings(o, b, C.secret_categories, most=4).collect()
    assert len(cut) == 4 and {r.limitation for r in cut} == {"GIT_SECRET_HISTORY_FINDING_LIMIT"}
    p = spark.createDataFrame([(f"mlruns/1/r{i}/params/x",) for i in range(4)] + [("other/mlruns/1/2/params/x",)], "path string")
    assert observers.mlflow_counts(p, 4).first().limitations == observers.MLFLOW_LIMITS and observers.mlflow_counts(p, 4).first().parameters == 4
    assert observers.mlflow_counts(p, 3).first().limitations[0] == "ADAPTER_RECORD_LIMIT" and observers.mlflow_counts(p, 3).first().runs == 3
    assert observers.mlflow_counts(p.limit(0), 3).count() == 0


def test_crates_are_found_wanting(spark):
    def crate(root, *more):
        return json.dumps({"@context": "c", "@graph": [{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}}, {"@id": "./", "@type": "Dataset", **root}, {"@id": "prof"}, *more]})

    good = {"run": False, "v": "1", "conformsTo": [{"@id": "prof"}]}
    rows = {"good": crate(good), "true": crate({**good, "run": True}), "none": crate({}), "text": crate({**good, "v": 1, "conformsTo": "prof"}), "gone": crate({**good, "p": {"@id": "gone"}}), "twice": crate({}, {"@id": "./"}), "long": crate(good, *[{"@id": f"e{i}"} for i in range(300)], {"@id": "./"}), "no": "[]"}
    d = spark.createDataFrame(list(rows.items()), "graph string, json string")
    got = {r.graph: (r.status, r.findings) for r in G.crate_findings(d, "run", "v", "1", "prof").collect()}
    assert got == {"good": ("BOUNDED_PROFILE_CONFORMANT", []), "true": ("NONCONFORMANT", [G.AUTHORITY]), "none": ("NONCONFORMANT", [G.PROFILE, G.AUTHORITY, G.SCHEMA]), "text": ("NONCONFORMANT", [G.PROFILE, G.SCHEMA]), "gone": ("NONCONFORMANT", ["LOCAL_REFERENCE_UNRESOLVED"]),
                   "twice": ("NONCONFORMANT", ["RO_CRATE_DUPLICATE_ENTITY_ID"]), "long": ("INCOMPLETE", []), "no": ("NONCONFORMANT", ["RO_CRATE_GRAPH_SHAPE_INVALID"])}


def test_a_name_is_registered_once():
    with pytest.raises(ValueError, match="two queries"):
        query("s044_exact_duplicate_groups")(lambda t: t)


def test_too_few_cases_fail(spark):
    e = spark.createDataFrame([("r", f"p{i}", f"a{i}", f"c{i % 3}") for i in range(6)], "source string, path string, artifact_id string, content_id string")
    d = spark.createDataFrame([("r", "x_1")], "source string, relationship_id string")
    some = lambda each, without: approvals.selected_cases(e, d, "source", each, 1, 1, without, "none")
    assert some(5, 2).count() == 6 + 2 + 1 + 2
    with pytest.raises(Exception, match="insufficient eligible inventory for r"):
        some(6, 2).collect()
    with pytest.raises(Exception, match="insufficient nonmatch controls for r"):
        some(5, 4).collect()
