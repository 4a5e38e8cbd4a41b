"""Crates are read whole, once, in their rows: no entity or type behind a bound is lost."""

import json

import pytest

from curalis import registry
from curalis.operators import crates, graphs


def test_no_entity_is_cut(spark):
    files = [{"@id": f"f{i:04d}", "@type": "File"} for i in range(600)]
    kinds = [f"A{i:02d}" for i in range(40)]
    late = [{"@id": "ro-crate-metadata.json", "@type": [*kinds, "CreativeWork"], "about": {"@id": "./"}}, {"@id": "./", "@type": [*kinds, "Dataset"]},
            {"@id": "#a", "@type": "https://schema.org/CreateAction", "actionStatus": {"@id": "http://schema.org/FailedActionStatus"}, "object": [{"@id": "f0599"}, {"@id": "gone"}, 5, None], "result": {"@id": "f0001"}}]
    rows = [("late", json.dumps({"@context": 1, "@graph": files + late})), ("again", json.dumps({"@context": 1, "@graph": files + files[:1] + late})), ("none", None), ("list", "[]"), ("twice", '{"@context":1,"@graph":[],"@graph":[]}')]
    c = graphs.read_crates(spark.createDataFrame(rows, "graph string, json string"))
    assert {r.graph: tuple(r)[1:] for r in crates.roots(c).collect()} == {"late": ("ro-crate-metadata.json", "./", None), "again": ("ro-crate-metadata.json", "./", None), **{k: (None, None, "RO_CRATE_DESCRIPTOR_MISSING") for k in ("none", "list", "twice")}}
    a = {r.graph: r for r in crates.actions(c).collect()}
    assert set(a) == {"late", "again"} and (a["late"].action_id, a["late"].status) == ("#a", "FAILED_DECLARED")
    assert (a["late"].input_ids, a["late"].unresolved_input_ids, a["late"].malformed_input_count, a["late"].output_ids, a["late"].unresolved_output_ids) == (["f0599", "gone"], ["gone"], 2, ["f0001"], [])
    s = {r.graph: tuple(r)[1:] for r in crates.action_summary(c).collect()}
    assert s["late"] == ("OBSERVED_WITH_LIMITATIONS", 1, 0, ["WORKFLOW_RUN_ACTION_INPUT_MALFORMED"])
    assert s["again"] == ("OBSERVED_WITH_LIMITATIONS", 1, 0, ["RO_CRATE_DUPLICATE_ENTITY_ID", "WORKFLOW_RUN_ACTION_INPUT_MALFORMED"])
    assert s["none"] == ("UNAVAILABLE", 0, 0, ["RO_CRATE_DESCRIPTOR_MISSING", "RO_CRATE_GRAPH_SHAPE_INVALID"])


def test_reported_actions_say_what_they_leave_out(spark):
    head = [{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}}, {"@id": "./", "@type": "Dataset"}]
    acts = [{"@id": f"#{i:03d}", "@type": "CreateAction", "actionStatus": "CompletedActionStatus", "instrument": [{"@id": "./"}, *({"@id": f"#{k:03d}"} for k in range(9))] if i == 0 else None} for i in range(130)]
    c = graphs.read_crates(spark.createDataFrame([("g", json.dumps({"@context": 1, "@graph": head + acts}))], "graph string, json string"))
    assert [tuple(r)[1:] for r in crates.action_summary(c).collect()] == [("OBSERVED_WITH_LIMITATIONS", 130, 2, ["WORKFLOW_RUN_ACTION_INSTRUMENT_LIMIT", "WORKFLOW_RUN_ACTION_LIMIT"])]
    first = crates.actions(c).orderBy("action_id").first()
    assert (first.status, first.omitted_instrument_count, len(first.instrument_ids)) == ("COMPLETED_DECLARED", 2, 8)


@pytest.mark.parametrize("name", ["s140_graph_roots", "s108_graph_actions", "s145_action_summary"])
def test_a_crate_is_parsed_once(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan
