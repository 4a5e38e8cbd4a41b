"""Entities of graphs never go through the driver, however small Spark believes them to be."""

import json

import pytest

from curalis import registry
from curalis.operators import graphs as G

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s140_graph_roots", "s108_graph_actions", "s145_action_summary"])
def test_sides_of_graphs_are_not_broadcast(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # sides keyed by a graph's name, a string; tables of the driver may be broadcast
    assert "BroadcastMode(List(input[0, string" not in plan


def test_a_document_is_read_once_in_its_row(spark):
    deep = {"@context": 1, "@graph": [{"@id": "d", "p": json.loads("[" * 300 + '{"@id":"t"}' + "]" * 300)}]}
    rows = [("deep", json.dumps(deep)), ("half", '{"@context":1,"@graph":[{"@id":"\\ud800"}]}'), ("long", '{"@context":1,"@graph":[{"@id":"a","n":1e999,"p":{"@id":"a"}}]} x'), ("none", None)]
    spark.sparkContext.setJobGroup("observe", "")
    d = G.observe(spark.createDataFrame(rows, "graph string, json string"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("observe")  # no job asks how deep documents are, none keeps items
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    got = {r.graph: r for r in d.collect()}
    assert [tuple(x) for x in got["deep"].references] == [("d", "p", "t", False)]
    assert [x.id for x in got["half"].entities] == ["?"]
    assert [tuple(x) for x in got["long"].references] == [("a", "p", "a", True)] and got["none"].status == "UNAVAILABLE"
