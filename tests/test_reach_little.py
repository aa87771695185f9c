"""What reach carries from round to round and to the ends is little."""

from archgraph.operators import graph, merge
from archgraph.plans import registry
from archgraph.plans.catalog import QUERIES

EDGE = "repo string, src string, dst string, kind string, protocol string, conf_pct int"


def edges_of(spark, *pairs):
    return spark.createDataFrame([("r", a, b, "calls", p, c) for a, b, p, c in pairs], EDGE)


def reached(spark, edges, start):
    starts = spark.createDataFrame([("r", start)], "repo string, start string")
    return {(r.id, r.depth, r.via, r.weakest_pct) for r in graph.impact_of(edges, starts, dependents=False).collect()}


def test_equal_edges_need_no_merging(spark):
    edges = edges_of(spark, ("a", "b", None, 40), ("a", "b", "", 80), ("b", "c", "x", 90), ("b", "c", "x", 10))
    assert reached(spark, edges, "a") == reached(spark, merge.merge_edges(edges), "a") == {("b", 1, "a", 80), ("c", 2, "b", 80)}


def test_names_travel_as_one_text_and_any_name_arrives(spark):
    odd = ["x\x00y", "\x00", "", "é", "x", "y"]
    edges = edges_of(spark, ("a", "b", "", 80), *[("b", n, "", i) for i, n in enumerate(odd)], ("b", None, "", 9))
    assert reached(spark, edges, "a") == {("b", 1, "a", 80)} | {(n, 2, "b", i) for i, n in enumerate(odd)}


def test_later_rounds_take_only_steps_that_something_leads_to(spark, monkeypatch):
    kept, real = {}, graph.durable_by
    monkeypatch.setattr(graph, "durable_by", lambda df, label, *a: kept.setdefault(label, real(df, label, *a)) if label != "level" else real(df, label, *a))
    edges = edges_of(spark, ("a", "b", "", 80), ("b", "c", "", 70), ("c", "d", "", 60), *[(f"s{i}", "b", "", 50) for i in range(20)])
    assert reached(spark, edges, "s3") == {("b", 1, "s3", 50), ("c", 2, "b", 50), ("d", 3, "c", 50)}
    assert (kept["inner"].count(), sorted(r["at"] for r in kept["again"].collect())) == (22, ["b"])


def test_impact_queries_write_no_merged_edges(spark, monkeypatch):
    monkeypatch.setattr(merge, "merge_edges", lambda edges: 1 / 0)
    rows = edges_of(spark, ("a", "b", None, 40)).selectExpr("repo", "src", "dst", "'publishes_to' AS kind", "protocol", "conf_pct")
    monkeypatch.setattr(registry.Inputs, "__getattr__", lambda self, name: {"fx_edges": rows}[name])
    assert [r.id for r in QUERIES["impact_of_dependencies"](spark, "none").collect()] == ["b"]
