"""Steps over whole edge tables shuffle them no more often than they need to."""

from archgraph.operators import graph

EDGE = "repo string, id string, src string, dst string, kind string, protocol string, conf_pct int"


def _edges(spark, *ends):
    return spark.createDataFrame([("r", f"{a}>{b}", a, b, "calls", "", 80) for a, b in ends], EDGE)


def test_clusters_end_with_the_round_that_makes_stars(spark, monkeypatch):
    written, durable = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, label: written.append(label) or durable(df, label))
    nodes = spark.createDataFrame([("r", n) for n in "abcdx"], "repo string, id string")
    got = {r.id: r.cluster for r in graph.clusters(nodes, _edges(spark, "ab", "bc", "db", "ab", "xx")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x"}
    assert len(written) == 2  # one round: its large star and its small star


def test_no_edges_leave_every_node_alone(spark):
    nodes = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, id string")
    assert {r.id: r.cluster for r in graph.clusters(nodes, _edges(spark, "aa").where("src <> dst")).collect()} == {"a": "a", "b": "b"}
