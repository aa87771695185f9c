"""Named pairs are made distinct by tasks cut by rows, however well they compress."""

from archgraph import session
from archgraph.operators import quality


def test_many_pairs_are_many_tasks(spark, monkeypatch):
    nodes = spark.createDataFrame([("r", f"n{i}", f"name-{i % 7}") for i in range(20)], "repo string, id string, name string")
    edges = spark.createDataFrame([("r", f"n{i}", f"n{j}", "calls", "dns") for i in range(20) for j in range(20)],
                                  "repo string, src string, dst string, kind string, rule string")
    monkeypatch.setattr(quality, "parts_for", lambda df: session.parts_for(df, 20), raising=False)
    found = quality.found_pairs(edges, nodes)
    assert found.rdd.getNumPartitions() == 400 // 20
    assert {(r.src_name, r.dst_name) for r in found.collect()} == {(f"name-{i}", f"name-{j}") for i in range(7) for j in range(7)}
    assert found.count() == 49
