"""Owners of directories grow with the input: none of them is sent through the driver."""

from archgraph.operators import joins


def test_owners_are_joined_by_shuffle(spark):
    nodes = spark.createDataFrame([("r", f"n{i}", "service", f"apps/a{i // 2 if i < 4 else i}", None) for i in range(10)],
                                  "repo string, id string, kind string, directory string, build_context string")
    hints = spark.createDataFrame([("r", i, f"apps/a{i}") for i in range(12)], "repo string, hint_id int, owner_dir string")
    merges = spark.createDataFrame([("r", "n5", "n6")], "repo string, absorbed string, survivor string")
    out = joins.directory_owner_join(hints, nodes, merges)
    got = {r.hint_id: (r.n_owners, r.from_node) for r in out.collect()}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert got == {0: (2, None), 1: (2, None), 2: (0, None), 3: (0, None), 5: (1, "n6"), 10: (0, None), 11: (0, None),
                   **{i: (1, f"n{i}") for i in (4, 6, 7, 8, 9)}}
