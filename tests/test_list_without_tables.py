"""A list of edges merges what it shows and writes no whole edge table for it."""


def test_relationships_write_no_edge_table(spark):
    from archgraph.plans import registry
    from archgraph.plans.catalog import QUERIES

    registry.forget_stages()
    rows = QUERIES["relationships"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.repo, r.id, r.kind) for r in rows}) == len(rows) and all(r.kind != "contains" for r in rows)
    assert not any(name == "edges" for _, _, name in registry._TABLES)
