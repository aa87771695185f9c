"""What is reached is shuffled once: rounds hold no ends, and levels lie in buckets."""

from archgraph.operators import graph

EDGE = "repo string, src string, dst string, kind string, protocol string, conf_pct int, id string"


def _edge(src, dst, conf):
    return ("r", src, dst, "calls", "http", conf, f"{src}>{dst}")


def test_rounds_hold_no_ends_and_ends_are_whole(spark, monkeypatch):
    # a -> b -> c -> a; each has the same 3,000 ends, b by the strongest edge, and c has one of its own
    chain = [_edge("a", "b", 90), _edge("b", "c", 80), _edge("c", "a", 70)]
    ends = [_edge(n, f"end-{i}", conf) for i in range(3000) for n, conf in (("a", 50), ("b", 90), ("c", 60))]
    edges = spark.createDataFrame([*chain, *ends, _edge("c", "own", 75)], EDGE)
    rounds, written = [], graph.durable_by
    monkeypatch.setattr(graph, "durable_by", lambda df, label, parts, *keys: rounds.append((label, written(df, label, parts, *keys))) or rounds[-1][1])
    starts = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "end-1")], "repo string, start string")
    got = {(r.start, r.id): (r.depth, r.via, r.weakest_pct) for r in graph.impact_of(edges, starts, dependents=False).collect()}
    assert sum(df.count() for label, df in rounds if label == "level") == 4  # b and c from a, c and a from b
    assert got == {("a", "b"): (1, "a", 90), ("a", "c"): (2, "b", 80), ("b", "c"): (1, "b", 80), ("b", "a"): (2, "c", 70),
                   ("a", "own"): (3, "c", 75), ("b", "own"): (2, "c", 75),
                   **{("a", f"end-{i}"): (1, "a", 50) for i in range(3000)}, **{("b", f"end-{i}"): (1, "b", 90) for i in range(3000)}}
    level = next(df for label, df in rounds if label == "level")
    other = level.groupBy("repo", "start", "id").count().join(level.hint("merge"), ["repo", "start", "id"], "left_anti")
    other.collect()
    assert "Exchange" not in other._jdf.queryExecution().executedPlan().toString()
