"""Routes: totals, exhausted searches and bounded rounds, against a depth-first search."""

import random

import pytest

from archgraph.operators import graph

EDGE = "repo string, src string, dst string, kind string, protocol string, conf_pct int"
PAIRS = "repo string, start string, goal string"


def walk_all(edges, start, goal, depth):
    """Every simple route by depth-first search."""
    out = []

    def walk(node, seen, legs, weakest):
        for _, src, dst, kind, protocol, pct in edges:
            if src != node or dst in seen or kind == "contains":
                continue
            leg, low = [*legs, f"{kind}:{protocol}"], min(weakest, pct)
            if dst == goal:
                out.append((len(leg), -low, "\0".join([*seen, dst]), "\0".join(leg)))
            elif len(leg) < depth:
                walk(dst, [*seen, dst], leg, low)

    walk(start, [start], [], 100)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_and_totals_to_depth_twelve(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = sorted({("r", a, b, rng.choice(["calls", "depends_on", "contains"]), rng.choice(["http", ""]), rng.randrange(40, 100))
                    for a in nodes for b in nodes if a != b and rng.random() < 0.17})
    pairs = [("r", "n0", "n1"), ("r", "n2", "n3"), ("r", "n1", "n0"), ("r", "n4", "lost")]
    df, wanted = spark.createDataFrame(edges, EDGE), spark.createDataFrame(pairs, PAIRS)
    rows = graph.trace_paths(df, wanted, max_paths=7, max_depth=12).collect()
    totals = {(r.start, r.goal): (r.total, r.exhausted) for r in graph.trace_totals(df, wanted, max_depth=12).collect()}
    for _, start, goal in pairs:
        want = walk_all(edges, start, goal, 12)
        got = sorted((r.route, (r.hops, -r.weakest_pct, "\0".join(r.nodes), "\0".join(r.legs)), r.total) for r in rows if (r.start, r.goal) == (start, goal))
        assert [g[1] for g in got] == want[:7] and {g[2] for g in got} <= {len(want)}
        assert totals[start, goal] == (len(want), False)


def test_a_dense_graph_is_given_up_and_said_so(spark, monkeypatch):
    """All of 12 nodes lead to all: the number of routes explodes, rows per round do not, and the shortest routes are there."""
    nodes = [f"n{i:02}" for i in range(12)]
    dense = [("r", a, b, "calls", "", 80) for a in nodes for b in nodes if a != b] + [("r", "x", "y", "calls", "", 70)]
    pairs = spark.createDataFrame([("r", "n00", "n01"), ("r", "x", "y")], PAIRS)
    sizes, real = [], graph.durable

    def watched(df, label, by=None):
        out = real(df, label, by)
        if label == "grown":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "durable", watched)
    rows = graph.trace_paths(spark.createDataFrame(dense, EDGE), pairs, max_paths=12, budget=1_500).collect()
    assert max(sizes) <= 1_500
    found = sorted((r.route, r.hops) for r in rows if r.goal == "n01")
    assert [h for _, h in found] == [1] + [2] * 10 + [3]
    assert {(r.goal, r.total, r.exhausted) for r in rows} == {("n01", 1 + 10 + 90, True), ("y", 1, False)}


def test_parts_without_an_image_are_ends_too(spark):
    from archgraph.plans.catalog import QUERIES

    rows = QUERIES["trace_path"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.start.startswith("container:services/") for r in rows)
