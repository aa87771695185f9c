"""Graph analytics as bounded loops of joins.

Every loop writes its round to the shared folder (``durable``): plans stay one
round long, and a lost executor re-reads a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.session import by_shuffle, durable, durable_by, is_empty, parts_for, parts_of

#: Default depth; callers may ask for any other.
MAX_DEPTH = 8


def relationships(edges: DataFrame) -> DataFrame:
    """Edges that say something depends on something; grouping is not that."""
    return edges.where(F.col("kind") != "contains")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = relationships(edges).select("repo", F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy("repo", "e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))
    return nodes.select("repo", "id", "kind").join(counts, ["repo", "id"], "left").select(
        "repo", "id", "kind", F.coalesce("n_out", F.lit(0)).cast("int").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("int").alias("n_in"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that take part in at least one relationship."""
    ends = relationships(edges).select("repo", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.where("kind <> 'boundary'").join(ends, ["repo", "id"], "left_semi")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, cluster): weakly connected components over all edges, labelled
    by their least id; isolated nodes are clusters of one.

    Large-star / small-star (Kiveris et al., 2014): each round replaces a
    node's neighbourhood by a star around its least neighbour, so long chains
    need about log2(n) rounds. The least neighbour is an aggregate that is
    joined back, so a hub's neighbourhood is never gathered.
    """
    pairs = edges.where("src <> dst").select("repo", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    while True:
        # large star: every greater neighbour of a node moves to its least one
        both = pairs.unionByName(pairs.select("repo", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("repo", "a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "b")
        large = durable(pairs.join(least, ["repo", "b"]).select("repo", "a", F.col("m").alias("b")).distinct(), "cluster")
        # small star: every lesser neighbour, and the node itself, move too
        least = large.groupBy("repo", "a").agg(F.min("b").alias("m"))
        moved = large.join(least, ["repo", "a"]).select("repo", F.explode(F.array(
            F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p"))
        pairs = durable(moved.select("repo", F.col("p.b").alias("a"), F.col("p.m").alias("b")).where("a <> b").distinct(), "cluster")
        # stars: every node has one lesser neighbour, which has none itself
        lower = pairs.groupBy("repo", "a").agg(F.count("*").alias("n"))
        if is_empty(lower.where("n > 1")) and is_empty(lower.join(pairs.select("repo", F.col("b").alias("a")), ["repo", "a"], "left_semi")):
            break
    root = pairs.groupBy("repo", F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return nodes.select("repo", "id").join(root, ["repo", "id"], "left").select(
        "repo", "id", F.coalesce("root", "id").alias("cluster"))


def graph_stats(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per repo: sizes, connected components, clusters, cohesion and what kind
    of picture that makes."""
    n = nodes.groupBy("repo").agg(F.count("*").alias("n_nodes"), F.sum((F.col("kind") != "boundary").cast("int")).alias("components"))
    e = edges.groupBy("repo").agg(F.count("*").alias("n_edges"))
    con = connected_nodes(nodes, edges).groupBy("repo").agg(F.count("*").alias("connected"))
    cl = labels.where("id = cluster").groupBy("repo").agg(F.count("*").alias("clusters"))
    out = n.join(e, "repo", "left").join(con, "repo", "left").join(cl, "repo", "left").na.fill(0)
    cohesion = F.when(F.col("components") > 0, F.col("connected") / F.col("components")).otherwise(F.lit(0.0))
    return out.withColumn("cohesion", cohesion).withColumn("shape", shape_note(
        F.col("components"), F.col("connected"), F.col("clusters")))


def shape_note(components: Column, connected: Column, n_clusters: Column) -> Column:
    return (F.when((components >= 8) & (connected * 4 < components) & (n_clusters > F.floor(components / 4)), F.lit("inventory"))
            .when((components > 0) & (connected * 2 < components), F.lit("sparse")).otherwise("connected"))


# ------------------------------------------------------------- reachability
def impact_of(edges: DataFrame, starts: DataFrame, dependents: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Everything reachable from each start: (repo, start, id, depth, via,
    kind, weakest_pct).

    Shortest distance first; among shortest routes the one whose weakest link
    is strongest, then the least ``via``, then canonical edge order. ``starts``
    is (repo, start): many starts share one frontier, so each round is a single
    join for all of them. ``unfinished`` names the starts that go on beyond
    ``max_depth``, which is as deep as the caller asks. Edges need not be merged:
    of equal ones the best confidence counts.
    """
    max_depth = max(max_depth, 1)
    near, far = ("dst", "src") if dependents else ("src", "dst")
    steps = durable(
        relationships(edges).groupBy("repo", F.col(near).alias("at"), F.col(far).alias("peer"), "kind", F.coalesce("protocol", F.lit("")).alias("protocol"))
        .agg(F.max("conf_pct").alias("pct")), "steps")
    parts = parts_for(steps)
    # ends lead nowhere: a start meets all of its ends at once, after the rounds
    onward = steps.select("repo", F.col("at").alias("peer")).distinct().withColumn("onward", F.lit(True))
    steps = durable(steps.join(onward, ["repo", "peer"], "left").withColumn("onward", F.coalesce("onward", F.lit(False))), "steps", by="onward")
    inner = durable_by(steps.where("onward").drop("onward"), "inner", parts, "repo", "at")
    ends = steps.where("NOT onward").drop("onward")
    # after the first round only steps from what some step leads to are taken, often few of them
    led_to = inner.select("repo", F.col("peer").alias("at")).distinct()
    again = durable_by(inner.join(by_shuffle(led_to), ["repo", "at"], "left_semi"), "again", parts, "repo", "at")
    origins = durable(starts.select(
        "repo", "start", F.col("start").alias("id"), F.lit(0).alias("depth"), F.lit(100).alias("weakest_pct")).distinct(), "starts")
    frontier, passed, levels = origins, origins, []
    for depth in range(1, max_depth + 1):
        reached = _stepped(frontier, inner if depth == 1 else again, parts)
        for done in levels:  # everything reached earlier keeps its shorter route
            reached = reached.join(by_shuffle(done.select(*_REACH)), _REACH, "left_anti")
        level = durable_by(reached, "level", parts, *_REACH)
        if is_empty(level):
            break
        levels.append(level)
        frontier = level.select(*origins.columns)
        passed = passed.unionByName(frontier)
    out = _ends(passed.where(F.col("depth") < max_depth), ends)
    for level in levels:
        out = out.unionByName(level)
    return out


_REACH = ["repo", "start", "id"]


#: Into how many parts the ends of a node are dealt, and how many of them one row lists at most, about.
_CHUNKS, _LISTED = 16, 1000


def _way(at: str) -> Column:
    """How deep, how weak and by which edge; the least is the way that counts."""
    weakest = F.least("weakest_pct", "pct")
    return F.struct((F.col("depth") + 1).alias("depth"), (-weakest).alias("neg"), F.col(at).alias("via"), "kind", "protocol").alias("r")


def _nearest(met: DataFrame, *more: str) -> DataFrame:
    return met.groupBy(*_REACH, *more).agg(F.min("r").alias("r")).select(
        *_REACH, "r.depth", "r.via", "r.kind", (-F.col("r.neg")).alias("weakest_pct"))


def _stepped(frontier: DataFrame, inner: DataFrame, parts: int) -> DataFrame:
    """One edge further. What is met is dealt before it is ranked: little of it meets in the task that makes it."""
    met = (by_shuffle(frontier.withColumnRenamed("id", "at")).join(inner, ["repo", "at"]).where(F.col("peer") != F.col("start"))
           .select("repo", "start", F.col("peer").alias("id"), _way("at")))
    return _nearest(met.repartition(parts, *_REACH))


def _ends(passed: DataFrame, ends: DataFrame) -> DataFrame:
    """The ways to everything that leads nowhere, from all that was passed.

    Ends travel to a start as lists, dealt by the ends they hold, and become rows where they are ranked.
    The names of a list are one text, which takes half the room; a name that holds the separator is a text alone.
    """
    ways = durable(ends.groupBy("repo", "at").agg(F.count("*").alias("ways")), "ways")
    passed = by_shuffle(passed.withColumnRenamed("id", "at"))
    due = passed.join(ways, ["repo", "at"]).agg(F.sum("ways")).first()[0] or 0
    at_hash = F.xxhash64("peer")
    piece = F.pmod(F.shiftright(at_hash, 8), F.ceil(F.col("ways") / (_CHUNKS * _LISTED)))
    lists = ends.where("peer IS NOT NULL").join(ways, ["repo", "at"]).groupBy(
        "repo", "at", "kind", "protocol", F.pmod(at_hash, F.lit(_CHUNKS)).alias("chunk"), piece.alias("piece"),
        F.when(F.contains("peer", F.lit("\x00")), F.col("peer")).alias("whole")).agg(
        F.sort_array(F.collect_list(F.struct("peer", "pct"))).alias("ends"))
    lists = lists.select("repo", "at", "kind", "protocol", "chunk", "whole", F.array_join("ends.peer", "\x00").alias("peers"),
                         F.col("ends.pct").alias("pcts"))
    peers = F.when(F.col("whole").isNull(), F.split("peers", "\x00")).otherwise(F.array("peers"))
    each = passed.join(lists, ["repo", "at"]).repartition(parts_of(passed.sparkSession, due), "repo", "start", "chunk").select(
        "repo", "start", "chunk", "at", "depth", "weakest_pct", "kind", "protocol", F.explode(F.arrays_zip(peers.alias("peers"), "pcts")).alias("e")).select(
        "repo", "start", F.col("e.peers").alias("id"), "chunk", "at", "depth", "weakest_pct", "kind", "protocol", F.col("e.pcts").alias("pct"))
    return _nearest(each.where(F.col("id") != F.col("start")).select(*_REACH, "chunk", _way("at")), "chunk")


def unfinished(edges: DataFrame, reach: DataFrame, dependents: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(repo, start) whose reach does not end at ``max_depth``: something not reached yet is one edge further."""
    near, far = ("dst", "src") if dependents else ("src", "dst")
    last = reach.where(F.col("depth") == max_depth).select("repo", "start", F.col("id").alias("at"))
    beyond = last.join(relationships(edges).select("repo", F.col(near).alias("at"), F.col(far).alias("id")), ["repo", "at"])
    beyond = beyond.where(F.col("id") != F.col("start")).select("repo", "start", "id").distinct()
    return beyond.join(reach.select("repo", "start", "id"), ["repo", "start", "id"], "left_anti").select("repo", "start").distinct()


def impact_summary(reach: DataFrame, nodes: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per start: how many components, their share, the weakest link, depths up
    to ``max_depth``. A start that nothing was reached from has a row too."""
    components = nodes.where("kind <> 'boundary'").groupBy("repo").agg(F.count("*").alias("components"))
    depth = [F.sum((F.col("depth") == d).cast("int")).alias(f"depth_{d}") for d in range(1, max_depth + 1)]
    summed = reach.groupBy("repo", "start").agg(
        F.count("*").alias("affected"), F.min("weakest_pct").alias("weakest_pct"), F.max("depth").alias("max_depth"), *depth)
    counts = ["affected", *(f"depth_{d}" for d in range(1, max_depth + 1))]
    out = starts.select("repo", "start").distinct().join(summed, ["repo", "start"], "left").na.fill(0, counts)
    return out.join(components, "repo").withColumns({
        "share": F.round(F.col("affected") / F.col("components"), 4),
        "note": F.when(F.col("affected") == 0, "nothing reached").otherwise("")})


#: Partial routes grown for one pair before its search is given up as exhausted.
ROUTE_BUDGET = 200_000
_PAIR = ["repo", "start", "goal"]


def trace_paths(edges: DataFrame, pairs: DataFrame, max_paths: int = 10, max_depth: int = MAX_DEPTH, budget: int = ROUTE_BUDGET) -> DataFrame:
    """Routes of each (repo, start, goal): nodes, legs (kind:protocol per edge),
    hops, weakest_pct, the route's rank, and the pair's total and exhausted.

    The first ``max_paths`` simple routes of up to ``max_depth`` edges, shortest
    first, then by strongest weakest link, then by node sequence; parallel edges
    of different kinds are different routes. ``total`` counts all of them, also
    those not listed; where ``exhausted`` it is what was found before the
    pair's budget ended the search. ``trace_totals`` tells the totals of all
    pairs, also of those without a route.
    """
    listed, totals = _trace(edges, pairs, max_paths, max_depth, budget)
    return listed.join(totals, _PAIR)


def trace_totals(edges: DataFrame, pairs: DataFrame, max_depth: int = MAX_DEPTH, budget: int = ROUTE_BUDGET) -> DataFrame:
    """(repo, start, goal, total, exhausted) of every pair."""
    return _trace(edges, pairs, 1, max_depth, budget)[1]


def _trace(edges: DataFrame, pairs: DataFrame, max_paths: int, max_depth: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Routes grow by one edge per round, for all pairs at once, only through
    nodes that can still reach the goal in the remaining hops.

    Before a round, the rows it would make are counted per pair from the number
    of ways on from each open end; a pair that would go over its budget is
    closed, so no round holds more than pairs x budget rows. Of the routes that
    arrive, a pair keeps as many as it may still list and a count of the rest.
    """
    pairs = durable(pairs.where("start <> goal").select(*_PAIR).distinct(), "pairs")
    goals = pairs.select("repo", F.col("goal").alias("start")).distinct()
    back = impact_of(edges, goals, dependents=True, max_depth=max_depth).select(
        "repo", F.col("start").alias("goal"), F.col("id").alias("dst"), F.col("depth").alias("to_go"))
    back = back.unionByName(goals.select("repo", F.col("start").alias("goal"), F.col("start").alias("dst"), F.lit(0).alias("to_go")))
    leg = F.concat_ws(":", "kind", F.coalesce("protocol", F.lit(""))).alias("leg")
    ways = durable(relationships(edges).select("repo", F.col("src").alias("at"), "dst", leg, "conf_pct").join(back, ["repo", "dst"])
                   .where("at <> goal"), "ways")
    widths = durable(ways.groupBy("repo", "goal", "at", "to_go").agg(F.count("*").alias("ways")), "widths")
    open_ = pairs.select(*_PAIR, F.col("start").alias("at"), F.array("start").alias("nodes"),
                         F.array().cast("array<string>").alias("legs"), F.lit(100).alias("weakest_pct"))
    # per pair: rows grown, routes found, whether the budget ended the search
    state = pairs.select(*_PAIR, F.lit(0).cast("bigint").alias("grown"), F.lit(0).cast("bigint").alias("total"), F.lit(False).alias("exhausted"))
    found: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        left = max_depth - depth
        reach = widths.where(F.col("to_go") <= left).groupBy("repo", "goal", "at").agg(F.sum("ways").alias("ways"))
        ends = open_.groupBy(*_PAIR, "at").agg(F.count("*").alias("n"))
        due = ends.join(reach, ["repo", "goal", "at"]).groupBy(*_PAIR).agg(F.sum(F.col("n") * F.col("ways")).alias("due"))
        spent = F.col("grown") + F.coalesce("due", F.lit(0))
        state = durable(state.join(due, _PAIR, "left").select(
            *_PAIR, F.when(spent <= budget, spent).otherwise(F.col("grown")).alias("grown"), "total",
            (F.col("exhausted") | (spent > budget)).alias("exhausted")), "pairs")
        on = state.where("NOT exhausted").select(*_PAIR, "total")
        grown = (
            open_.join(on.drop("total"), _PAIR, "left_semi").join(ways, ["repo", "goal", "at"])
            .where((F.col("to_go") <= left) & ~F.array_contains("nodes", F.col("dst")))
            .select(*_PAIR, F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"),
                    F.concat("legs", F.array("leg")).alias("legs"), F.least("weakest_pct", "conf_pct").alias("weakest_pct")))
        grown = durable(grown, "grown")
        done = grown.where("at = goal")
        arrived = done.groupBy(*_PAIR).agg(F.count("*").alias("n"))
        wanted = done.join(on.where(F.col("total") < max_paths).select(*_PAIR), _PAIR, "left_semi").select(
            *_PAIR, "nodes", "legs", F.lit(depth).alias("hops"), "weakest_pct")
        kept = durable(_best_routes(wanted, max_paths).drop("route"), "routes")
        found = kept if found is None else found.unionByName(kept)
        state = state.join(arrived, _PAIR, "left").withColumn("total", F.col("total") + F.coalesce("n", F.lit(0))).drop("n")
        open_ = grown.where("at <> goal")
        if depth < max_depth and is_empty(open_):
            break
    return _best_routes(found, max_paths), durable(state.select(*_PAIR, "total", "exhausted"), "pairs")


def _best_routes(routes: DataFrame, k: int) -> DataFrame:
    from archgraph.operators.ranking import top_per_group

    order = [F.col("hops"), F.desc("weakest_pct"), F.array_join("nodes", "\x00"), F.array_join("legs", "\x00")]
    return top_per_group(routes, _PAIR, order, k).withColumnRenamed("rank", "route")


def weakest_link(confidences: Column) -> Column:
    return F.coalesce(F.array_min(confidences), F.lit(100))
