"""Rules of the domain on small hand-written inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from archgraph.functions import deps, ids, images, net, paths, redact
from archgraph.operators import graph, match, merge
from archgraph.operators.nodes import identity_forms, typed_nodes
from archgraph.operators.ranking import running

NODE = ("repo string, id string, kind string, layer string, name string, namespace string, project string, language string, "
        "framework string, image string, port int, labels string, directory string, build_context string, name_from string, "
        "path string, line int, conf_pct int")


def nodes_of(spark, *rows):
    base = dict(repo="r", kind="service", layer="container", namespace=None, project=".", language=None, framework=None, image=None,
                port=None, labels=None, directory=None, build_context=None, name_from=None, path="d/x.yaml", line=1, conf_pct=100)
    names = [c.strip().split()[0] for c in NODE.split(",")]
    return typed_nodes(spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], NODE))


def svc(name, ns=None, **more):
    return dict(id=f"container:@{ns}/{name}" if ns else f"container:{name}", name=name, namespace=ns, **more)


def decide(spark, nodes, *hints, dns=None):
    rows = [("r", i, frm, "f.env", i, key, value) for i, (frm, key, value) in enumerate(hints)]
    values = spark.createDataFrame(rows, "repo string, row_id bigint, from_node string, path string, line int, key string, value string")
    out = match.match_ladder(match.hints_from_values(values), nodes, identity_forms(nodes, dns))
    return {r["hint_id"]: r for r in out.collect()}


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("key,value", [
    ("LOG_LEVEL", "info"), ("APP_ENV", "production"), ("PORT", "8080"), ("DATABASE_URL", ""), ("DATABASE_URL", "postgres://${DB}:5432/a"),
    ("API_URL", "http://$(hostname):80"), ("API_URL", "http://localhost:8080"), ("API_HOST", "0.0.0.0"), ("DB_HOST", "10.0.1.15"),
    ("SOCKET_PATH", "/var/run/app.sock"), ("STORAGE_URL", "gopher://old:70/x"), ("API_URL", "http://a b:1/c"), ("DB_HOST", "db:x:1")])
def test_values_that_locate_nothing(spark, key, value):
    assert one(spark, net.parse_value(F.col("k"), F.col("v")), k=key, v=value) is None


@pytest.mark.parametrize("key,value,tokens,port,edge", [
    ("STRIPE_URL", "https://api.stripe.com", ["api.stripe.com"], 443, "calls"),
    ("SVC_HOST", "user.prod.svc.cluster.local", ["user.prod.svc.cluster.local", "user.prod", "user"], 0, "calls"),
    ("DB_HOST", "my_db:5432", ["my_db"], 5432, "persists_to"), ("X", "AMQP://u:p@mq/v", ["mq"], 5672, "publishes_to"),
    ("BROKERS_SERVERS", " , k1:9092,k2:9092", ["k1"], 9092, "publishes_to"), ("DB_HOST", "db.qa", ["db.qa"], 0, "calls"),
    ("A_URL", "postgres://u:p@w@db:99999/x", ["db"], 5432, "persists_to")])
def test_values_that_locate_something(spark, key, value, tokens, port, edge):
    got = one(spark, net.parse_value(F.col("k"), F.col("v")), k=key, v=value)
    assert (got["tokens"], got["port"], got["edge"]) == (tokens, port, edge)


def test_a_url_with_a_bad_port_is_not_a_url(spark):
    assert one(spark, net.parse_value(F.col("k"), F.col("v")), k="A_URL", v="http://db:http/x") is None


def test_ids_fold_and_keep_apart_what_folding_loses(spark):
    nid = lambda n, scope="": one(spark, ids.node_id(F.lit("service"), F.col("s"), F.col("n")), s=scope, n=n)
    assert nid("My  Service!!") == "container:my-service"
    assert nid("api", "Prod") == "container:@prod/api"
    assert nid("../a//b/") == "container:a/b"
    assert nid("注文") != nid("決済") and nid("注文").startswith("container:unknown.")
    for name in ("My  Service!!", "注文", "a.b_c"):
        assert one(spark, ids.is_valid_node_id(F.col("i")), i=nid(name))
    assert not one(spark, ids.is_valid_node_id(F.col("i")), i="container:A")


def test_edge_id_is_pinned(spark):
    a = one(spark, ids.edge_id(F.col("a"), F.col("b"), F.lit("calls"), F.lit("")), a="x", b="y")
    assert a == one(spark, ids.edge_id(F.col("a"), F.col("b"), F.lit("calls"), F.lit(None).cast("string")), a="x", b="y")
    assert a.startswith("e:") and len(a) == 14


def test_redaction_is_idempotent_and_spares_locations(spark):
    text = "postgres://svc:hunter2@db:5432/app eyJabcd.efgh1.sig ghp_abcdefghij"
    once = one(spark, redact.redact_string(F.col("t")), t=text)
    assert once == "postgres://***:***@db:5432/app *** ***"
    assert one(spark, redact.redact_string(F.col("t")), t=once) == once
    secret = lambda k: one(spark, redact.is_secret_key(F.col("k")), k=k)
    assert secret("db-password") and secret("X_PIN") and not secret("SHIPPING_SERVICE_ADDR") and not secret("OAUTH_TOKEN_URL")


def test_images_and_dependencies(spark):
    kind = lambda r: one(spark, images.image_kind(F.col("r")), r=r)
    assert kind("bitnami/postgresql:15")["kind"] == "datastore" and kind("confluentinc/cp-kafka")["tech"] == "kafka"
    assert not kind("acme/web")["recognised"]
    lib = lambda d: one(spark, deps.library_of(F.col("d")), d=d)
    assert lib("github.com/jackc/pgx/v5")["tech"] == "postgres" and lib("psycopg2_binary")["tech"] == "postgres"
    assert lib("google-cloud-storage")["tech"] == "gcs" and lib("left-pad") is None


def test_paths(spark):
    clean = lambda p: one(spark, paths.normalize_dir(F.col("p")), p=p)
    assert [clean(p) for p in ("", "./a/../b//", "..", "a/../../b", "/../x")] == [".", "b", "..", "../b", "/x"]


def test_locality_beats_rule_strength_and_outsiders_are_refused(spark):
    n = nodes_of(spark, svc("a", "x"), svc("db_1", "x"), svc("db-1", "y"), svc("only", "y"), svc("me", None))
    got = decide(spark, n, ("container:@x/a", "DB_HOST", "db-1"), ("container:@x/a", "B_HOST", "only"), ("container:me", "B_HOST", "only"),
                 ("container:@x/a", "SELF_HOST", "a"), ("container:me", "DB_HOST", "nobody"))
    assert (got[0]["node_id"], got[0]["rule"], got[0]["match_pct"]) == ("container:@x/db_1", "name_normalized", 70)
    assert got[1]["outcome"] == "out_of_scope" and got[2]["node_id"] == "container:@y/only"
    assert got[3]["outcome"] == "none" and got[4]["outcome"] == "none"


def test_ties_are_narrowed_or_refused(spark):
    n = nodes_of(spark, svc("me"), svc("db", "x", port=1), svc("db", "y", port=5432), svc("q", "x"), svc("q", "y", kind="queue"),
                 svc("w", "x"), svc("w", "y"))
    got = decide(spark, n, ("container:me", "DB_HOST", "db:5432"), ("container:me", "Q_HOST", "q:9092"), ("container:me", "W_HOST", "w"))
    assert (got[0]["node_id"], got[0]["rule"], got[0]["match_pct"]) == ("container:@y/db", "name_exact+scoped", 75)
    assert got[1]["node_id"] == "container:@y/q"
    assert got[2]["outcome"] == "ambiguous" and got[2]["n_candidates"] == 2


def test_projects_are_walls_except_for_externals(spark):
    n = nodes_of(spark, svc("a", None, project="p1"), svc("b", None, project="p2"),
                 dict(id="context:api.x.com", name="api.x.com", kind="external", layer="context", namespace="net"))
    got = decide(spark, n, ("container:a", "B_HOST", "b"), ("container:a", "X_URL", "https://api.x.com"))
    assert got[0]["outcome"] == "none" and got[1]["rule"] == "dns_exact"


def test_a_hot_name_costs_no_pairs(spark):
    """A name held by a third of all components, asked for by many."""
    rows = [svc("api", f"n{i}") for i in range(300)] + [svc(f"s{i}", f"n{i % 300}") for i in range(600)]
    n = nodes_of(spark, *rows)
    got = decide(spark, n, *[(f"container:@n{i % 300}/s{i}", "API_HOST", "api") for i in range(600)])
    assert {g["outcome"] for g in got.values()} == {"matched"}
    assert all(got[i]["node_id"] == f"container:@n{i % 300}/api" for i in range(600))


def fold(readings):
    """Reference fold, one reading after the other."""
    conf, value, seen = -1, None, False
    for c, v in readings:
        wins = c > conf
        conf = max(conf, c)
        if v is not None and (wins or not seen):
            value, seen = v, True
    return conf, value


def test_merge_equals_a_sequential_fold_in_any_partitioning(spark):
    rnd = random.Random(7)
    cases = {f"n{i}": [(rnd.choice([40, 80, 100]), rnd.choice([None, "a", "b", "c"])) for _ in range(rnd.randint(1, 7))] for i in range(150)}
    rows = [("r", k, s, c, v) for k, rs in cases.items() for s, (c, v) in enumerate(rs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "repo string, id string, seq bigint, conf_pct int, v string")
    for parts in (1, 7):
        out = merge.merge_nodes(df.repartition(parts), ["v"]).collect()
        assert {r["id"]: (r["conf_pct"], r["v"]) for r in out} == {k: fold(rs) for k, rs in cases.items()}


def random_graph(seed, n=14, m=30):
    rnd = random.Random(seed)
    return [("r", f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", rnd.choice(["calls", "persists_to", "contains"]), rnd.choice(["", "http"]),
             rnd.choice([40, 80, 100])) for _ in range(m)]


EDGE = "repo string, src string, dst string, kind string, protocol string, conf_pct int"


@pytest.mark.parametrize("seed", [1, 2])
def test_impact_and_paths_against_brute_force(spark, seed):
    best = {}
    for e in random_graph(seed):
        best[e[:5]] = max(best.get(e[:5], 0), e[5])
    edges = [(*k, v) for k, v in best.items()]
    df = spark.createDataFrame(edges, EDGE)
    rel = sorted((e for e in edges if e[3] != "contains"), key=lambda e: (e[1], e[2], e[3], e[4]))
    # breadth-first, level by level, best route per node
    settled, frontier = {}, {"n0": 100}
    for depth in range(1, 9):
        found = {}
        for cur in sorted(frontier):
            for e in rel:
                if e[2] != cur or e[1] == "n0" or e[1] in settled:
                    continue
                cand = (-min(frontier[cur], e[5]), cur, e[3])
                if e[1] not in found or cand[:2] < found[e[1]][:2]:
                    found[e[1]] = cand
        settled.update({k: (depth, v[1], v[2], -v[0]) for k, v in found.items()})
        frontier = {k: -v[0] for k, v in found.items()}
    starts = spark.createDataFrame([("r", "n0")], "repo string, start string")
    got = {r["id"]: (r["depth"], r["via"], r["kind"], r["weakest_pct"]) for r in graph.impact_of(df, starts).collect()}
    assert got == settled
    # simple routes by depth-first search
    routes = []

    def walk(node, seen, legs, weakest):
        if len(legs) == 8:
            return
        for e in rel:
            if e[1] == node and e[2] not in seen:
                leg = legs + [f"{e[3]}:{e[4]}"]
                if e[2] == "n1":
                    routes.append((len(leg), -min(weakest, e[5]), "\0".join(seen + [e[2]]), "\0".join(leg)))
                else:
                    walk(e[2], seen + [e[2]], leg, min(weakest, e[5]))

    walk("n0", ["n0"], [], 100)
    pairs = spark.createDataFrame([("r", "n0", "n1")], "repo string, start string, goal string")
    rows = graph.trace_paths(df, pairs, max_paths=5).orderBy("route").collect()
    assert [(r["hops"], -r["weakest_pct"], "\0".join(r["nodes"]), "\0".join(r["legs"])) for r in rows] == sorted(routes)[:5]


def test_clusters_of_a_long_chain_and_a_hub(spark):
    chain = [("r", f"c{i:03}", f"c{i + 1:03}", "calls", "", 80) for i in range(120)]
    hub = [("r", "hub", f"h{i:03}", "contains", "", 80) for i in range(200)]
    names = {e[1] for e in chain + hub} | {e[2] for e in chain + hub} | {"alone"}
    nodes = spark.createDataFrame([("r", n) for n in names], "repo string, id string")
    got = {r["id"]: r["cluster"] for r in graph.clusters(nodes, spark.createDataFrame(chain + hub, EDGE)).collect()}
    assert len(set(got.values())) == 3 and got["c120"] == "c000" and got["h199"] == "h000" and got["hub"] == "h000"


def test_running_total_inside_one_big_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id"), (F.col("id") % 7 + 1).alias("w"))
    rows = running(df.repartition(13), ["g"], [F.col("id")], F.col("w"), "total").orderBy("id").collect()
    assert [r["total"] for r in rows] == list(itertools.accumulate(i % 7 + 1 for i in range(5000)))


def test_no_pairing_join_in_the_core_plans(spark):
    n = nodes_of(spark, svc("a", "x"), svc("b", "x"))
    forms = identity_forms(n)
    values = spark.createDataFrame([("r", 1, "container:@x/a", "f", 1, "B_HOST", "b")],
                                   "repo string, row_id bigint, from_node string, path string, line int, key string, value string")
    decided = match.match_ladder(match.hints_from_values(values), n, forms)
    for df in (decided, match.refusal_diagnostics(decided, n, forms), match.external_synthesis(decided)[1]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "EvalPython" not in plan


def test_a_job_plugs_in(spark):
    from archgraph.sources.jobs import Jobs

    files = spark.createDataFrame([("r", "a/x.toml", 3, 1, "k=v"), ("r", "a/y.md", 3, 1, "-"), ("r", "a/z.toml", 9, 1, "big")],
                                  "repo string, path string, size bigint, mtime bigint, content string")
    jobs = Jobs(limit=5)
    jobs.register("toml", F.col("ext") == ".toml", lambda f: {"nodes": f.select("repo", "path", F.lit("n").alias("id"))})
    jobs.register("count", F.lit(True), lambda f: {"nodes": f.select("repo", "path"), "diagnostics": f.select("repo", "path")})
    out = jobs.run(files)
    assert sorted((r["extractor"], r["path"]) for r in out["nodes"].collect()) == [("count", "a/x.toml"), ("count", "a/y.md"), ("toml", "a/x.toml")]


def test_the_ladder_can_be_extended(spark):
    n = nodes_of(spark, svc("me"), svc("orders"))
    forms = identity_forms(n).unionByName(spark.createDataFrame([("r", "nick", "bestellung", "container:orders")],
                                                                "repo string, form_kind string, form string, node_id string"))
    values = spark.createDataFrame([("r", 1, "container:me", "f", 1, "B_HOST", "bestellung")],
                                   "repo string, row_id bigint, from_node string, path string, line int, key string, value string")
    rules = match.match_rules([("nickname", 30, "nick")])
    got = match.match_ladder(match.hints_from_values(values), n, forms, rules).first()
    assert (got["node_id"], got["rule"], got["match_pct"]) == ("container:orders", "nickname", 50)


def test_depth_is_the_callers_choice(spark):
    chain = spark.createDataFrame([("r", f"n{i:02}", f"n{i + 1:02}", "calls", "", 90) for i in range(12)], EDGE)
    starts = spark.createDataFrame([("r", "n12")], "repo string, start string")
    reach = graph.impact_of(chain, starts, max_depth=20)
    assert reach.agg(F.max("depth")).first()[0] == 12
    assert not graph.unfinished(chain, reach, max_depth=20).count()
    short = graph.impact_of(chain, starts, max_depth=5)
    assert graph.unfinished(chain, short, max_depth=5).count() == 1
    pairs = spark.createDataFrame([("r", "n00", "n10")], "repo string, start string, goal string")
    assert [r["hops"] for r in graph.trace_paths(chain, pairs, max_depth=12).collect()] == [10]
    nodes = spark.createDataFrame([("r", f"n{i:02}", "service") for i in range(13)], "repo string, id string, kind string")
    both = spark.createDataFrame([("r", "n12"), ("r", "n00")], "repo string, start string")
    rows = {r["start"]: r for r in graph.impact_summary(graph.impact_of(chain, both, max_depth=12), nodes, both, 12).collect()}
    assert (rows["n12"]["affected"], rows["n12"]["depth_12"]) == (12, 1)
    assert (rows["n00"]["affected"], rows["n00"]["note"]) == (0, "nothing reached")


def test_merge_chains_end_and_circles_are_reported(spark):
    links = [("r", f"m{i:02}", f"m{i + 1:02}") for i in range(20)] + [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "x", "a")]
    merges = spark.createDataFrame(links, "repo string, absorbed string, survivor string")
    assert {r["survivor"] for r in merge.follow_merges(merges).collect()} == {"m20"}
    assert {r["absorbed"] for r in merge.merge_circles(merges).collect()} == {"a", "b", "c", "x"}


def test_match_labels_are_the_selector(spark):
    from archgraph.sources import k8s

    docs = spark.createDataFrame([
        ("r", "a.yaml", '{"apiVersion":"apps/v1","kind":"Deployment","metadata":{"name":"web"},"spec":{"selector":{"matchLabels":'
                        '{"app":"web"}},"template":{"spec":{"containers":[{"name":"c","image":"x/web:1"}]}}}}'),
        ("r", "b.yaml", '{"apiVersion":"v1","kind":"Service","metadata":{"name":"web"},"spec":{"selector":{"tier":"front"}}}')],
        "repo string, path string, doc string")
    objs = k8s.objects(docs)
    assert k8s.workloads(objs).first()["labels"] == {"app": "web"}
    assert k8s.service_aliases(objs).first()["selector"] == {"tier": "front"}


def test_deep_leaves_are_found(spark):
    from archgraph.sources.charts import walk_values

    doc = "x"
    text = '"leaf"'
    for _ in range(14):
        text = f'{{"{doc}":{text}}}'
    docs = spark.createDataFrame([("r", "values.yaml", text)], "repo string, path string, doc string")
    assert [r["trail"] for r in walk_values(docs).collect()] == [".".join("x" * 14)]
    assert walk_values(docs, max_depth=5).count() == 0


def test_selectors_of_any_label_are_counted(spark):
    from archgraph.operators import aliases

    nodes = spark.createDataFrame([("r", "a", {"tier": "web", "app": "a"}), ("r", "b", {"tier": "web"})],
                                  "repo string, id string, labels map<string,string>")
    asked = spark.createDataFrame([("r", "1", {"tier": "web"}), ("r", "2", {"tier": "web", "app": "a"}), ("r", "3", {"x": "y"}), ("r", "4", {})],
                                  "repo string, alias_key string, selector map<string,string>")
    got = {r["alias_key"]: r["n"] for r in aliases.selector_counts(asked, nodes).collect()}
    assert got == {"1": 2, "2": 1, "3": 0, "4": 0}


def test_an_emptied_repository_loses_its_rows(spark, tmp_path):
    from archgraph.streaming.feed import read_refreshed, refresh_affected

    target, where = str(tmp_path / "t"), "repo string, path string"
    count = lambda files: files.groupBy("repo").agg(F.count("*").alias("n"))
    both = spark.createDataFrame([("a b", "x"), ("c", "y")], where)
    refresh_affected(both, both, count, target)
    refresh_affected(both, both.where("repo = 'c'"), count, target, 1)
    assert [r["repo"] for r in read_refreshed(spark, target, "repo string, n long").collect()] == ["c"]


def test_oversize_files_are_reported_by_the_jobs(spark):
    from archgraph.sources.jobs import Jobs

    files = spark.createDataFrame([("r", "a/go.mod", 9, 1, "big")], "repo string, path string, size bigint, mtime bigint, content string")
    out = Jobs(limit=5).run(files)
    assert [r["code"] for r in out["diagnostics"].collect()] == ["file_too_large"]


def test_every_masking_pattern_has_its_start():
    from archgraph import vocab

    for name in ("TOKEN_STARTS", "AWS_KEY_STARTS"):
        assert getattr(vocab, name)
