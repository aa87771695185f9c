"""Whole scans of small repositories, from files to a corrected graph."""

import json

import pytest
from pyspark.sql import functions as F

from archgraph.operators import merge
from archgraph.operators import scan as sc
from archgraph.operators.diagnostics import FORMATTERS, counted
from archgraph.sources.builtin import built_in, shaped


def workload(name, image, ns="prod", env=(), kind="Deployment", labels=None, **spec):
    pod = {"containers": [{"name": "main", "image": image, "ports": [{"containerPort": 8080}], "env": [
        {"name": k, "value": v} if isinstance(v, str) else {"name": k, **v} for k, v in env]}]}
    return {"apiVersion": "apps/v1", "kind": kind, "metadata": {"name": name, "namespace": ns},
            "spec": {"replicas": 2, "template": {"metadata": {"labels": labels or {"app": name}}, "spec": pod}, **spec}}


def service(name, selector, ns="prod", port=80):
    return {"apiVersion": "v1", "kind": "Service", "metadata": {"name": name, "namespace": ns},
            "spec": {"selector": selector, "ports": [{"port": port}]}}


def cluster_repo():
    """Three services, a database behind a headless service, a config map, an ingress and code beside them."""
    use = {"valueFrom": {"configMapKeyRef": {"name": "cfg", "key": "ORDERS_HOST"}}}
    return {
        "deploy/gateway.yaml": workload("api-gateway", "ghcr.io/acme/api-gateway:1", env=[
            ("USERS_URL", "http://user-svc:80"), ("ORDERS_HOST", use), ("PAY_URL", "https://api.stripe.com/v1"), ("LOST_HOST", "nobody:80")]),
        "deploy/users.yaml": workload("users", "ghcr.io/acme/users:3", env=[("DATABASE_URL", "postgres://svc:hunter2@users-db:5432/u")]),
        "deploy/users-svc.yaml": service("user-svc", {"app": "users"}),
        "deploy/orders.yaml": workload("orders", "ghcr.io/acme/orders:3"),
        "deploy/db.yaml": workload("pg", "postgres:16", kind="StatefulSet", serviceName="users-db"),
        "deploy/none.yaml": service("ghost", {"app": "ghost"}),
        "deploy/cfg.yaml": {"apiVersion": "v1", "kind": "ConfigMap", "metadata": {"name": "cfg", "namespace": "prod"}, "data": {"ORDERS_HOST": "orders"}},
        "deploy/patch.yaml": {"apiVersion": "apps/v1", "kind": "Deployment", "metadata": {"name": "users", "namespace": "prod"}, "spec": {"replicas": 9}},
        "deploy/in.yaml": {"apiVersion": "v1", "kind": "Ingress", "metadata": {"name": "edge", "namespace": "prod"}, "spec": {
            "ingressClassName": "nginx", "rules": [{"host": "x.example.com", "http": {"paths": [{"path": "/", "backend": {"service": {"name": "user-svc", "port": {"number": 80}}}}]}}]}},
        "deploy/broken.yaml": "{no",
        "deploy/away.yaml": {"apiVersion": "v1", "kind": "Service", "metadata": {"name": "mail", "namespace": "prod"},
                             "spec": {"type": "ExternalName", "externalName": "smtp.example.org"}},
        "src/users/go.mod": "module github.com/acme/users-api\n\ngo 1.22\n\nrequire (\n\tgithub.com/jackc/pgx/v5 v5.1.0\n)\n",
        "src/users/Dockerfile": "FROM golang:1.22\nEXPOSE 8080\nENV CACHE_HOST orders:80\n",
        "src/orders/package.json": {"name": "@acme/orders", "version": "1.2.0", "engines": {"node": ">=20"}, "dependencies": {"stripe": "1", "express": "4"}},
        "src/orders/.env": "USERS_ADDR=user-svc:80\nAUTH_URL=https://your-tenant.auth0.io/x\n",
        "Procfile": "web: x",
    }


def environments():
    """One name in three namespaces."""
    repo = {f"env/{ns}/users.yaml": workload("users", "acme/users:1", ns) for ns in ("dev", "staging", "prod")}
    repo["env/dev/web.yaml"] = workload("web", "acme/web:1", "dev", env=[("USERS_URL", "http://users:80")])
    repo["tools/cron.yaml"] = workload("cron", "acme/cron:1", "tools", env=[("USERS_URL", "http://users:80")])
    return repo


def two_projects():
    """The same stack with the same namespace in two trees."""
    use = {"valueFrom": {"configMapKeyRef": {"name": "cfg", "key": "DB_HOST"}}}
    one = {"web.yaml": workload("web", "acme/web:1", env=[("API_URL", "http://api-svc:80"), ("DB_HOST", use)]), "svc.yaml": service("api-svc", {"app": "api"}),
           "api.yaml": workload("api", "acme/api:1"), "db.yaml": workload("db", "postgres:16"),
           "cfg.yaml": {"apiVersion": "v1", "kind": "ConfigMap", "metadata": {"name": "cfg", "namespace": "prod"}, "data": {"DB_HOST": "db:5432"}}}
    return {f"{p}/{name}": body for p in ("shop", "blog/x") for name, body in one.items()}


def files_of(spark, repos):
    rows = [(repo, path, len(str(body)), 0, body if isinstance(body, str) else json.dumps(body))
            for repo, files in repos.items() for path, body in files.items()]
    return spark.createDataFrame(rows, "repo string, path string, size long, mtime long, content string")


def graphs_of(tables):
    """{repo: {table: rows}} of a scan."""
    rows = {name: df.collect() for name, df in tables.items()}
    return {r.repo: {name: [x for x in found if x.repo == r.repo] for name, found in rows.items()} for r in rows["stats"]}


@pytest.fixture(scope="module")
def plain(spark):
    """Several repositories in one scan, nothing declared."""
    return graphs_of(sc.scan(files_of(spark, {
        "r": cluster_repo(), "s": cluster_repo(), "env": environments(), "twins": two_projects(), "empty": {"README.md": "hello"}})))


@pytest.fixture(scope="module")
def declared(spark):
    """Several repositories in one scan with projects, resources, corrections, a further job and its message."""
    jobs = built_in()

    def procfile(files):
        return {"diagnostics": shaped(files, "diagnostics", severity="info", code="procfile_seen", message="web")}

    jobs.register("procfile", F.col("name") == "Procfile", procfile)
    resources = spark.createDataFrame([
        ("infra", "infra/a.tf", "aws_lambda_function", "fn", "resource", "aws_sqs_queue.jobs", "queue_url", 0, None, 1),
        ("infra", "infra/b.tf", "aws_sqs_queue", "jobs", "resource", None, None, 1, None, 1),
        ("infra", "infra/a.tf", "aws_iam_thing", "x", "resource", None, None, 0, None, 9)],
        "repo string, path string, type string, name string, block string, ref_address string, ref_attr string, has_count int, source string, line int")
    same = spark.createDataFrame([("r", 1, 0, "users.prod"), ("r", 1, 1, "orders")], sc.SAME)
    rules = spark.createDataFrame([
        ("r", 2, "add", "users", "pg", "persists_to", "mysql", "it does"), ("r", 3, "remove", "api-gateway", "api.stripe.com", "", None, ""),
        ("r", 4, "add", "edge", "pg", "", "tcp", ""), ("r", 5, "add", "orders", "pg", "", None, "folded away"),
        ("r", 6, "remove", "edge", "pg", "", None, ""), ("r", 7, "add", "api-gateway", "pg", "calls", "grpc", " why ")], sc.RULES)
    repos = {"r": cluster_repo(), "twins": two_projects(), "infra": {"Procfile": "x", "a/Procfile": "y"}}
    projects = spark.createDataFrame([("twins", "shop"), ("twins", "blog/x")], "repo string, root string")
    formatters = FORMATTERS | {"procfile_seen": counted("one process file", "{n} process files", listed=True)}
    return graphs_of(sc.scan(files_of(spark, repos), resources, projects, rules, same, jobs, formatters))


@pytest.fixture
def cluster(plain):
    return plain["r"]


def arrows(graph):
    return {(r.src, r.kind, r.dst) for r in graph["edges"] if r.kind != "contains"}


def codes(graph):
    return {r.code for r in graph["diagnostics"]}


def test_a_cluster_repository_is_connected(cluster):
    at = "container:@prod/"
    want = {(at + "api-gateway", "calls", at + "users"), (at + "api-gateway", "calls", at + "orders"),
            (at + "api-gateway", "calls", "context:api.stripe.com"), (at + "users", "persists_to", at + "pg"),
            (at + "edge", "exposes", at + "users"), (at + "orders", "calls", at + "users"), (at + "orders", "calls", "context:stripe")}
    assert want <= arrows(cluster)
    assert {"context:smtp.example.org", "context:@prod/prod"} <= {r.id for r in cluster["nodes"]}


def test_code_hands_its_facts_to_what_runs_it(cluster):
    nodes = {r.id: r for r in cluster["nodes"]}
    assert not any(r.id.startswith("container:src/") for r in cluster["nodes"])
    users, orders = nodes["container:@prod/users"], nodes["container:@prod/orders"]
    assert (users.tech.language, users.attrs["module"], users.attrs["goVersion"], users.attrs["baseImage"]) == (
        "go", "github.com/acme/users-api", "1.22", "golang:1.22")
    assert (orders.tech.framework, orders.attrs["package"], orders.attrs["nodeVersion"]) == ("express", "@acme/orders", ">=20")
    # what only the workload's own file says stays
    assert users.images == ["ghcr.io/acme/users:3"] and users.attrs["replicas"] == "2" and users.tech.runtime == "kubernetes"
    where = {r.path for r in cluster["sources"] if r.id == users.id}
    assert {"deploy/users.yaml", "src/users/go.mod", "src/users/Dockerfile"} <= where


def test_every_edge_has_evidence_and_ends(cluster):
    ids = {r.id for r in cluster["nodes"]}
    spoken = {r.edge_id for r in cluster["evidence"]}
    assert all(r.id in spoken and r.src in ids and r.dst in ids for r in cluster["edges"])
    rules = {(r.rule, r.path) for r in cluster["evidence"]}
    assert ("external_host", "deploy/gateway.yaml") in rules and ("dependency_names_vendor", "src/orders/package.json") in rules
    through = [r for r in cluster["evidence"] if "ConfigMap" in r.detail]
    assert through and all(r.path == "deploy/gateway.yaml" for r in through)


def test_what_could_not_be_read_is_said(cluster):
    assert codes(cluster) >= {"k8s_parse_failed", "k8s_patch_fragment", "unmatched_service_selector", "unresolved_reference",
                              "code_joined_to_deployment", "unsupported_format", "env_placeholder_reference"}
    assert "hunter2" not in str(cluster)
    stats, = cluster["stats"]
    assert stats.files_scanned == len(cluster_repo()) and stats.files_parsed == len(cluster_repo()) - 1


def test_repositories_do_not_touch(plain):
    """The same files in two repositories give the same graph twice."""
    one, two = ({(r.src, r.dst, r.kind, r.protocol, r.conf_pct) for r in plain[repo]["edges"]} for repo in "rs")
    assert one == two and len(one) > 10
    assert plain["empty"]["nodes"] == [] and plain["empty"]["edges"] == [] and plain["empty"]["stats"][0].files_scanned == 1


def test_environments_are_not_mixed(plain):
    """A reference from outside all namespaces that have the name is refused, one from inside is not."""
    graph = plain["env"]
    assert arrows(graph) == {("container:@dev/web", "calls", "container:@dev/users")}
    assert {r.code for r in graph["diagnostics"] if r.path == "tools/cron.yaml"} == {"ambiguous_reference"}


def test_projects_keep_apart(plain, declared):
    """Ids, edges, aliases and config maps of a project are qualified together; undeclared, two trees are read as one."""
    want = set()
    for label in ("shop-prod", "blog-x-prod"):
        want |= {(f"container:@{label}/web", "calls", f"container:@{label}/api"), (f"container:@{label}/web", "persists_to", f"container:@{label}/db")}
    assert arrows(declared["twins"]) == want
    assert {r.project for r in declared["twins"]["nodes"]} == {"shop", "blog/x"}
    assert len([r for r in plain["twins"]["nodes"] if r.kind == "service"]) == 2


def test_resources_resolve_across_files(declared):
    graph = declared["infra"]
    assert arrows(graph) == {("container:aws_lambda_function.fn", "publishes_to", "container:aws_sqs_queue.jobs")}
    assert "terraform_unexpanded" in codes(graph)


def test_corrections_come_in_order(declared):
    """Components are folded first; rules then name what is left, and their notes and protocols become evidence."""
    graph, at = declared["r"], "container:@prod/"
    nodes = {r.id: r for r in graph["nodes"]}
    assert at + "orders" not in nodes and "context:api.stripe.com" not in nodes
    users = nodes[at + "users"]
    assert users.attrs["package"] == "@acme/orders" and users.tech.framework != "express" and users.attrs["goVersion"] == "1.22"
    assert {r.path for r in graph["sources"] if r.id == users.id} >= {"deploy/orders.yaml", "src/orders/package.json", "deploy/users.yaml"}
    edges = {(r.src, r.kind, r.dst): r for r in graph["edges"]}
    known, new = edges[(users.id, "persists_to", at + "pg")], edges[(at + "api-gateway", "calls", at + "pg")]
    assert (known.protocol, known.conf_pct, new.protocol) == ("postgres", 100, "grpc")
    assert (users.id, "calls", users.id) not in edges and (at + "edge", "depends_on", at + "pg") not in edges
    assert {r.detail for r in graph["evidence"] if r.rule == "declared_override"} == {"it does", "why"}
    assert ("override_unresolved", "rule 5: a component it names is not in the graph") in {(r.code, r.message) for r in graph["diagnostics"]}


def test_own_jobs_and_messages(declared):
    assert {(r.path, r.message) for r in declared["infra"]["diagnostics"] if r.code == "procfile_seen"} == {
        ("Procfile", "one process file: web"), ("a/Procfile", "one process file: web")}


def test_donors_fill_gaps_in_order(spark):
    """Per field and attribute the first donor that knows it; what is known stays, what describes the donor's own file too."""
    layout = ("repo string, id string, tech struct<language:string,framework:string,runtime:string>, images array<string>, ports array<int>, "
              "labels map<string,string>, directory string, build_context string, attrs map<string,string>")
    nodes = spark.createDataFrame([
        ("r", "z", ("go", "", ""), [], [], {}, None, None, {"version": "1"}),
        ("r", "a", ("py", "", "k8s"), ["i"], [], {"l": "1"}, "d", "b", {"version": "2", "module": "m", "own": "x"}),
        ("r", "b", ("", "flask", "vm"), [], [80], {}, "e", None, {"module": "n", "package": "p"})], layout)
    merges = spark.createDataFrame([("r", "a", "z"), ("r", "b", "z")], "repo string, absorbed string, survivor string")
    got = {r.id: r for r in merge.contribute_all(nodes, merges).collect()}
    z = got["z"]
    assert (tuple(z.tech), z.directory, z.ports, z.images, z.attrs) == (
        ("go", "flask", "k8s"), "d", [80], [], {"version": "1", "module": "m", "package": "p"})
    assert got["a"].attrs == {"version": "2", "module": "m", "own": "x"}
    whole = {r.id: r for r in merge.contribute_all(nodes, merges, None).collect()}["z"]
    assert (tuple(whole.tech), whole.images, whole.build_context, whole.attrs["own"], whole.labels) == (("go", "", ""), ["i"], "b", "x", {"l": "1"})
