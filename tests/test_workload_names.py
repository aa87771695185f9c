"""A workload's names meet its directories only where code has them."""

from archgraph.operators import joins


def test_names_without_code_do_not_meet_directories(spark):
    image = ["ghcr.io/acme/web:1"]
    nodes = spark.createDataFrame(
        [("r", "dep", ".", "a/x.yaml", None, None, image), ("r", "code", ".", "services/web/go.mod", "services/web", None, [])],
        "repo string, id string, project string, path string, directory string, build_context string, images array<string>")
    forms = spark.createDataFrame(
        [("r", "name", f"web-{i}.ns.svc", "dep") for i in range(50)] + [("r", "name", "web", "dep"), ("r", "image", "ghcr.io/acme/web", "dep")],
        "repo string, form_kind string, form string, node_id string")
    sources = spark.createDataFrame([("r", "dep", f"d{i}/x{j}.yaml") for i in range(30) for j in range(3)], "repo string, id string, path string")
    codes = joins.code_keys(nodes, forms)
    rows = joins.deployment_keys(nodes, forms, codes, sources).collect()
    assert {r.key for r in rows} == {"web"} and len(rows) == 30
    assert [tuple(r) for r in joins.basename_join(nodes, forms, sources).collect()] == [("r", "code", "dep")]
