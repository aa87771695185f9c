"""Forms and network names are made distinct by tasks cut by rows, however well they compress."""

from archgraph import session
from archgraph.operators import nodes as nd


def test_many_forms_are_many_tasks(spark, monkeypatch):
    raw = spark.createDataFrame(
        [("r", f"container:svc-{i}", "service", "container", f"svc-{i}", None, None, None, None, None, None, None, None, None, None, "x", 1, 100)
         for i in range(40)],
        "repo string, id string, kind string, layer string, name string, namespace string, project string, language string, framework string, "
        "image string, port int, labels string, directory string, build_context string, name_from string, path string, line int, conf_pct int")
    names = spark.createDataFrame([("r", f"container:svc-{i % 40}", f"svc-{i % 40}", "prod") for i in range(80)],
                                  "repo string, node_id string, name string, namespace string")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        monkeypatch.setattr(nd, "parts_of", lambda s, rows: session.parts_of(s, rows, 20), raising=False)
        monkeypatch.setattr(nd, "parts_for", lambda df, each: session.parts_for(df, 10), raising=False)
        dns = nd.alias_dns(names)
        assert dns.rdd.getNumPartitions() == 8
        forms = nd.identity_forms(nd.typed_nodes(raw), dns)
        n = dns.count()
        assert forms.rdd.getNumPartitions() == -(-(9 * 40 + 3 * n) // 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = [tuple(r) for r in forms.collect()]
    assert len(rows) == len(set(rows)) and n == dns.distinct().count()
    assert {r[3] for r in rows} == {f"container:svc-{i}" for i in range(40)}
