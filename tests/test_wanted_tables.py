"""A table of a scan costs the steps that it needs."""

from archgraph.operators import scan as sc
from tests.test_scan import cluster_repo, files_of


def test_file_stats_resolve_nothing(spark, monkeypatch):
    labels, durable = [], sc.durable
    monkeypatch.setattr(sc, "durable", lambda df, label, by=None: labels.append(label) or durable(df, label, by))
    scan = sc.scan(files_of(spark, {"r": cluster_repo()}))
    stats = scan["stats"].collect()
    assert [(r.repo, r.files_scanned) for r in stats] == [("r", len(cluster_repo()))]
    assert sorted(labels) == ["aliases", "diagnostics", "edges", "hints", "nodes"]
