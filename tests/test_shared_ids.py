"""Different edges whose short ids are equal stay different (pairs found among 31 million generated edges)."""

import pytest

from archgraph.operators import merge, queries

ROW = ("repo string, src string, dst string, kind string, protocol string, conf_pct int, rule string, path string, line int, "
       "detail string, extractor string")


def row(src, dst, conf, kind="persists_to", protocol="postgres", rule="name_exact", path="o.yaml"):
    return ("a", f"container:@{src}", f"container:@{dst}", kind, protocol, conf, rule, path, 1, "d", "dotenv")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        row("ns-3/svc-13403", "ns-1/db-5379", 40, path="b.yaml"), row("ns-3/svc-15313", "ns-0/db-6060", 100, path="a.yaml"),
        row("ns-3/svc-15313", "ns-0/db-6060", 40, "depends_on", None)], ROW)


def test_the_pair_shares_its_id(rows):
    assert merge.merge_edges(rows.where("kind = 'persists_to'")).select("id").distinct().count() == 1


def test_rules_count_both(spark, rows):
    none = spark.createDataFrame([], "repo string, kind string, layer string, severity string")
    got = queries.counts(none, merge.merge_edges(rows), rows, none).where("what = 'rule'").collect()
    assert [(r["value"], r["n"]) for r in got] == [("name_exact", 3)]


def test_both_have_their_first_evidence(rows):
    assert sorted(r["path"] for r in merge.top_evidence(rows).collect()) == ["a.yaml", "b.yaml", "o.yaml"]


def test_each_keeps_its_confidence_and_what_was_folded_into_it(rows):
    got = merge.collapsed(merge.merge_edges(rows)).collect()
    assert sorted((r["src"][-9:], r["conf_pct"], r["n_folded"]) for r in got) == [("svc-13403", 40, 0), ("svc-15313", 100, 1)]
