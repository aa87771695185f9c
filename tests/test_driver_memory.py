"""Joins whose sides grow with the input go by shuffle, however well they compress."""

from pyspark.sql import functions as F

from archgraph.operators import queries


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _asked(spark):
    nodes = spark.range(3000).select(F.lit("a").alias("repo"), F.concat(F.lit("container:svc-"), "id").alias("id"),
                                     F.concat(F.lit("svc-"), (F.col("id") % 1000).cast("string")).alias("name"), F.lit("ns").alias("namespace"))
    asks = spark.range(2000).select(F.lit("a").alias("repo"), F.col("id").alias("ask_id"), F.concat(
        F.when(F.col("id") % 2 == 0, "svc-").otherwise("vc-"), "id").alias("ref"))
    return asks, nodes


def test_candidates_are_joined_by_shuffle(spark):
    asks, nodes = _asked(spark)
    out = queries.ref_candidates(asks, nodes)
    assert "BroadcastHashJoin" not in _plan(out)
    # svc-0, svc-2, ... have three components each; vc-N is part of every name that goes on from it
    names = [f"svc-{i}" for i in range(1000)]
    loose = sum(3 for i in range(1, 1000, 2) for n in names if f"vc-{i}" in n)
    assert out.count() == 500 * 3 + loose


def test_references_are_resolved_by_shuffle(spark):
    assert "BroadcastHashJoin" not in _plan(queries.resolve_refs(*_asked(spark)))
