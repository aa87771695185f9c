"""A table at rest is shuffled once on its way there."""

from archgraph.sources import snapshot
from tests.test_few_shuffles import _edges


def test_a_table_at_rest_is_shuffled_once(spark):
    rows = snapshot.canonical(_edges(spark, "cd", "ab", "ab"), "edges")
    assert str(rows._jdf.queryExecution().executedPlan()).count("Exchange ") == 1
    assert [r.id for r in rows.collect()] == ["a>b", "c>d"]
