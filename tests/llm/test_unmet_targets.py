"""Tempered shares that the cells at hand cannot meet are approached, not refused."""

import pytest

from archgraph.llm import mixing


def test_sparse_cells_come_as_near_as_their_rounds_bring_them(spark):
    # Language and source go hand in hand but for one cell, so both cannot be tempered at once.
    cells = [("a", "en", 1000), ("b", "de", 10), ("c", "de", 400)]
    docs = spark.createDataFrame([(i, "w " * n, lang, source) for i, (source, lang, n) in enumerate(cells)],
                                 "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="after 6 rounds a marginal is"):
        rows = mixing.weigh(docs, rounds=6).collect()
    assert {r.source for r in rows} == {"a", "b", "c"} and all(r.weight > 0 for r in rows)
    with pytest.raises(ValueError, match="cannot be met together"):
        mixing.weigh(docs, patience=4)
