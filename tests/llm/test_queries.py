"""Registered queries over the smallest tables: SQL where there is some, whole results otherwise."""

import pandas as pd
import pytest
from check import compare, duck, frame

import __spark_entry__ as entry
import corpus_pipeline
from archgraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, name):
    left = frame(entry.queries()[name](spark, SF))
    cur = duck(SF).execute(entry.oracle_sql()[name])
    right = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
    assert compare(left, right) is None


def test_one_query_per_operator():
    names = list(QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(names) | {"pipeline"} <= set(entry.queries())


def test_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.persist()
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, near, personal, mixed, packed = seen
    assert set(before) > set(toxic) > set(near) and set(near) == set(personal) and set(personal) > set(mixed) == set(packed)
    assert any("[EMAIL]" in (r.text or "") for r in personal.values())
    assert all(r.n_chars == len(r.text) for r in personal.values() if "[EMAIL]" in (r.text or ""))
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == set(packed)
