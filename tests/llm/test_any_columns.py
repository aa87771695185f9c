"""Operators that keep the rows of a table keep its columns, whatever their names; targets that contradict each other."""

import pytest
from pyspark.sql import functions as F

from archgraph.llm import line_dedup, mixing, pii, trie_join

NAMES = "_gone _id _key _spans _hidden _row _d _r _removed row key found base cell chance n size component_id removed digest _h text2".split()
KEEPING = {"trie_join": trie_join.keep_one, "pii": pii.redact, "lines": line_dedup.clean, "mixing": lambda d: mixing.sample(d, share=1.0)}


@pytest.mark.parametrize("name", list(KEEPING))
def test_columns_of_any_name_come_through(spark, name):
    line = "this very line of more than ten words stands in two of the texts"
    rows = [(1, f"{line}\nmail me at a.b@example.org", "en", "s", None), (2, f"{line}\nother", "en", "s", 3), (3, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.concat_ws("-", F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in NAMES))
    out = KEEPING[name](docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, None}
    assert all(r[c] == f"{c}-{r.doc_id if r.doc_id is not None else 'none'}" for r in kept for c in NAMES)
    assert KEEPING[name](docs.where("false")).collect() == []


def test_contradictory_targets_are_an_error(spark):
    docs = spark.createDataFrame([(i, "w " * 10, *(("en", "a") if i % 2 else ("de", "b"))) for i in range(20)],
                                 "doc_id long, text string, lang string, source string")
    def share(**of):
        return spark.createDataFrame(list(of.items()), "value string, target double")
    with pytest.raises(ValueError, match="cannot be met together"):
        mixing.weigh(docs, targets={"source": share(a=0.9, b=0.1), "lang": share(en=0.1, de=0.9)}, patience=4).count()
    met = mixing.weigh(docs, targets={"source": share(a=0.9, b=0.1), "lang": share(en=0.9, de=0.1)}, patience=4).collect()
    assert {(r.source, r.weight) for r in met} == {("a", 1.8), ("b", 0.2)}
