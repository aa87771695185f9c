"""A join on keys of any share equals a plain one, and broadcasts nothing of its own where no key is hot."""

import pytest
from pyspark.sql import functions as F

from archgraph.llm import common


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_a_plain_join(spark, tmp_path, how, hot):
    key = F.when((F.col("id") % 7 == 0) & F.lit(hot), 0).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 1500)
    left = spark.range(6000).select(key.alias("k"), F.col("id").alias("x"))
    right = spark.range(0, 1500, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("y"))
    left.groupBy("k").agg(F.count("*").alias("n")).where("k is not null").write.parquet(f"{tmp_path}/n")
    out = common.join_hot(left, right, "k", spark.read.parquet(f"{tmp_path}/n"), how)
    assert sorted(map(str, out.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == hot and "Cross" not in plan
