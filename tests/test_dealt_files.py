"""The files of one job are read by many tasks, whatever their size on disk."""

from pyspark.sql import functions as F

from archgraph.sources import builtin


def test_one_job_is_parsed_by_many_tasks(spark):
    files = spark.range(0, 400, 1, 1).select(F.lit("r").alias("repo"), F.concat(F.lit("apps/a"), "id", F.lit("/Dockerfile")).alias("path"),
                                             F.lit(20).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime"), F.lit("FROM golang:1.22\nCMD run").alias("content"))
    claimed, _ = builtin.built_in().claim(files)
    mine = claimed.where("job = 'dockerfile'")
    assert mine.count() == 400
    assert mine.rdd.getNumPartitions() >= 4
