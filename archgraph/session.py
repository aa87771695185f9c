"""Session defaults and the durable hand-over between rounds of a loop."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Only settings that hold on any cluster size; memory and executor counts are
# the deployer's business.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(name: str = "archgraph", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. The cluster names it in
    ``spark.checkpoint.dir``; only on one machine may it be left unset, and a
    temporary folder is chosen."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def durable(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; with ``by``, in one
    folder per value of that column, so that reading one value prunes the rest.

    Loops call this once per round: the lineage ends here, a lost executor
    re-reads files instead of recomputing rounds, and file sizes give the next
    round's joins real statistics to choose a strategy from.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/archgraph/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, label: str, parts: int, *keys: str) -> DataFrame:
    """``durable`` in ``parts`` buckets by ``keys``: what is grouped or joined by
    these keys later, in as many parts, reads its bucket and shuffles nothing."""
    spark = df.sparkSession
    name = f"archgraph_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/archgraph/{name}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name, format="parquet")
    out = spark.read.table(name)
    out.schema  # resolved, so that the name can go; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def parts_of(spark: SparkSession, rows: int, rows_each: int = 1_000_000) -> int:
    """How many tasks a shuffle of so many rows needs, so that none gets more than about ``rows_each``: short, alike
    rows compress to little, and tasks cut by their bytes would get tens of millions. At least as many as are set."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def parts_for(df: DataFrame, rows_each: int = 1_000_000) -> int:
    """``parts_of`` the rows of a written table."""
    return parts_of(df.sparkSession, df.count(), rows_each)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table to ``archgraph.input.partitions`` tasks, where
    that is set: for single files whose rows take long to work on. Unset, the
    splits of the input stand."""
    wanted = df.sparkSession.conf.get("archgraph.input.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as a shuffle has, for work that costs far more than moving them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def together(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """What each of some independent steps returns, in their order. They run side by side: many
    short writes leave most of a cluster idle, one after the other."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. Millions of short, alike rows compress to
    a few megabytes, which Spark measures and would broadcast, through the
    driver, at a hundred times that size."""
    return df.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
