"""Positions and running totals that survive a group of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.session import durable


def running(df: DataFrame, group: list[str], order: list[Column], cost: Column | None = None,
            out: str = "position") -> DataFrame:
    """Add the inclusive running total of ``cost`` (default 1: the 1-based
    position) inside each group, in ``order``.

    A window over the group alone would put a whole repository into one task.
    Here rows are range-partitioned by (group, order), totals are kept per
    (group, partition), and only those totals are accumulated. The partitioned
    rows are written once, so that both passes see the same partitions.
    """
    weight = F.lit(1).cast("bigint") if cost is None else cost.cast("bigint")
    keys = [F.col(c) for c in group]
    placed = durable(
        df.withColumn("_w", weight).repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()),
        "ranked")
    totals = placed.groupBy(*group, "_pid").agg(F.sum("_w").alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(
        Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (placed.withColumn("_run", F.sum("_w").over(inside)).join(before, [*group, "_pid"])
            .withColumn(out, F.col("_run") + F.col("_before")).drop("_w", "_pid", "_run", "_before"))


#: The canonical order of a graph's tables.
CANONICAL = {"nodes": ["id"], "edges": ["src", "dst", "kind", "protocol", "id"], "diagnostics": ["path", "line", "code", "severity", "message"]}


def canonical_order(df: DataFrame, table: str) -> DataFrame:
    """Rows of one of a graph's tables with their position in their repository."""
    return running(df, ["repo"], [F.col(c) for c in CANONICAL[table]])


def page(df: DataFrame, group: list[str], order: list[Column], cursor: int, size: int) -> DataFrame:
    """``size`` rows per group from offset ``cursor``; an offset outside the
    group starts again at 0. Only the rows up to the page's end are ranked."""
    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    start = F.when((F.lit(cursor) < 0) | (F.lit(cursor) >= F.col("_n")), F.lit(0)).otherwise(cursor)
    ranked = top_per_group(df, group, order, max(cursor, 0) + size).withColumnRenamed("rank", "position").join(n, group)
    ranked = ranked.withColumn("position", F.col("position").cast("bigint"))
    return ranked.where((F.col("position") > start) & (F.col("position") <= start + size)).drop("_n")


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], text: str, budget: int,
                  header_tokens: int = 0) -> DataFrame:
    """Longest prefix of each group whose token cost fits the budget, with how
    many rows the group has in all. A row costs at least 1, so the prefix has
    at most ``budget`` rows; only so many are ranked and summed up."""
    from archgraph.functions.text import estimate_tokens

    total = df.groupBy(*group).agg(F.count("*").alias("total"))
    costs = df.withColumn("cost", F.greatest(F.coalesce(estimate_tokens(F.col(text)), F.lit(1)), F.lit(1)))
    first = top_per_group(costs, group, order, max(budget - header_tokens, 0))
    upto = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = first.withColumn("spent", F.sum(F.col("cost").cast("bigint")).over(upto)).drop("rank")
    return spent.where(F.col("spent") + header_tokens <= budget).join(total, group)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group. The rank filter becomes a per-task limit
    before the shuffle, so a large group sends k rows per task, not itself."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
