"""Where catalogue modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archgraph.plans.fixtures import BASE_TABLES, VIEWS, duck_sql, spark_view
from archgraph.session import durable, spread

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


# whole texts: worth a round-robin exchange before heavy expressions
TEXT_TABLES = {"documents", "pages", "conversations"}

# (application, data folder, name) -> written table
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def forget_stages() -> None:
    """Drop the memo of everything computed from the input tables."""
    for key in [k for k in _TABLES if k[2] not in VIEWS]:
        del _TABLES[key]


class Inputs:
    """Access to the given and derived tables: ``inputs.fx_nodes`` is a
    DataFrame. Derived tables are written once per session, as an organisation
    would keep its node and edge tables at rest, so that plans start from
    scans with known sizes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = spark_view(self.spark, self.sf_dir, name)
            return spread(table) if name in TEXT_TABLES else table
        if name not in VIEWS:
            raise AttributeError(name)
        return self.table(name, lambda: spread(spark_view(self.spark, self.sf_dir, name)))

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _TABLES:
            _TABLES[key] = durable(build(), name)
        return _TABLES[key]


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a query; ``sql`` is its DuckDB counterpart, if one exists."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck_sql(sql, extra)
        return fn

    return register
