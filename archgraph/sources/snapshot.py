"""Snapshots at rest, and whether one can still be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph import vocab

#: The tables of a graph with their layouts and row orders. Labels are kept as sorted entries, so that rows compare.
TABLES = {
    "nodes": ("repo string, id string, kind string, layer string, name string, namespace string, project string, "
              "tech struct<language:string,framework:string,runtime:string>, images array<string>, ports array<int>, "
              "labels array<struct<key:string,value:string>>, directory string, build_context string, name_from string, "
              "path string, line int, conf_pct int", ["id"]),
    "edges": ("repo string, id string, src string, dst string, kind string, protocol string, conf_pct int",
              ["src", "dst", "kind", "protocol", "id"]),
    "evidence": ("repo string, edge_id string, rule string, path string, line int, detail string, extractor string",
                 ["edge_id", "rule", "path", "line", "detail", "extractor"]),
    "sources": ("repo string, id string, path string, line int, extractor string", ["id", "path", "line", "extractor"]),
    "diagnostics": ("repo string, severity string, code string, path string, line int, message string",
                    ["path", "line", "code", "message"]),
    "stats": ("repo string, files_scanned bigint, files_parsed bigint", ["files_scanned"]),
}
EDGE = TABLES["edges"][0]


def layout_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name][0])


def canonical(df: DataFrame, name: str) -> DataFrame:
    """Distinct rows in canonical order. Equal rows lie in one range, so that
    finding them takes no shuffle of its own."""
    layout, order = layout_of(name), TABLES[name][1]
    if name == "nodes":
        df = df.withColumn("labels", F.array_sort(F.map_entries("labels")))
    return (df.select(*[F.col(f.name).cast(f.dataType) for f in layout.fields])
            .repartitionByRange("repo", *order).distinct().sortWithinPartitions("repo", *order))


def write_snapshot(tables: dict[str, DataFrame], location: str, fmt: str = "parquet") -> None:
    """Canonical tables: distinct rows, partitioned by repo, range-sorted so
    that equal graphs give equal files and ids prune."""
    for name, df in tables.items():
        canonical(df, name).write.mode("overwrite").partitionBy("repo").format(fmt).save(f"{location}/{name}")


def read_snapshot(spark: SparkSession, location: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table with its declared layout, never an inferred one."""
    layout = layout_of(name)
    df = spark.read.schema(layout).format(fmt).load(f"{location}/{name}").select(*[f.name for f in layout.fields])
    return df.withColumn("labels", F.map_from_entries("labels")) if name == "nodes" else df


def graph_json(edges: DataFrame) -> DataFrame:
    """One JSON document per edge, fields in layout order."""
    return edges.select("repo", F.to_json(F.struct(*[f.name for f in layout_of("edges").fields])).alias("doc"))


def parse_graph_json(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", EDGE).alias("e")).select("e.*")


_VERSION = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:[-+].*)?$"


def schema_relation(stored: Column, current: str = vocab.SCHEMA_VERSION) -> Column:
    """same, older, newer or incompatible; the patch level does not matter."""
    major, minor = (int(x) for x in current.split(".")[:2])
    got = lambda i: F.regexp_extract(stored, _VERSION, i).try_cast("int")
    return (F.when(F.coalesce(got(1), F.lit(-1)) != major, F.lit("incompatible"))
            .when(got(2) == minor, F.lit("same")).when(got(2) < minor, F.lit("older")).otherwise("newer"))


def readable(relation: Column) -> Column:
    return relation != "incompatible"


def lossy(relation: Column) -> Column:
    return relation == "newer"


def staleness(snapshots: DataFrame, newest_input: DataFrame, producer: str) -> DataFrame:
    """Which stored graphs need a refresh, and whether they may be replaced.

    ``snapshots``: repo, stored, generated_at, producer; ``newest_input``:
    repo, newest (latest change) and n_deleted (paths gone since). A graph of a
    newer layout is served as it is and never overwritten.
    """
    s = snapshots.withColumn("relation", schema_relation(F.col("stored"))).join(newest_input, "repo", "left")
    changed = (F.coalesce("newest", F.lit(0)) > F.col("generated_at")) | (F.coalesce("n_deleted", F.lit(0)) > 0)
    stale = F.when(F.col("relation") == "newer", F.lit(False)).otherwise(
        (F.col("relation") != "same") | (F.col("producer") != producer) | changed)
    return s.select("repo", "relation", stale.alias("stale"), readable(F.col("relation")).alias("readable"),
                    (F.col("relation") != "newer").alias("replaceable"))
