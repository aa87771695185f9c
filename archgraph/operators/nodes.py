"""Typed node tables and the forms a component can be called by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import ids
from archgraph.functions.images import parse_image
from archgraph.functions.net import dns_names
from archgraph.session import parts_for, parts_of


#: Attributes that hold a further name of a component.
NAMING_ATTRS = ["name", "address", "terraformModule"]
#: Rows that a component, and one of its network names, may well become.
FORMS_OF_NODE, FORMS_OF_DNS = 9, 3


def labels_map(kv: Column) -> Column:
    """'a=1;b=2' -> map; empty or NULL text gives an empty map."""
    pairs = F.filter(F.split(F.coalesce(kv, F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_arrays(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)),
                             F.transform(pairs, lambda p: F.regexp_replace(p, "^[^=]*=", "")))


def typed_nodes(raw: DataFrame) -> DataFrame:
    """The node table every operator expects, from a flat description."""
    return raw.select(
        "repo", "id", "kind", "layer", "name",
        F.coalesce("namespace", F.lit("")).alias("namespace"),
        F.coalesce("project", F.lit(".")).alias("project"),
        F.struct(F.coalesce("language", F.lit("")).alias("language"),
                 F.coalesce("framework", F.lit("")).alias("framework"),
                 F.lit("").alias("runtime")).alias("tech"),
        F.array_compact(F.array("image")).alias("images"),
        F.array_compact(F.array("port")).alias("ports"),
        labels_map(F.col("labels")).alias("labels"),
        "directory", "build_context", "name_from", "path", "line", "conf_pct")


def identity_forms(nodes: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """One row per (node, form): repo, form_kind, form, node_id.

    form_kind is dns, name, norm (name without separators), image, tech or
    dir. ``dns`` holds (repo, node_id, dns) rows attached by aliases; a network
    name is also a plain name. Boundaries take part in no reference, so they
    contribute no form. Both tables are counted first: forms are short and alike,
    and tasks cut by their compressed bytes would hold tens of millions.
    """
    parts = parts_of(nodes.sparkSession, FORMS_OF_NODE * nodes.count() + (FORMS_OF_DNS * dns.count() if dns is not None else 0))
    n = nodes.where("kind <> 'boundary'")
    image = F.explode(F.transform("images", lambda i: F.struct(
        i.alias("full"), parse_image(i).alias("parts")))).alias("image")
    images = n.select("repo", F.col("id").alias("node_id"), image)
    by_image = images.select(
        "repo", "node_id", F.explode(F.array("image.full", "image.parts.repository", "image.parts.name")).alias("form"))
    names = n.select(
        "repo", F.col("id").alias("node_id"),
        F.explode(F.array_distinct(F.array(F.col("name"), F.substring_index(ids.parse_node_id(F.col("id"))["name"], "/", -1)))).alias("form"))
    names = names.unionByName(images.select("repo", "node_id", F.col("image.parts.name").alias("form")))
    if "attrs" in n.columns:
        names = names.unionByName(n.select("repo", F.col("id").alias("node_id"), F.explode(F.array_compact(
            F.array(*[F.try_element_at("attrs", F.lit(a)) for a in NAMING_ATTRS]))).alias("form")))
    external = n.where("kind = 'external'").select("repo", F.col("id").alias("node_id"), F.col("name").alias("form"))
    network = external
    if dns is not None:
        network = network.unionByName(dns.select("repo", "node_id", F.col("dns").alias("form")))
    lower = F.lower(F.btrim("form"))
    named = names.unionByName(network).select("repo", "node_id", lower.alias("form")).where("form <> ''")

    def tag(df: DataFrame, kind: str, form: Column) -> DataFrame:
        return df.select("repo", F.lit(kind).alias("form_kind"), form.alias("form"), "node_id")

    tech = n.where("tech.framework <> ''").select("repo", F.col("id").alias("node_id"), F.col("tech.framework").alias("form"))
    dirs = n.where("directory <> ''").select("repo", F.col("id").alias("node_id"), F.col("directory").alias("form"))
    return (
        tag(network, "dns", F.lower("form"))
        .unionByName(tag(named, "name", F.col("form")))
        .unionByName(tag(named, "norm", ids.normalize_name(F.col("form"))))
        .unionByName(tag(by_image, "image", F.lower("form")))
        .unionByName(tag(tech, "tech", F.col("form")))
        .unionByName(tag(dirs, "dir", F.col("form")))
        .where("form <> ''").repartition(parts, "repo", "form_kind", "form", "node_id").distinct())


def alias_dns(alias_names: DataFrame) -> DataFrame:
    """Explode resolved aliases (repo, node_id, name, namespace), a written table, to DNS forms."""
    names = alias_names.select("repo", "node_id", F.explode(dns_names(F.col("name"), F.col("namespace"))).alias("dns"))
    return names.repartition(parts_for(alias_names, 250_000), "repo", "node_id", "dns").distinct()
