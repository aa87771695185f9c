"""Names that route to a component: service selectors and named targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.operators.nodes import identity_forms, labels_map
from archgraph.session import durable


def typed_aliases(raw: DataFrame) -> DataFrame:
    return raw.select("repo", "alias_key", "name", "namespace", F.coalesce("project", F.lit(".")).alias("project"),
                      labels_map(F.col("selector")).alias("selector"),
                      F.coalesce("target_name", F.lit("")).alias("target_name"),
                      F.coalesce("external", F.lit("")).alias("external"), "port", "path", "line")


def selector_matches(selector: Column, labels: Column) -> Column:
    """Every selector entry is present and equal; an empty selector is not a
    wildcard, it selects nothing."""
    return (F.size(selector) > 0) & F.forall(
        F.map_entries(selector), lambda e: F.coalesce(F.try_element_at(labels, e["key"]) == e["value"], F.lit(False)))


def selector_alias_join(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many components each selector alias selects, and which if one.

    Label entries are counted per (repo, project, namespace) first. A selector
    of one entry is answered by that count alone; a longer one is joined on its
    rarest entry only and checked in full there. Equal selectors are solved
    once.
    """
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    place = ["repo", "project", "namespace"]
    wanted = aliases.where((F.col("external") == "") & (F.size("selector") > 0)).withColumn(
        "entries", F.array_sort(F.transform(F.map_entries("selector"), entry)))
    labelled = nodes.where(F.size("labels") > 0).select(
        *place, F.col("id").alias("node_id"), F.transform(F.map_entries("labels"), entry).alias("has"))
    per_entry = labelled.select(*place, "node_id", F.explode("has").alias("entry"))
    counts = per_entry.groupBy(*place, "entry").agg(F.count("*").alias("n"), F.min("node_id").alias("lo"))
    distinct = wanted.select(*place, "entries").distinct()
    probes = distinct.select(*place, "entries", F.explode("entries").alias("entry")).join(
        counts, [*place, "entry"], "left")
    rarest = probes.groupBy(*place, "entries").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entry", "lo")).alias("r"))
    short = rarest.where(F.size("entries") == 1).select(*place, "entries", F.col("r.n").alias("n"), F.col("r.lo").alias("lo"))
    long_ = rarest.where((F.size("entries") > 1) & (F.col("r.n") > 0)).select(*place, "entries", F.col("r.entry").alias("entry"))
    members = labelled.select(*place, "node_id", "has", F.explode("has").alias("entry"))
    checked = (long_.join(members, [*place, "entry"])
               .where(F.size(F.array_except("entries", "has")) == 0)
               .groupBy(*place, "entries").agg(F.count("*").alias("n"), F.min("node_id").alias("lo")))
    solved = short.unionByName(checked)
    out = wanted.join(solved, [*place, "entries"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(
        "repo", "alias_key", "name", "namespace", "port", "path", "line",
        F.array_join("entries", ",").alias("selector"), F.col("n").cast("int").alias("n_selected"),
        F.when(F.col("n") == 1, F.col("lo")).alias("node_id"),
        F.when(F.col("n") == 0, F.lit("unmatched_service_selector"))
        .when(F.col("n") > 1, F.lit("service_selects_many")).alias("code"))


def selector_counts(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many components of the repository each alias's selector matches,
    whatever its entries: equal selectors are solved once, by their rarest entry."""
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    wanted = aliases.select("repo", "alias_key", F.array_sort(F.transform(F.map_entries("selector"), entry)).alias("entries"))
    has = nodes.where(F.size("labels") > 0).select("repo", "id", F.transform(F.map_entries("labels"), entry).alias("has"))
    members = has.select("repo", "id", "has", F.explode("has").alias("entry"))
    counts = members.groupBy("repo", "entry").agg(F.count("*").alias("n"))
    probes = wanted.select("repo", "entries").distinct().select("repo", "entries", F.explode("entries").alias("entry"))
    rarest = probes.join(counts, ["repo", "entry"], "left").groupBy("repo", "entries").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entry")).alias("r")).where("r.n > 0")
    single = rarest.where(F.size("entries") == 1).select("repo", "entries", F.col("r.n").alias("n"))
    several = rarest.where(F.size("entries") > 1).select("repo", "entries", F.col("r.entry").alias("entry")).join(
        members, ["repo", "entry"]).where(F.size(F.array_except("entries", "has")) == 0)
    solved = single.unionByName(several.groupBy("repo", "entries").agg(F.count("*").alias("n")))
    return wanted.join(solved, ["repo", "entries"], "left").select("repo", "alias_key", F.coalesce("n", F.lit(0)).alias("n"))


def named_alias_join(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Aliases that name their target: attached only where one component has
    the name, after narrowing to the alias's namespace if that leaves any."""
    named = aliases.where((F.col("external") == "") & (F.size("selector") == 0) & (F.col("target_name") != ""))
    attrs = nodes.select("repo", F.col("id").alias("node_id"), F.explode(F.array_distinct(F.when(
        F.col("kind") == "external", F.array(F.lit("*"))).otherwise(F.array("project")))).alias("seen"), "namespace")
    # grouping names route nothing, but they do make a name ambiguous here
    forms = identity_forms(nodes.withColumn("kind", F.when(F.col("kind") == "boundary", F.lit("service")).otherwise(F.col("kind"))))
    holders = forms.where("form_kind = 'name'").join(attrs, ["repo", "node_id"])
    # read twice below
    counted = durable(holders.groupBy("repo", "form", "seen", "namespace").agg(
        F.count("*").alias("n"), F.min("node_id").alias("lo")), "holders")
    probes = named.select("repo", "alias_key", F.lower("target_name").alias("form"), F.col("namespace").alias("wanted"),
                          F.explode(F.array(F.col("project"), F.lit("*"))).alias("seen"))
    spread = counted.groupBy("repo", "form", "seen").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))
    everywhere = probes.join(spread, ["repo", "form", "seen"]).groupBy("repo", "alias_key").agg(
        F.sum("n").alias("n_all"), F.min("lo").alias("lo_all"))
    nearby = probes.join(counted.withColumnRenamed("namespace", "wanted"), ["repo", "form", "seen", "wanted"]).groupBy(
        "repo", "alias_key").agg(F.sum("n").alias("n_ns"), F.min("lo").alias("lo_ns"))
    out = named.join(everywhere, ["repo", "alias_key"], "left").join(nearby, ["repo", "alias_key"], "left")
    n = F.coalesce("n_ns", "n_all", F.lit(0))
    return out.select(
        "repo", "alias_key", "name", "namespace", "target_name", "port",
        n.cast("int").alias("n_targets"), F.when(n == 1, F.coalesce("lo_ns", "lo_all")).alias("node_id"))


def attached(selected: DataFrame, named: DataFrame) -> DataFrame:
    """Resolved aliases as (repo, node_id, name, namespace, port)."""
    cols = ["repo", "node_id", "name", "namespace", "port"]
    return selected.select(*cols).unionByName(named.select(*cols)).where("node_id IS NOT NULL")


def attach_ports(nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """Add the ports aliases expose for a component to the component."""
    extra = routes.groupBy("repo", F.col("node_id").alias("id")).agg(F.collect_set("port").alias("more"))
    return nodes.join(extra, ["repo", "id"], "left").withColumn(
        "ports", F.array_sort(F.array_union("ports", F.coalesce("more", F.array().cast("array<int>"))))).drop("more")
