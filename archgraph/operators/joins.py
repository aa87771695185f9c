"""Joins between code, deployments, directories, config maps and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import ids, paths
from archgraph.session import by_shuffle, durable


# ------------------------------------------------------- code <-> deployments
def build_context_join(nodes: DataFrame) -> DataFrame:
    """(repo, code, deployment): the one component living in the directory a
    deployment says it is built from."""
    homes = nodes.where("directory <> ''").groupBy("repo", F.col("directory").alias("build_context")).agg(
        F.count("*").alias("n"), F.min("id").alias("code"))
    return (nodes.where("build_context <> ''").select("repo", F.col("id").alias("deployment"), "build_context")
            .join(homes.where("n = 1"), ["repo", "build_context"]).where("code <> deployment")
            .select("repo", "code", "deployment"))


def _segment(dir_: Column) -> Column:
    """First path segment; '' for the root, which shares no prefix with anything."""
    return F.when(dir_ == ".", F.lit("")).otherwise(F.substring_index(dir_, "/", 1))


def code_keys(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """Names a codebase may be looked up by: its directory's last segment and
    every name it has."""
    code = nodes.where((F.coalesce("directory", F.lit("")) != "") & (F.size("images") == 0)).select(
        "repo", "project", F.col("id").alias("code"), paths.normalize_dir(F.col("directory")).alias("dir"), "directory")
    base = code.select("repo", "project", "code", "dir", F.lower(F.substring_index("directory", "/", -1)).alias("key")).where(
        ~F.col("key").isin("", "."))
    names = forms.where("form_kind = 'name'").select("repo", F.col("node_id").alias("code"), F.col("form").alias("key"))
    return base.unionByName(code.join(names, ["repo", "code"]).select("repo", "project", "code", "dir", "key")).distinct()


def deployment_keys(nodes: DataFrame, forms: DataFrame, codes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Names a workload shares with any code (``codes``, of ``code_keys``): its
    own and its images', from every directory that declares it (``sources``:
    repo, id, path). A workload may have many names and many directories, so
    names that no code has are gone before the two meet."""
    runs = nodes.where((F.coalesce("build_context", F.lit("")) == "") & (F.size("images") > 0))
    if sources is not None:
        runs = runs.drop("path").join(sources.select("repo", "id", "path").distinct(), ["repo", "id"])
    runs = runs.select("repo", "project", F.col("id").alias("deployment"), paths.normalize_dir(paths.dir_of(F.col("path"))).alias("dir"))
    names = forms.where("form_kind IN ('name', 'image')").select(
        "repo", F.col("node_id").alias("deployment"),
        F.when(F.col("form_kind") == "image", F.substring_index("form", "/", -1)).otherwise(F.col("form")).alias("key"))
    names = names.join(codes.select("repo", "key").distinct(), ["repo", "key"], "left_semi").distinct()
    return runs.distinct().join(names, ["repo", "deployment"]).select("repo", "project", "deployment", "dir", "key")


def basename_join(nodes: DataFrame, forms: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(repo, code, deployment) claims by shared name, where a deployment has
    exactly one candidate in its own project tree.

    Same tree: the declared project decides if there is one; otherwise the
    declaring directory lies at or above the code, or the two part at the root.
    The number of candidates is never listed: per key the least and greatest
    code id outside the deployment's top directory, and those below its own
    directory, are enough to tell whether there is exactly one. A key like
    'web' therefore costs one row per top directory, however many hold it.
    """
    codes = durable(code_keys(nodes, forms), "codes")
    deps = durable(deployment_keys(nodes, forms, codes, sources), "deployments")
    key = ["repo", "project", "key"]
    by_segment = codes.groupBy(*key, _segment(F.col("dir")).alias("seg")).agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    ends = by_segment.groupBy(*key).agg(F.min(F.struct("lo", "seg")).alias("first"), F.max(F.struct("hi", "seg")).alias("last"))
    others = by_segment.join(ends, key).groupBy(*key).agg(
        F.first("first").alias("first"), F.first("last").alias("last"),
        F.min(F.when(F.col("seg") != F.col("first.seg"), F.col("lo"))).alias("next_lo"),
        F.max(F.when(F.col("seg") != F.col("last.seg"), F.col("hi"))).alias("next_hi"))
    anywhere = (F.col("project") != ".") | (F.col("dir") == ".")
    seg = _segment(F.col("dir"))
    # a root codebase ('' segment) parts from every directory, so it always counts
    apart = deps.join(others, key).select(
        "repo", "deployment",
        F.when(anywhere | (F.col("first.seg") != seg), F.col("first.lo")).otherwise(F.col("next_lo")).alias("lo"),
        F.when(anywhere | (F.col("last.seg") != seg), F.col("last.hi")).otherwise(F.col("next_hi")).alias("hi"))
    below = codes.where("dir <> '.'").select(*key, "code", F.explode(paths.ancestor_prefixes(F.col("dir"))).alias("dir")).groupBy(
        *key, "dir").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    governed = deps.where(~anywhere).join(below, [*key, "dir"]).select("repo", "deployment", "lo", "hi")
    return (apart.unionByName(governed).where("lo IS NOT NULL").groupBy("repo", "deployment")
            .agg(F.min("lo").alias("code"), F.max("hi").alias("hi")).where("code = hi").select("repo", "code", "deployment"))


def code_merges(nodes: DataFrame, forms: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(repo, absorbed, survivor, how): claims that are unique both ways."""
    claims = build_context_join(nodes).withColumn("how", F.lit("build_context")).unionByName(
        basename_join(nodes, forms, sources).withColumn("how", F.lit("basename")))
    return claims.groupBy("repo", F.col("code").alias("absorbed")).agg(
        F.count("*").alias("n"), F.min("deployment").alias("survivor"), F.min("how").alias("how")).where("n = 1").drop("n")


def cross_project_report(nodes: DataFrame, forms: DataFrame, merges: DataFrame) -> DataFrame:
    """Unmerged codebases that share a key with deployments of other project
    trees: (repo, code, key, n_refused). Counted per key, not paired."""
    codes = code_keys(nodes, forms).join(merges.select("repo", F.col("absorbed").alias("code")), ["repo", "code"], "left_anti")
    codes = durable(codes, "codes")
    deps = durable(deployment_keys(nodes, forms, codes), "deployments")
    total = deps.groupBy("repo", "key").agg(F.count("*").alias("n_all"))
    same = deps.groupBy("repo", "project", "key").agg(F.count("*").alias("n_same"))
    local = deps.where("project = '.' AND dir <> '.'")
    beside = local.groupBy("repo", "key", _segment(F.col("dir")).alias("seg")).agg(F.count("*").alias("n_beside"))
    above = local.groupBy("repo", "key", "dir").agg(F.count("*").alias("n_above"))
    governed = (codes.where("project = '.'").select("repo", "code", "key", F.explode(paths.ancestor_prefixes(F.col("dir"))).alias("dir"))
                .join(above, ["repo", "key", "dir"]).groupBy("repo", "code", "key").agg(F.sum("n_above").alias("n_above")))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = (codes.withColumn("seg", F.when((F.col("project") == ".") & (F.col("dir") != "."), _segment(F.col("dir"))).otherwise("\x00"))
           .join(total, ["repo", "key"]).join(same, ["repo", "project", "key"], "left")
           .join(beside, ["repo", "key", "seg"], "left").join(governed, ["repo", "code", "key"], "left"))
    refused = F.col("n_all") - z(F.col("n_same")) + z(F.col("n_beside")) - z(F.col("n_above"))
    return out.select("repo", "code", "key", refused.alias("n_refused")).where("n_refused > 0")


# -------------------------------------------------------------- hint ownership
def directory_owner_join(hints: DataFrame, nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Bind hints that only know their directory: adds from_node where exactly
    one service lives in (or is built from) it, and n_owners."""
    where = nodes.where("kind = 'service'").select("repo", "id", F.explode(F.array_compact(F.array(
        F.when(F.col("directory") != "", F.col("directory")),
        F.when(F.col("build_context") != "", paths.normalize_dir(F.col("build_context")))))).alias("dir"))
    moved = where.join(by_shuffle(merges.select("repo", F.col("absorbed").alias("id"), "survivor")), ["repo", "id"], "left")
    kinds = nodes.select("repo", F.col("id").alias("owner"), F.col("kind").alias("owner_kind"))
    owners = (moved.select("repo", "dir", F.coalesce("survivor", "id").alias("owner")).distinct()
              .join(by_shuffle(kinds), ["repo", "owner"]).where("owner_kind = 'service'")
              .groupBy("repo", "dir").agg(F.count("*").alias("n_owners"), F.min("owner").alias("owner")))
    return (hints.withColumn("dir", paths.normalize_dir(F.col("owner_dir"))).join(by_shuffle(owners), ["repo", "dir"], "left")
            .withColumn("n_owners", F.coalesce("n_owners", F.lit(0)).cast("int"))
            .withColumn("from_node", F.when(F.col("n_owners") == 1, F.col("owner"))).drop("owner", "dir"))


def owner_diagnostics(bound: DataFrame) -> DataFrame:
    """One row per file whose hints found no owner, or several."""
    return bound.where("n_owners <> 1").groupBy("repo", "path").agg(F.max("n_owners").alias("n_owners")).select(
        "repo", "path", F.when(F.col("n_owners") == 0, F.lit("env_file_unowned")).otherwise("env_file_ambiguous_owner").alias("code"),
        F.when(F.col("n_owners") == 0, F.lit("info")).otherwise("warn").alias("severity"), "n_owners")


def configmap_join(uses: DataFrame, values: DataFrame) -> DataFrame:
    """Values of a config map become references of every workload that uses
    it. ``uses``: repo, ref, from_node, path, line, detail; ``values``: repo,
    ref, the reference's columns and its detail."""
    v = values.withColumnRenamed("detail", "value_detail").drop("path", "line", "from_node")
    return uses.withColumnRenamed("detail", "use_detail").join(v, ["repo", "ref"]).withColumn(
        "kind", F.lit("config_value")).withColumn(
        "detail", F.concat("use_detail", F.lit("; "), "value_detail")).drop("use_detail", "value_detail")


# ---------------------------------------------------------------- technologies
def library_corroboration(hints: DataFrame, nodes: DataFrame, forms: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, from_node, tech, target): a dependency names a technology that
    exactly one component has, and an edge to it exists already. It then adds
    evidence to that edge; it never draws one."""
    attrs = nodes.where("kind <> 'boundary'").select("repo", F.col("id").alias("node_id"), F.when(
        F.col("kind") == "external", F.lit("*")).otherwise(F.col("project")).alias("seen"))
    holders = forms.where("form_kind = 'tech'").join(attrs, ["repo", "node_id"]).groupBy(
        "repo", F.col("form").alias("tech"), "seen").agg(F.count("*").alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    me = nodes.select("repo", F.col("id").alias("from_node"), "project", F.col("tech.framework").alias("own_tech"))
    asks = hints.select("repo", "from_node", "tech").distinct().join(me, ["repo", "from_node"])
    probes = asks.withColumn("seen", F.explode(F.array("project", F.lit("*"))))
    own = ((F.col("own_tech") == F.col("tech")) & (F.col("seen") != "*")).cast("int")
    single = (probes.join(holders, ["repo", "tech", "seen"])
              .select("repo", "from_node", "tech", (F.col("n") - own).alias("n"), F.when(
                  (own == 1) & (F.col("lo") == F.col("from_node")), F.col("hi")).otherwise(F.col("lo")).alias("target"))
              .where("n > 0").groupBy("repo", "from_node", "tech").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
              .where("n = 1").drop("n"))
    drawn = edges.select("repo", F.col("src").alias("from_node"), F.col("dst").alias("target"))
    return single.join(drawn, ["repo", "from_node", "target"], "left_semi")


def uses_technology(hints: DataFrame) -> DataFrame:
    """(repo, from_node, tech): what a component's dependencies say it uses."""
    return hints.select("repo", "from_node", "tech").distinct()


def vendor_synthesis(hints: DataFrame, nodes: DataFrame, edges: DataFrame, corroborated: DataFrame) -> DataFrame:
    """Edges to companies known from a dependency only: one external per
    vendor, drawn where no edge of the component already leads to a target
    whose name contains the vendor."""
    from archgraph import vocab
    from archgraph.functions.deps import is_vendor

    vendors = F.array(*[F.lit(v) for v in vocab.words(vocab.VENDOR_TECHNOLOGIES)])
    names = nodes.select("repo", F.col("id").alias("dst"), F.lower("name").alias("lname"))
    reached = (edges.select("repo", "src", "dst").distinct().join(names, ["repo", "dst"])
               .select("repo", F.col("src").alias("from_node"),
                       F.explode(F.filter(vendors, lambda v: F.contains(F.col("lname"), v))).alias("tech")).distinct())
    wanted = hints.where(is_vendor(F.col("tech"))).groupBy("repo", "from_node", "tech").agg(
        F.min(F.struct("path", "dependency")).alias("m"))
    drawn = wanted.join(corroborated.select("repo", "from_node", "tech"), ["repo", "from_node", "tech"], "left_anti").join(
        reached, ["repo", "from_node", "tech"], "left_anti")
    return drawn.select(
        "repo", F.col("from_node").alias("src"), ids.node_id(F.lit("external"), F.lit(""), F.col("tech")).alias("dst"),
        F.col("tech").alias("dst_name"), F.lit("https").alias("protocol"), F.lit(40).alias("conf_pct"),
        F.lit("dependency_names_vendor").alias("rule"), F.col("m.path").alias("path"), F.col("m.dependency").alias("dependency"))
