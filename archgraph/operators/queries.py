"""Read queries over a finished graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.functions import ids
from archgraph.operators.graph import degree, graph_stats, relationships
from archgraph.operators.ranking import top_per_group
from archgraph.session import by_shuffle, durable


def with_labels(nodes: DataFrame) -> DataFrame:
    """Add ``label``: the name, qualified by namespace where it is shared.

    The share count is an aggregate joined back rather than a window, so a name
    carried by a large part of the nodes is counted map-side first.
    """
    shared = (nodes.groupBy("repo", F.lower("name").alias("_lname")).agg(F.count("*").alias("_n")))
    return (
        nodes.withColumn("_lname", F.lower("name")).join(shared, ["repo", "_lname"])
        .withColumn("label", F.when((F.col("_n") > 1) & (F.coalesce("namespace", F.lit("")) != ""),
                                    F.concat_ws(".", "name", "namespace")).otherwise(F.col("name")))
        .drop("_lname", "_n"))


def list_nodes(nodes: DataFrame, kind: str | None = None, layer: str | None = None, namespace: str | None = None,
               text: str | None = None) -> DataFrame:
    for column, wanted in (("kind", kind), ("layer", layer), ("namespace", namespace)):
        if wanted:
            nodes = nodes.where(F.lower(column) == wanted.lower())
    if text:
        needle = F.lit(text.lower())
        tech = ids.tech_string(F.col("tech.language"), F.col("tech.framework"), F.col("tech.runtime"))
        nodes = nodes.where(F.contains(F.lower("name"), needle) | F.contains(F.lower("id"), needle) | F.contains(F.lower(tech), needle))
    return nodes


def counts(nodes: DataFrame, edges: DataFrame, rows: DataFrame, diags: DataFrame) -> DataFrame:
    """Labelled counts per repo: kinds, layers, relationship kinds, severities,
    and edges per rule (an edge counts once for each rule it carries).
    ``rows``: edges with one piece of evidence each."""

    def count(df: DataFrame, what: str, column: str) -> DataFrame:
        return df.groupBy("repo", F.lit(what).alias("what"), F.col(column).alias("value")).agg(F.count("*").alias("n"))

    # by what edges join: two may share an id
    carried = rows.select("repo", "src", "dst", "kind", F.coalesce("protocol", F.lit("")).alias("protocol"), "rule").distinct()
    return (count(nodes, "kind", "kind").unionByName(count(nodes, "layer", "layer"))
            .unionByName(count(edges, "edge_kind", "kind")).unionByName(count(diags, "severity", "severity"))
            .unionByName(count(carried, "rule", "rule")))


def project_counts(nodes: DataFrame) -> DataFrame:
    per = nodes.where("kind <> 'boundary'").groupBy("repo", "project").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo").orderBy(F.desc("n"), "project")  # one row per project
    return per.withColumn("position", F.row_number().over(w))


def duplicated_names(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo", "name").agg(F.count("*").alias("n")).where("n > 1")


def redundant_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo", "name").agg(F.count("*").alias("n")).groupBy("repo").agg(
        F.sum(F.col("n") - 1).alias("redundant"))


def most_connected(degrees: DataFrame, k: int = 8) -> DataFrame:
    total = F.col("n_in") + F.col("n_out")
    ranked = top_per_group(degrees.where((F.col("kind") != "boundary") & (total > 0)), ["repo"], [total.desc(), F.col("id")], k)
    return ranked.select("repo", "id", "n_in", "n_out", "rank")


def resolve_refs(asks: DataFrame, nodes: DataFrame) -> DataFrame:
    """What people mean by a name: an id, else a name, else name.namespace,
    else a part of a name; one answer or a count of how many.

    ``asks``: repo, ask_id, ref. The first three tiers are equi-joins against
    counted names. Only references that none of them answers are compared with
    names as substrings: both sides are cut into three-letter pieces, the
    reference is joined on the piece that the fewest names have, and the hit is
    checked in full.
    """
    asks = asks.withColumn("ref", F.trim("ref"))
    low = F.lower("ref")
    named = nodes.select("repo", "id", F.lower("name").alias("lname"), F.lower("namespace").alias("lns"))
    exact = _exact_hits(asks, named)
    rest = asks.where("ref <> ''").join(by_shuffle(exact), ["repo", "ask_id"], "left_anti").select("repo", low.alias("needle")).distinct()
    partial = _containing(rest, named.select("repo", "id", "lname"))
    out = asks.withColumn("needle", low).join(by_shuffle(exact), ["repo", "ask_id"], "left").join(
        by_shuffle(partial.select("repo", "needle", F.struct("n", "lo").alias("loose"))), ["repo", "needle"], "left")
    n, lo = F.coalesce("hit.n", "loose.n"), F.coalesce("hit.lo", "loose.lo")
    return out.select("repo", "ask_id", "ref", F.coalesce(n, F.lit(0)).cast("int").alias("n_matches"), F.when(n == 1, lo).alias("node_id"))


def _tiers(named: DataFrame) -> DataFrame:
    """(repo, tier, form, id): how components are named exactly."""
    by_id = named.select("repo", F.lit(0).alias("tier"), F.col("id").alias("form"), "id")
    by_name = named.select("repo", F.lit(1).alias("tier"), F.col("lname").alias("form"), "id")
    by_full = named.where(~F.contains("lname", F.lit("."))).select("repo", F.lit(2).alias("tier"), F.concat_ws(".", "lname", "lns").alias("form"), "id")
    return by_id.unionByName(by_name).unionByName(by_full)


def _exact_hits(asks: DataFrame, named: DataFrame) -> DataFrame:
    """(repo, ask_id, hit): count, least id, tier and form of the first tier that answers a reference."""
    forms = _tiers(named).groupBy("repo", "tier", "form").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    low = F.lower("ref")
    probes = asks.where("ref <> ''").select("repo", "ask_id", F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), F.col("ref").alias("form")), F.struct(F.lit(1).alias("tier"), low.alias("form")),
        F.struct(F.lit(2).alias("tier"), low.alias("form")))).alias("p")).select("repo", "ask_id", "p.*")
    return probes.join(by_shuffle(forms), ["repo", "tier", "form"]).groupBy("repo", "ask_id").agg(
        F.min_by(F.struct("n", "lo", "tier", "form"), "tier").alias("hit"))


def ref_candidates(asks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, tier, form, node_id): the components that an ambiguous reference
    may mean. Listed once per form, however many ask for it; tier 3 holds
    names that contain the form."""
    asks = asks.withColumn("ref", F.trim("ref"))
    named = nodes.select("repo", "id", F.lower("name").alias("lname"), F.lower("namespace").alias("lns"))
    exact = durable(_exact_hits(asks, named), "exact")
    forms = exact.where("hit.n > 1").select("repo", "hit.tier", "hit.form").distinct()
    listed = _tiers(named).join(by_shuffle(forms), ["repo", "tier", "form"], "left_semi").select("repo", "tier", "form", F.col("id").alias("node_id"))
    rest = asks.where("ref <> ''").join(by_shuffle(exact), ["repo", "ask_id"], "left_anti").select("repo", F.lower("ref").alias("needle")).distinct()
    hits = _containing_names(rest, named.select("repo", "id", "lname"))
    loose = durable(hits.join(by_shuffle(named.select("repo", "lname", "id")), ["repo", "lname"]), "loose")
    many = loose.groupBy("repo", "needle").agg(F.count("*").alias("n")).where("n > 1")
    return listed.unionByName(loose.join(by_shuffle(many.select("repo", "needle")), ["repo", "needle"], "left_semi").select(
        "repo", F.lit(3).alias("tier"), F.col("needle").alias("form"), F.col("id").alias("node_id")))


def _pieces(c: Column) -> Column:
    size = 3
    return F.array_distinct(F.when(
        F.length(c) >= size,
        F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))
        .otherwise(F.array().cast("array<string>")))


def _containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, needle, n, lo): names that contain a needle."""
    spread = names.groupBy("repo", "lname").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    return _containing_names(needles, names).join(by_shuffle(spread), ["repo", "lname"]).groupBy("repo", "needle").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"))


def _containing_names(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, needle, lname): distinct names that contain a needle."""
    spread = names.select("repo", "lname").distinct()
    pieces = spread.select("repo", "lname", F.explode(_pieces(F.col("lname"))).alias("piece"))
    sizes = pieces.groupBy("repo", "piece").agg(F.count("*").alias("size"))
    long_ = needles.where(F.length("needle") >= 3)
    rarest = (long_.select("repo", "needle", F.explode(_pieces(F.col("needle"))).alias("piece"))
              .join(by_shuffle(sizes), ["repo", "piece"], "left").groupBy("repo", "needle")
              .agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "piece")).alias("r"))
              .where("r.size > 0").select("repo", "needle", F.col("r.piece").alias("piece")))
    hits = rarest.join(by_shuffle(pieces), ["repo", "piece"]).where(F.contains("lname", F.col("needle"))).select("repo", "needle", "lname")
    # one or two letters: every distinct run of that length is its own key
    short = needles.where(F.length("needle") < 3)
    runs = spread.select("repo", "lname", F.explode(F.array_distinct(F.flatten(F.array(*[F.transform(
        F.sequence(F.lit(1), F.length("lname")), lambda i, s=s: F.substring(F.col("lname"), i, F.lit(s))) for s in (1, 2)])))).alias("needle"))
    hits = hits.unionByName(short.join(by_shuffle(runs), ["repo", "needle"]).select("repo", "needle", "lname"))
    return hits.distinct()


def describe_nodes(nodes: DataFrame, edges: DataFrame, diags: DataFrame) -> DataFrame:
    """Degrees, strongest edge each way, diagnostics of its file, and why a
    component stands alone."""
    rel = relationships(edges)
    strongest = lambda peer: F.min(F.struct((-F.col("conf_pct")).alias("neg"), peer, "kind", "protocol", "id"))
    best_out = rel.groupBy("repo", F.col("src").alias("nid")).agg(strongest("dst").alias("b")).select(
        "repo", F.col("nid"), F.col("b.id").alias("best_out"))
    best_in = rel.groupBy("repo", F.col("dst").alias("nid")).agg(strongest("src").alias("b")).select(
        "repo", F.col("nid"), F.col("b.id").alias("best_in"))
    n_diag = diags.groupBy("repo", "path").agg(F.count_distinct("line", "code").alias("n_diagnostics"))
    out = (degree(nodes, edges).join(nodes.select("repo", "id", "path"), ["repo", "id"]).withColumnRenamed("id", "nid")
           .join(best_out, ["repo", "nid"], "left").join(best_in, ["repo", "nid"], "left").join(n_diag, ["repo", "path"], "left"))
    n = F.coalesce("n_diagnostics", F.lit(0))
    return out.select("repo", F.col("nid").alias("id"), "n_in", "n_out", "best_out", "best_in", n.alias("n_diagnostics"),
                      F.when(F.col("n_in") + F.col("n_out") > 0, F.lit("")).when(F.col("kind") == "boundary", F.lit("grouping"))
                      .when(n > 0, F.lit("unread")).otherwise("isolated").alias("why_isolated"))


def overview(nodes: DataFrame, edges: DataFrame, diags: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per repo."""
    stats = graph_stats(nodes, edges, labels).select("repo", "components", "connected", "clusters")
    rel = relationships(edges).groupBy("repo").agg(F.count("*").alias("relationships"))
    gaps = diags.where("severity <> 'info'").groupBy("repo").agg(F.count("*").alias("gaps"))
    files = nodes.groupBy("repo").agg(F.count_distinct("path").alias("n_files"))
    top = degree(nodes, edges).where("kind <> 'boundary'").groupBy("repo").agg(
        F.min(F.struct((-(F.col("n_in") + F.col("n_out"))).alias("neg"), "id")).alias("t")).select("repo", F.col("t.id").alias("top_node"))
    out = stats
    for part in (rel, gaps, files, top):
        out = out.join(part, "repo", "left")
    return out.na.fill(0, ["relationships", "gaps", "n_files"])


def shape_report(nodes: DataFrame, edges: DataFrame, diags: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled sizes per repo, for pinning a repository's shape."""
    stats = graph_stats(nodes, edges, labels).join(redundant_nodes(nodes), "repo")
    sizes = stats.select("repo", F.explode(F.array(*[
        F.struct(F.lit(w).alias("what"), F.col(c).cast("bigint").alias("n")) for w, c in
        (("nodes", "n_nodes"), ("edges", "n_edges"), ("connected", "connected"), ("clusters", "clusters"), ("redundant", "redundant"))
    ])).alias("s")).select("repo", "s.what", "s.n")

    def count(df: DataFrame, what: str, column: str) -> DataFrame:
        return df.groupBy("repo", F.concat(F.lit(what + " "), F.col(column)).alias("what")).agg(F.count("*").alias("n"))

    return (sizes.unionByName(count(nodes, "kind", "kind")).unionByName(count(edges, "relationship", "kind"))
            .unionByName(count(diags, "diagnostic", "code")))


def overview_parts(nodes: DataFrame, edges: DataFrame, diags: DataFrame, labels: DataFrame, files: DataFrame, top: int = 8) -> DataFrame:
    """The parts of an overview, one labelled number per row: (repo, part, value, n).

    Kinds and projects of components, kinds of relationships, severities, the
    most connected components with their degrees, sizes, what kind of picture
    they make, and files scanned and parsed. ``files``: repo, files_scanned, files_parsed.
    """
    def count(df: DataFrame, part: str, column: str) -> DataFrame:
        return df.groupBy("repo", F.lit(part).alias("part"), F.col(column).alias("value")).agg(F.count("*").alias("n"))

    def spread(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).cast("bigint").alias("n")) for c in columns]))
        return df.select("repo", F.lit(part).alias("part"), each.alias("e")).select("repo", "part", "e.*")

    stats = graph_stats(nodes, edges, labels)
    degrees = most_connected(degree(nodes, edges), top)
    parts = [
        count(nodes, "kind", "kind"), count(nodes.where("kind <> 'boundary'"), "project", "project"), count(relationships(edges), "relationship", "kind"),
        count(diags, "severity", "severity"), spread(stats, "size", ["components", "connected", "clusters"]),
        stats.select("repo", F.lit("shape").alias("part"), F.col("shape").alias("value"), F.lit(1).cast("bigint").alias("n")),
        degrees.select("repo", F.lit("most_connected").alias("part"), F.col("id").alias("value"), (F.col("n_in") + F.col("n_out")).cast("bigint").alias("n")),
        spread(files, "files", ["files_scanned", "files_parsed"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every relationship of every component, seen from it: direction, peer, and
    the first piece of evidence with how many there are."""
    first = evidence.groupBy("repo", F.col("edge_id").alias("edge")).agg(
        F.count("*").alias("n_evidence"), F.min(F.struct("rule", "path", "line", "detail", "extractor")).alias("e"))
    rel = relationships(edges).select("repo", F.col("id").alias("edge"), "src", "dst", "kind", "protocol", "conf_pct").join(first, ["repo", "edge"])
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("peer")),
                             F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("peer"))))
    return rel.select("repo", ends.alias("x"), "edge", "kind", "protocol", "conf_pct", "n_evidence", "e.rule", "e.path", "e.line", "e.detail").select(
        "repo", "x.*", "edge", "kind", "protocol", "conf_pct", "n_evidence", "rule", "path", "line", "detail")
