"""One scan from files to a graph: extraction, projects, merging, resolution, corrections.

The steps run in a fixed order, each on whole tables of all repositories. What
the jobs found is written once and read by every later step. Edges stay rows
with one piece of evidence each until the end, so that folding components or
relationships rewrites columns and never gathers evidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions import ids, net
from archgraph.functions.redact import redact_string, redact_value
from archgraph.operators import aliases as al
from archgraph.operators import diagnostics as dg
from archgraph.operators import joins, match, merge, overrides, projects as pj
from archgraph.operators.nodes import identity_forms
from archgraph.session import dealt, durable, together
from archgraph.sources import builtin
from archgraph.sources.files import file_inventory, scan_stats, unsupported_formats
from archgraph.sources.jobs import Jobs

ROW = ["repo", "src", "dst", "kind", "protocol", "conf_pct", "rule", "path", "line", "detail", "extractor"]
DIAGNOSTIC = ["repo", "severity", "code", "path", "line", "message"]
RULES = "repo string, rule_id long, action string, from_ref string, to_ref string, kind string, protocol string, note string"
SAME = "repo string, rule_id long, pos int, ref string"


class Parts(Mapping):
    """Tables by name, each worked out when it is first asked for and kept: who wants edges pays for no diagnostics."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers = {name: cache(make) for name, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def empty(spark: SparkSession, layout: str) -> DataFrame:
    return spark.createDataFrame([], layout)


def _diag(df: DataFrame, severity: Column | str, code: Column | str, path: Column | str, message: Column, line: Column | int = 0) -> DataFrame:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("repo", text(severity).alias("severity"), text(code).alias("code"), text(path).cast("string").alias("path"),
                     text(line).cast("int").alias("line"), message.alias("message"))


# ------------------------------------------------------------------ extraction
def extract(files: DataFrame, resources: DataFrame | None = None, jobs: Jobs | None = None) -> Parts:
    """nodes, edges, hints, aliases and diagnostics of all jobs, each written once, with the job's name as extractor."""
    found = (jobs or builtin.built_in()).run(files)
    parts = {kind: [found[kind]] if kind in found else [] for kind in builtin.LAYOUTS}
    if resources is not None:
        for kind, df in builtin.resource_job(resources).items():
            parts[kind].append(df.withColumn("extractor", F.lit("terraform")))
    by = ", extractor string"

    def written(kind: str) -> DataFrame:
        table = empty(files.sparkSession, builtin.LAYOUTS[kind] + by)
        for df in parts[kind]:
            table = table.unionByName(builtin.shaped(df, kind, by))
        # each job fills files of its own; read together, one task would get most rows
        return durable(dealt(table) if kind in ("nodes", "hints") else table, kind)

    return Parts(**{kind: (lambda kind=kind: written(kind)) for kind in builtin.LAYOUTS})


# -------------------------------------------------------------------- projects
def qualify(tables: Mapping[str, DataFrame], projects: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables with every id qualified by the project of its file, and one diagnostic per repository whose labels still collide.

    Nodes, edges, hints (with the config map they use or are) and aliases move
    together: what one file says stays consistent. Without declared projects
    only the column ``project`` is added.
    """
    if projects is None:
        alone = {k: tables[k].withColumn("project", F.lit(pj.ROOT)) for k in tables if k != "diagnostics"}
        return alone, empty(alone["nodes"].sparkSession, "repo string, severity string, code string, path string, line int, message string")
    placed = {k: pj.project_of(tables[k], projects) for k in tables if k != "diagnostics"}
    scopes = placed["nodes"].select("repo", F.col("project").alias("root"), ids.parse_node_id(F.col("id"))["scope"].alias("scope")).where(
        "scope IS NOT NULL")
    labels = durable(pj.project_labels(projects, scopes), "labels")
    columns = {"nodes": ["id"], "edges": ["src", "dst"], "hints": ["from_node", "ref"], "aliases": []}
    out = {}
    for kind, names in columns.items():
        df = placed[kind].join(labels.select("repo", F.col("root").alias("project"), "label"), ["repo", "project"], "left")
        for c in names:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), ids.qualify_project(F.col(c), F.coalesce("label", F.lit("")))))
        out[kind] = durable(df.drop("label"), kind)
    clash = labels.where("collides").select("repo").distinct()
    return out, _diag(clash, "warn", "project_namespace_collision", "", F.lit(
        "two projects have the same qualified namespace even after disambiguation; their components may appear merged"))


# --------------------------------------------------------------------- merging
_FIELDS = ["language", "runtime", "framework", "images", "ports", "labels", "directory", "build_context", "name_from"]


def merged_nodes(readings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, sources, diagnostics) of all readings, in the order of path, job and emission."""
    some = lambda c, t: F.when(F.size(c) > 0, F.col(c)) if t else F.when(F.col(c) != "", F.col(c))
    r = readings.withColumns({c: some(c, c in ("images", "ports", "labels")) for c in _FIELDS})
    r = durable(r.withColumns({"seq": F.struct("path", "extractor", "pos", "line", "name"),
                               "image": F.array_join(F.coalesce("images", F.array().cast("array<string>")), " ")}), "readings")
    key = ["repo", "id"]
    out = merge.merge_nodes(r, _FIELDS).join(merge.merge_place(r), key).join(merge.merge_attributes(r), key, "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    nodes = out.select(
        *key, "kind", ids.layer_of(F.col("kind")).alias("layer"), "name", blank("namespace"), "project",
        F.struct(blank("language"), blank("framework"), blank("runtime")).alias("tech"),
        F.coalesce("images", F.array().cast("array<string>")).alias("images"), F.coalesce("ports", F.array().cast("array<int>")).alias("ports"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), "directory", "build_context", "name_from",
        F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), "path", "line", "conf_pct")
    conflicts = merge.kind_conflicts(r)
    message = F.concat(F.col("id"), F.lit(" was read as "), "was", F.lit(" and as "), "also", F.lit("; kept "), "kept")
    return (durable(nodes, "merged"), r.select(*key, "path", "line", "extractor").distinct(),
            _diag(conflicts, "info", "kind_conflict", F.col("path"), message))


# ------------------------------------------------------------------ resolution
def _external(rows: DataFrame, host: str) -> DataFrame:
    """Component rows for hosts (repo, host, path, line) outside; one per host, from its first mention."""
    name = F.lower(F.regexp_replace(F.col(host), r"\.$", ""))
    first = rows.select("repo", name.alias("name"), "path", "line").groupBy("repo", "name").agg(F.min(F.struct("path", "line")).alias("f"))
    return first.select("repo", ids.node_id(F.lit("external"), F.lit(""), F.col("name")).alias("id"), "name", F.lit("net").alias("namespace"),
                        "f.path", "f.line", F.create_map(F.lit("hostname"), F.col("name")).alias("attrs"), F.lit(80).alias("conf_pct"))


def _as_nodes(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Outside components with all columns of the node table."""
    defaults = {"kind": F.lit("external"), "layer": F.lit("context"), "project": F.lit(pj.ROOT),
                "tech": F.struct(*[F.lit("").alias(f) for f in ("language", "framework", "runtime")])}
    out = []
    for f in like.schema.fields:
        column = F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))
        if f.name in ("images", "ports"):
            column = F.array()
        if f.name == "labels":
            column = F.create_map()
        out.append(column.cast(f.dataType).alias(f.name))
    return rows.select(out)


def _added(nodes: DataFrame, more: DataFrame) -> DataFrame:
    new = more.join(nodes.select("repo", "id"), ["repo", "id"], "left_anti")
    return nodes.unionByName(_as_nodes(new, nodes))


def attach_aliases(aliases: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, lent names, lent ports, sources, diagnostics): what aliases lend to components; ExternalName targets become components."""
    key = F.sha2(F.to_json(F.struct("path", "name", "namespace", "project", "selector", "target_name", "external", "dns", "ports")), 256)
    # the job that read a file does not tell names apart
    known = aliases.drop("extractor").withColumns({"selector": F.coalesce("selector", F.create_map().cast("map<string,string>")),
                                "target_name": F.coalesce("target_name", F.lit("")), "external": F.coalesce("external", F.lit("")),
                                "namespace": F.coalesce("namespace", F.lit("")), "ports": F.coalesce("ports", F.array().cast("array<int>"))})
    known = durable(known.withColumn("alias_key", key).dropDuplicates(["repo", "alias_key"]).withColumn("port", F.lit(None).cast("int")), "aliases")
    out = known.where("external <> ''")
    outside = _external(out, "external")
    nodes = durable(_added(nodes, outside), "aliased")
    # selections are read twice: as routes, and for what is said of them
    selected, named = together(nodes.sparkSession, lambda: durable(al.selector_alias_join(known, nodes), "selected"),
                               lambda: al.named_alias_join(known, nodes))
    solved = selected.select("repo", "alias_key", "node_id").unionByName(named.select("repo", "alias_key", "node_id")).where("node_id IS NOT NULL")
    host = F.lower(F.regexp_replace("external", r"\.$", ""))
    solved = solved.unionByName(out.select("repo", "alias_key", ids.node_id(F.lit("external"), F.lit(""), host).alias("node_id")))
    routes = durable(solved.join(known.select("repo", "alias_key", "dns", "ports"), ["repo", "alias_key"]), "routes")
    dns = routes.select("repo", "node_id", F.explode("dns").alias("dns")).distinct()
    # ports of names that lead outside say nothing about the host
    ports = routes.join(known.where("external = ''").select("repo", "alias_key"), ["repo", "alias_key"]).select(
        "repo", "node_id", F.explode("ports").alias("port"))
    said = selected.where("code IS NOT NULL")
    message = F.concat(F.lit('Service "'), "name", F.lit('" selects '), F.when(
        F.col("n_selected") == 0, F.concat("selector", F.lit(", which matches no workload"))).otherwise(F.concat(
            F.col("n_selected").cast("string"), F.lit(" workloads; references to it were left unresolved"))))
    sources = out.select("repo", ids.node_id(F.lit("external"), F.lit(""), host).alias("id"), "path", "line", F.lit("k8s").alias("extractor"))
    return nodes, dns, ports, sources, _diag(said, "info", F.col("code"), F.col("path"), message, F.col("line"))


def _hint_ids(hints: DataFrame) -> DataFrame:
    """Equal hints are one; its id names it within its repository."""
    columns = ["role", "from_node", "owner_dir", "ref", "kind", "raw", "tokens", "port", "protocol", "suggested_edge", "detail", "path", "line",
               "tech", "dependency"]
    return hints.withColumn("hint_id", F.sha2(F.to_json(F.struct(*columns)), 256)).dropDuplicates(["repo", "hint_id"])


def corroborate(hints: DataFrame, nodes: DataFrame, forms: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """What dependencies add: evidence for edges that are there, companies nobody else names, and technologies used.

    nodes: companies to be added; rows: their edges, and evidence rows for edges
    that lead to the only holder of the technology or to a target named after
    the company; uses: (repo, id, technologies). Evidence raises no confidence.
    """
    lib = hints.select("repo", "from_node", F.col("tech"), "dependency", "path", "line", "detail", "suggested_edge", "extractor", "vendor")
    targets = durable(joins.library_corroboration(lib, nodes, forms, rows), "targets")
    names = nodes.select("repo", F.col("id").alias("target"), F.lower("name").alias("lname"))
    drawn = rows.groupBy("repo", F.col("src").alias("from_node"), F.col("dst").alias("target")).agg(
        F.min(F.struct("kind", F.coalesce("protocol", F.lit("")).alias("protocol"))).alias("edge"))
    companies = lib.where("vendor").select("repo", "from_node", "tech").distinct().join(targets, ["repo", "from_node", "tech"], "left_anti")
    reached = (companies.join(drawn.select("repo", "from_node", "target"), ["repo", "from_node"]).join(names, ["repo", "target"])
               .where(F.contains("lname", F.col("tech"))).groupBy("repo", "from_node", "tech").agg(F.min("target").alias("target")))
    spoken = targets.select("repo", "from_node", "tech", "target").unionByName(reached.select("repo", "from_node", "tech", "target"))
    spoken = durable(spoken, "spoken")
    evidence = lib.join(spoken, ["repo", "from_node", "tech"]).join(drawn, ["repo", "from_node", "target"]).select(
        "repo", F.col("from_node").alias("src"), F.col("target").alias("dst"), "edge.kind", "edge.protocol", F.lit(0).alias("conf_pct"),
        F.lit("library_corroborates").alias("rule"), "path", "line", "detail", "extractor")
    alone = durable(lib.where("vendor").join(spoken, ["repo", "from_node", "tech"], "left_anti"), "alone")
    id_ = ids.node_id(F.lit("external"), F.lit(""), F.col("tech"))
    edges = alone.select(
        "repo", F.col("from_node").alias("src"), id_.alias("dst"), ids.edge_kind_for(F.col("suggested_edge"), F.lit("external")).alias("kind"),
        F.lit("https").alias("protocol"), F.lit(40).alias("conf_pct"), F.lit("dependency_names_vendor").alias("rule"), "path", "line",
        F.concat("detail", F.lit(" (resolves to "), "tech", F.lit(")")).alias("detail"), "extractor")
    first = alone.groupBy("repo", "tech").agg(F.min(F.struct("path", "line", "extractor")).alias("f"))
    made = first.select("repo", id_.alias("id"), F.col("tech").alias("name"), F.lit("vendor").alias("namespace"), "f.path", "f.line", "f.extractor",
                        F.create_map(F.lit("vendor"), F.col("tech")).alias("attrs"), F.lit(40).alias("conf_pct"))
    uses = lib.groupBy("repo", F.col("from_node").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tech")), ",").alias("technologies"))
    return {"nodes": made, "rows": edges.unionByName(evidence), "uses": uses}


def resolve(nodes: DataFrame, sources: DataFrame, edges: DataFrame, hints: DataFrame, aliases: DataFrame) -> Parts:
    """References become edges: nodes, rows (edges with evidence), sources, diagnostics.

    Codebases that share a directory fold first; aliases lend names; code joins
    the deployment that runs it and hands over what it knows; hints that only
    know their directory find their owner; config maps pass their values on;
    the ladder decides; hosts outside become components; dependencies
    corroborate; last, everything absorbed is rewritten to what survives and
    generic dependencies move to specific ones.
    """
    folds, refused = merge.fold_directory_duplicates(nodes)
    folds = durable(folds, "folds")
    said = [_diag(refused, "info", "directory_declares_several_components", F.col("directory"), F.concat(
        "directory", F.lit(" holds "), F.col("n_declared").cast("string"), F.lit(" components with names of their own and "),
        F.col("n_derived").cast("string"), F.lit(" named after it; they are drawn separately")))]
    kept = merge.surviving_nodes(merge.contribute_all(nodes, folds), folds)
    sources = durable(merge.rekeyed(sources, folds).distinct(), "sources")
    (known, dns, ports, outside, told), moved = together(
        nodes.sparkSession, lambda: attach_aliases(aliases, kept), lambda: durable(_hint_ids(merge.rekeyed(hints, folds, "from_node")), "moved", by="role"))
    said.append(told)
    # lent ports help to decide, but are no facts about the component
    indexed = durable(al.attach_ports(known, ports), "indexed")
    forms = durable(identity_forms(indexed, dns), "forms")

    code = durable(joins.code_merges(indexed, forms, sources), "code_merges")
    label = indexed.select("repo", "id", ids.display_name(F.col("name"), F.col("namespace")).alias("label"))
    one, two = label.select("repo", F.col("id").alias("absorbed"), F.col("label").alias("a")), label.select("repo", F.col("id").alias("survivor"), F.col("label").alias("b"))
    said.append(_diag(code.where("how = 'basename'").join(one, ["repo", "absorbed"]).join(two, ["repo", "survivor"]), "info", "code_joined_to_deployment", "",
                      F.concat("a", F.lit(" and "), "b", F.lit(" were treated as one component: the workload is named after its code's directory"))))

    def crossed() -> DataFrame:
        crossing = joins.cross_project_report(indexed, forms, code).groupBy("repo", "code").agg(F.max("n_refused").alias("n"))
        return _diag(crossing.join(label, (crossing.repo == label.repo) & (crossing.code == label.id)).select(crossing.repo, "label", "n"), "info",
                     "code_join_crosses_projects", "", F.concat("label", F.lit(" shares a name with "), F.col("n").cast("string"), F.lit(
                         " deployments in other project trees; they were left apart")))

    bound = joins.directory_owner_join(moved.where("from_node IS NULL AND owner_dir IS NOT NULL"), indexed, code)
    bound = durable(bound, "bound")
    lost = joins.owner_diagnostics(bound)
    said.append(_diag(lost, F.col("severity"), F.col("code"), F.col("path"), F.when(
        F.col("n_owners") == 0, F.lit("no component is declared in the directory of this file, so its references were not attached"))
        .otherwise(F.concat(F.col("n_owners").cast("string"), F.lit(" components are declared in the directory of this file, so its references were not attached")))))
    columns = [c for c in moved.columns if c != "hint_id"]
    direct = moved.where("from_node IS NOT NULL AND role = 'reference'").select(columns).unionByName(
        bound.where("from_node IS NOT NULL AND role = 'reference'").select(columns))
    through = joins.configmap_join(moved.where("role = 'use'").select("repo", "ref", "from_node", "path", "line", "detail", "extractor", "project"),
                                   moved.where("role = 'value'").drop("extractor", "project", "hint_id"))
    direct = direct.unionByName(through.withColumn("role", F.lit("reference")).select(columns))
    wanted = durable(_hint_ids(direct), "hints")
    decided = match.match_ladder(wanted, indexed, forms).join(wanted.select("repo", "hint_id", "extractor"), ["repo", "hint_id"])
    decided = durable(decided, "decisions")
    said.append(match.refusal_diagnostics(decided, indexed, forms).select(*DIAGNOSTIC))
    made, drawn = match.external_synthesis(decided)
    rows = edges.select(*ROW).unionByName(match.resolved_edges(decided, indexed).select(*ROW)).unionByName(drawn.select(*ROW))
    rows = durable(rows, "rows")
    hosts = made.drop("kind", "layer").withColumn("attrs", F.create_map(F.lit("hostname"), F.col("name")))
    full = durable(_added(known, hosts), "hosts")
    libs = corroborate(moved.where("role = 'library'"), full, forms, rows)
    full = _added(full, libs["nodes"])
    uses = full.join(libs["uses"], ["repo", "id"], "left").withColumn("attrs", F.when(
        F.col("technologies").isNull(), F.col("attrs")).otherwise(F.map_concat("attrs", F.create_map(F.lit("usesTechnology"), F.col("technologies")))))
    full = merge.contribute_all(uses.drop("technologies"), code)
    merges = folds.select("repo", "absorbed", "survivor").unionByName(code.select("repo", "absorbed", "survivor"))
    everything = rows.unionByName(libs["rows"].select(*ROW))
    sources = merge.rekeyed(sources, code).unionByName(outside).unionByName(
        hosts.select("repo", "id", "path", "line", F.lit("resolver").alias("extractor"))).unionByName(
        libs["nodes"].select("repo", "id", "path", "line", "extractor"))

    def diagnostics() -> DataFrame:
        out = crossed()
        for d in said:
            out = out.unionByName(d.select(*DIAGNOSTIC))
        return out

    return Parts(nodes=lambda: durable(merge.surviving_nodes(full, code), "resolved"),
                 rows=lambda: durable(merge.fold_generic_rows(durable(merge.apply_merges(everything, merges), "moved")), "resolved"),
                 sources=lambda: sources.distinct(), diagnostics=diagnostics)


# ------------------------------------------------------------------------ scan
_RULE_MESSAGES = {
    "override_unresolved": "a component it names is not in the graph", "override_ambiguous": "a name it uses fits several components",
    "override_incomplete": "it lists a single component", "override_no_effect": "it changes nothing", "override_unknown_kind": "its kind is no relationship kind"}


def scan(files: DataFrame, resources: DataFrame | None = None, projects: DataFrame | None = None, rules: DataFrame | None = None,
         same: DataFrame | None = None, jobs: Jobs | None = None, formatters: dict[str, dg.Formatter] | None = None) -> Parts:
    """The graph of every repository in ``files`` (repo, path, size, mtime, content): the six tables of a snapshot.

    ``resources`` are declared resources as rows, ``projects`` (repo, root) the
    declared projects, ``rules`` and ``same`` the corrections people wrote down
    (layouts RULES and SAME). Everything stored is masked. The files are read at
    once; a later step runs when a table that needs it is asked for, and once.
    """
    spark = files.sparkSession
    found = extract(files, resources, jobs)

    def extracted(*kinds: str) -> list[DataFrame]:
        return together(spark, *[partial(found.__getitem__, kind) for kind in kinds])

    @cache
    def graph() -> tuple[Mapping[str, DataFrame], Parts, DataFrame, DataFrame]:
        extracted("nodes", "edges", "hints", "aliases")
        tables, clashes = qualify(found, projects)
        nodes, sources, conflicts = merged_nodes(tables["nodes"])
        out = resolve(nodes, sources, tables["edges"], tables["hints"], tables["aliases"])
        if rules is None and same is None:
            return out, out, clashes, conflicts
        fixed = overrides.correct(out["nodes"], out["rows"], out["sources"], rules if rules is not None else empty(spark, RULES),
                                  same if same is not None else empty(spark, SAME))
        return fixed, out, clashes, conflicts

    def diagnostics() -> DataFrame:
        done, resolved, clashes, conflicts = graph()
        parts = [found["diagnostics"], clashes, conflicts, resolved["diagnostics"]]
        unread = unsupported_formats(file_inventory(files))
        parts.append(_diag(unread, "info", "unsupported_format", "", F.concat("format", F.lit(" not read: "), "paths")))
        if done is not resolved:
            message = F.concat(F.lit("rule "), F.col("rule_id").cast("string"), F.lit(": "), F.try_element_at(
                F.create_map(*[F.lit(x) for kv in _RULE_MESSAGES.items() for x in kv]), F.col("code")))
            parts.append(_diag(done["diagnostics"], F.when(F.col("code") == "override_no_effect", "info").otherwise("warn"), F.col("code"), "", message))
        every = parts[0].select(*DIAGNOSTIC)
        for d in parts[1:]:
            every = every.unionByName(d.select(*DIAGNOSTIC))
        folded = dg.aggregate_diagnostics(every.withColumn("path", F.coalesce("path", F.lit(""))), formatters=formatters or dg.FORMATTERS)
        return folded.select(*DIAGNOSTIC).withColumn("message", redact_string(F.col("message")))

    def rows() -> DataFrame:
        return graph()[0]["rows"].withColumn("detail", redact_string(F.col("detail")))

    def nodes() -> DataFrame:
        masked = F.map_from_entries(F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"], redact_value(e["key"], e["value"]).alias("value"))))
        return graph()[0]["nodes"].withColumn("attrs", masked)

    return Parts(nodes=nodes, edges=lambda: merge.merge_edges(rows()), evidence=lambda: merge.edge_evidence(rows()),
                 sources=lambda: graph()[0]["sources"], diagnostics=diagnostics, stats=lambda: scan_stats(files, extracted(*found)))
