"""The built-in extraction jobs, each over the routed files of a scan.

Every job gives any of five tables in one common layout, so that what several
jobs say of one repository can be united. What a job parses is written once. YAML and TOML files hold JSON text;
declared resources come as rows (``resource_job``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import deps, ids, paths
from archgraph.session import dealt, durable
from archgraph.sources import charts, compose, dockerfile, dotenv, k8s, manifests, resources
from archgraph.sources.files import route_conditions
from archgraph.sources.jobs import Jobs

LAYOUTS = {
    "nodes": ("repo string, path string, line int, pos int, id string, kind string, name string, name_from string, namespace string, "
              "language string, runtime string, framework string, images array<string>, ports array<int>, labels map<string,string>, "
              "directory string, build_context string, attrs map<string,string>, conf_pct int"),
    "edges": ("repo string, path string, line int, src string, dst string, kind string, protocol string, conf_pct int, rule string, detail string"),
    "hints": ("repo string, path string, line int, role string, from_node string, owner_dir string, ref string, kind string, raw string, "
              "tokens array<string>, port int, protocol string, suggested_edge string, detail string, tech string, dependency string, vendor boolean"),
    "aliases": ("repo string, path string, line int, name string, namespace string, dns array<string>, ports array<int>, "
                "selector map<string,string>, target_name string, external string"),
    "diagnostics": "repo string, severity string, code string, path string, line int, message string",
}
#: Role of a hint: a reference, a use of a config map, a value of one, or a dependency that implies a technology.
ROLES = ("reference", "use", "value", "library")


def shaped(df: DataFrame, kind: str, more: str = "", /, **given: Column | str | int | bool) -> DataFrame:
    """``df`` in the common layout of ``kind`` (and ``more`` columns): columns by name, those of ``given`` as said, the rest NULL."""
    out = []
    for field in (LAYOUTS[kind] + more).split(", "):
        name, type_ = field.split(" ", 1)
        if name in given:
            value = given[name]
            column = value if isinstance(value, Column) else F.lit(value)
        elif name in df.columns:
            column = F.col(name)
        else:
            column = F.lit(0) if name in ("line", "pos") else F.lit(None)
        out.append(column.cast(type_).alias(name))
    return df.select(out)


def attributes(**values: Column) -> Column:
    """Map of what is known, as text."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def json_docs(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.col("content").alias("doc"))


def unreadable(files: DataFrame, code: str) -> DataFrame:
    docs = json_docs(files).withColumn("format", F.lit(code))
    return shaped(manifests.unreadable(docs, {code: code}), "diagnostics")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _dir(path: Column) -> Column:
    return F.when(paths.dir_of(path) == "", F.lit(".")).otherwise(paths.dir_of(path))


# -------------------------------------------------------------- cluster objects
def k8s_job(files: DataFrame) -> dict[str, DataFrame]:
    objs = k8s.objects(json_docs(files))
    work, ing, aliases = k8s.workloads(objs), k8s.ingresses(objs), k8s.service_aliases(objs)
    boundaries, contains = k8s.namespace_members(
        work.select("repo", "path", "namespace", "id").unionByName(ing.select("repo", "path", "namespace", "id")))
    # a boundary is read once from every file that has a member
    placed = contains.select("repo", F.col("src").alias("id"), "path").distinct().join(boundaries, ["repo", "id"])
    nodes = _union(
        shaped(work, "nodes", runtime="kubernetes", attrs=attributes(
            workload=F.col("workload"), replicas=F.col("replicas"), schedule=F.col("schedule"), serviceAccount=F.col("service_account"))),
        shaped(ing, "nodes", kind="cloud_resource", runtime="kubernetes", framework="ingress", conf_pct=100, attrs=attributes(
            workload=F.lit("Ingress"), ingressClass=F.col("ingress_class"), hosts=F.array_join("hosts", ","),
            tls=F.when(F.col("tls"), F.lit("true")))),
        shaped(placed, "nodes", pos=1, runtime="kubernetes", conf_pct=100))
    routed = k8s.ingress_routes(objs)
    hints = _union(
        shaped(k8s.container_env(objs), "hints", role="reference"),
        shaped(routed, "hints", role="reference", detail=F.concat(
            F.lit('Ingress "'), F.element_at(F.split("from_node", "/"), -1), F.lit('" routes '), "route", F.lit(' to Service "'), "raw", F.lit('"'))),
        shaped(k8s.configmap_uses(objs), "hints", role="use", kind="config_value"),
        shaped(k8s.configmap_values(objs), "hints", role="value", kind="config_value"))
    patches, bare = k8s.patch_fragments(objs), k8s.services_without_selector(aliases)
    diagnostics = _union(
        shaped(patches, "diagnostics", message=F.concat("subject", F.lit(
            " declares no pod template, so it was read as a patch rather than a component; its overrides are not reflected in the graph"))),
        shaped(bare, "diagnostics", severity="info", message=F.concat(F.lit('Service "'), "name", F.lit('" selects nothing; what it routes to is not known'))),
        unreadable(files, "k8s_parse_failed"))
    return {"nodes": nodes, "edges": shaped(contains, "edges", detail="namespace"), "hints": hints,
            "aliases": shaped(aliases, "aliases"), "diagnostics": diagnostics}


def compose_job(files: DataFrame) -> dict[str, DataFrame]:
    docs = json_docs(files)
    comps = durable(compose.compose_services(docs), "services")
    stacks, contains = compose.stack_members(comps)
    placed = contains.select("repo", F.col("src").alias("id"), "path").distinct().join(stacks, ["repo", "id"])
    nodes = _union(
        shaped(comps, "nodes", runtime="container", conf_pct=100, images=F.array_compact(F.array("image")), attrs=attributes(
            composeProject=F.col("stack"), replicas=F.col("replicas"), profiles=F.array_join("profiles", ","),
            volumes=F.array_join("volumes", ","), restart=F.col("restart"))),
        shaped(placed, "nodes", pos=1, conf_pct=100))
    needs = compose.compose_depends_on(docs)
    edges = _union(
        shaped(contains, "edges", conf_pct=100, detail="stack"),
        shaped(needs.where("dst IS NOT NULL"), "edges", detail="depends_on"))
    hints = _union(
        shaped(compose.compose_env(docs), "hints", role="reference"),
        shaped(needs.where("dst IS NULL"), "hints", role="reference", from_node=F.col("src"), kind="depends_on", raw=F.col("token"),
               tokens=F.array("token"), port=0, protocol="", suggested_edge="depends_on", detail=F.concat(F.lit("depends_on "), "token")))
    return {"nodes": nodes, "edges": edges, "hints": hints, "diagnostics": unreadable(files, "compose_parse_failed")}


# ---------------------------------------------------------------------- charts
def helm_job(files: DataFrame) -> dict[str, DataFrame]:
    chart_files, value_files = files.where(paths.is_chart_file(F.col("name"))), files.where(paths.is_values_file(F.col("name")))
    subcharts = charts.chart_dependencies(json_docs(chart_files))
    chart = subcharts.select("repo", "path", F.col("boundary").alias("id"), F.regexp_replace("boundary", "^context:", "").alias("name")).distinct()
    values = durable(charts.chart_values_components(json_docs(value_files)), "values")
    nodes = _union(
        shaped(subcharts, "nodes", runtime="kubernetes", attrs=attributes(
            packaging=F.lit("helm"), chart=F.col("chart"), chartVersion=F.col("chart_version"))),
        shaped(chart, "nodes", pos=1, kind="boundary", conf_pct=100),
        shaped(values, "nodes", runtime="kubernetes", images=F.filter(F.array("image"), lambda i: i != ""), ports=F.array_compact(F.array("port")),
               attrs=attributes(packaging=F.lit("helm"), valuesKey=F.col("values_key"), replicas=F.col("replicas"),
                                enabled=F.when(~F.col("enabled"), F.lit("false")))))
    edges = shaped(subcharts, "edges", src=F.col("boundary"), dst=F.col("id"), kind="contains", rule="helm_subchart", detail="subchart")
    aliases = shaped(subcharts, "aliases", target_name=F.col("name"), name=F.col("release_name"), dns=F.array("release_name", "name"))
    # what a block says belongs to its component; outside every block there is nothing to attach to
    refs = charts.values_references(json_docs(value_files)).withColumn("block", F.substring_index("trail", ".", 1))
    owners = values.select("repo", "path", F.col("id").alias("from_node"), "values_key")
    owned = refs.join(owners, (refs.repo == owners.repo) & (refs.path == owners.path) & (
        (owners.values_key == "") | (owners.values_key == refs.block))).select(refs["*"], "from_node")
    hints = shaped(owned, "hints", role="reference", detail=F.concat(F.lit("values "), "trail", F.lit("="), "raw"))
    inferred = charts.values_inferred(values)
    message = F.when(F.col("n_components") == 1, F.lit("a component was inferred from chart default values")).otherwise(
        F.concat(F.col("n_components").cast("string"), F.lit(" components were inferred from chart default values")))
    diagnostics = _union(
        shaped(inferred, "diagnostics", severity="info", message=F.concat(
            message, F.lit(" rather than rendered templates; names and settings may differ at install time"))),
        unreadable(chart_files, "helm_chart_parse_failed"))
    return {"nodes": nodes, "edges": edges, "hints": hints, "aliases": aliases, "diagnostics": diagnostics}


# ------------------------------------------------------------------ codebases
def dependency_lists(files: DataFrame) -> DataFrame:
    """(repo, path, name, version, runtime_version, language, dependencies, declared_as) of every dependency list."""
    named = lambda *n: files.where(F.lower("name").isin(*n))
    columns = ["repo", "path", "name", "version", "runtime_version", "language", "dependencies", "declared_as"]
    package = manifests.package_json(json_docs(named("package.json"))).withColumn("declared_as", F.lit("package"))
    project = manifests.pyproject(json_docs(named("pyproject.toml"))).withColumn("declared_as", F.lit("package"))
    modules = manifests.gomod(named("go.mod").select("repo", "path", "content")).where("module <> ''").select(
        "repo", "path", F.col("module").alias("name"), F.lit(None).cast("string").alias("version"),
        F.when(F.col("go_version") != "", F.col("go_version")).alias("runtime_version"), F.lit("go").alias("language"),
        F.array_sort("dependencies").alias("dependencies"), F.lit("module").alias("declared_as"))
    lines = F.transform(F.split("content", "\n"), lambda l: F.when(
        F.btrim(l, F.lit(" \t\r\n\x0b\x0c")).rlike("^[-#]"), F.lit("")).otherwise(deps.requirement_name(l)))
    wanted = files.where(F.lower("name").startswith("requirements") & (F.col("ext") == ".txt"))
    place = paths.base_name(_dir(F.col("path")))
    listed = wanted.select("repo", "path", place.alias("name"), F.lit(None).cast("string").alias("version"),
                           F.lit(None).cast("string").alias("runtime_version"), F.lit("python").alias("language"),
                           F.array_sort(F.filter(lines, lambda n: n != "")).alias("dependencies"),
                           F.lit("directory").alias("declared_as")).where(F.size("dependencies") > 0)
    return _union(*[part.select(*columns) for part in (package, project, modules, listed)])


def manifest_job(files: DataFrame) -> dict[str, DataFrame]:
    # lists of one format lie together, and read together one task would get most of them
    listed = durable(dealt(dependency_lists(files)), "lists")
    comps = manifests.codebase_components(listed)
    keys = ["repo", "path"]
    known = comps.join(listed.select(*keys, "version", "runtime_version", "declared_as", "dependencies"), keys)
    known = durable(known, "codebases")
    version_of = lambda language: F.when(F.col("language") == language, F.col("runtime_version"))
    nodes = shaped(known, "nodes", line=1, kind="service", attrs=attributes(
        manifest=paths.base_name(F.col("path")), directory=F.col("directory"), dependencyCount=F.col("dependency_count"),
        module=F.when(F.col("declared_as") == "module", F.col("name")), package=F.when(F.col("declared_as") == "package", F.col("name")),
        version=F.col("version"), goVersion=version_of("go"), pythonVersion=version_of("python"),
        nodeVersion=F.coalesce(version_of("javascript"), version_of("typescript"))))
    last = lambda c: F.substring_index(c, "/", -1)
    aliases = shaped(known, "aliases", line=1, target_name=F.col("name"), name=last(F.col("directory")),
                     dns=F.array_distinct(F.array(last(F.col("directory")), last(F.col("name")))))
    # one per file and technology: two lists of one directory both speak
    zero = F.char(F.lit(0))
    implied = manifests.implied_infrastructure(known.select(
        "repo", F.concat("id", zero, "path").alias("component"), "path", F.explode("dependencies").alias("dependency")))
    implied = implied.withColumn("from_node", F.get(F.split("from_node", "\x00"), F.lit(0)))
    hints = shaped(implied, "hints", role="library", line=1, kind="library", raw=F.col("dependency"), tokens=F.array("tech"), port=0,
                   protocol=F.col("tech"), detail=F.concat(paths.base_name(F.col("path")), F.lit(' depends on "'), "dependency",
                                                           F.lit('", which indicates '), "tech"))
    json_files = files.where(F.lower("name").isin("package.json", "pyproject.toml"))
    return {"nodes": nodes, "hints": hints, "aliases": aliases, "diagnostics": unreadable(json_files, "manifest_parse_failed")}


def _named_files(files: DataFrame) -> DataFrame:
    return files.select("repo", "dir", F.col("name").alias("file_name"), "content")


def _path() -> Column:
    """Path of a (dir, file_name) row; the root directory is '' or '.'."""
    return F.concat_ws("/", F.when(~F.col("dir").isin("", "."), F.col("dir")), "file_name")


def dockerfile_job(files: DataFrame) -> dict[str, DataFrame]:
    named = durable(dockerfile.instructions(_named_files(files)), "instructions")
    comps = durable(dockerfile.components(named), "dockerfiles")
    nodes = shaped(comps, "nodes", path=_path(), directory=F.col("dir"), attrs=attributes(
        dockerfile=F.col("file_name"), directory=F.col("dir"), baseImage=F.col("base_image"),
        buildStages=F.when(F.col("build_stages") > 1, F.col("build_stages"))))
    refs = dockerfile.references(comps.select("*"))
    places = comps.select("repo", F.col("id").alias("from_node"), _path().alias("path")).distinct()
    hints = shaped(refs.join(places, ["repo", "from_node"]), "hints", role="reference",
                   detail=F.concat(F.lit("ENV "), "key", F.lit("="), "raw"))
    aliases = dockerfile.aliases(comps).join(comps.select("repo", "dir", "file_name"), ["repo", "dir"])
    aliases = shaped(aliases, "aliases", path=_path(), dns=F.array("name"))
    diagnostics = shaped(dockerfile.no_base_image(named), "diagnostics", message=F.lit(
        "this file has no FROM instruction, so nothing could be said about what it builds or what the result runs on"))
    return {"nodes": nodes, "hints": hints, "aliases": aliases, "diagnostics": diagnostics}


def dotenv_job(files: DataFrame) -> dict[str, DataFrame]:
    refs = durable(dotenv.references(_named_files(files)), "settings")
    unfilled = dotenv.placeholder_diagnostics(refs)
    return {
        "hints": shaped(dotenv.dotenv_hints(refs), "hints", role="reference"),
        "diagnostics": shaped(unfilled, "diagnostics", severity="info", message=F.concat(
            F.col("n_keys").cast("string"), F.lit(" values are placeholders and were not followed: "), "keys"))}


# ------------------------------------------------------------------- resources
def resource_job(rows: DataFrame) -> dict[str, DataFrame]:
    """Declared resources, given as rows. An address in another file of the
    repository becomes a reference that the ladder answers by name."""
    found, calls, refs = resources.resource_classify(rows), resources.module_calls(rows), resources.resource_references(rows)
    nodes = _union(
        shaped(found, "nodes", runtime=F.col("provider"), attrs=attributes(
            address=F.col("address"), provider=F.col("provider"), managed=F.col("managed"), multiplicity=F.col("multiplicity"))),
        shaped(calls, "nodes", kind="cloud_resource", runtime="terraform", framework="module", attrs=attributes(
            address=F.concat(F.lit("module."), "name"), terraformModule=F.col("name"), source=F.col("source"), external=F.col("external"))))
    own = F.regexp_replace("src", "^[a-z]+:", "")
    edges = shaped(refs.where("outcome = 'edge'"), "edges", detail=F.concat(own, F.lit(" refers to "), "ref_address"))
    hints = shaped(refs.where("outcome = 'hint'"), "hints", role="reference", from_node=F.col("src"), raw=F.col("ref_address"),
                   tokens=F.array("ref_address"), port=0, protocol="", suggested_edge=F.col("kind"), kind="traversal",
                   detail=F.concat(own, F.lit(" refers to "), "ref_address"))
    aliases = shaped(found, "aliases", target_name=F.col("address"), dns=F.array("address"))
    place = _dir(F.col("path"))
    diagnostics = _union(
        shaped(resources.resource_diagnostics(rows), "diagnostics"),
        shaped(refs.where("outcome = 'unresolved'"), "diagnostics", severity="info", code="terraform_unresolved_reference",
               path=place, line=0, message=F.col("ref_address")),
        shaped(calls.where("code IS NOT NULL"), "diagnostics", severity="info", message=F.concat(
            F.lit("module "), "name", F.lit(" comes from outside the repository; its resources are not known"))))
    return {"nodes": nodes, "edges": edges, "hints": hints, "aliases": aliases, "diagnostics": diagnostics}


JOBS = {"compose": compose_job, "dockerfile": dockerfile_job, "dotenv": dotenv_job, "helm": helm_job, "k8s": k8s_job, "manifest": manifest_job}


def built_in(jobs: Jobs | None = None) -> Jobs:
    """A registry with all built-in jobs, each over the files routed to it. Add further jobs with ``register``."""
    jobs = jobs or Jobs()
    claims = route_conditions(F.col("name"), F.col("ext"))
    for name, run in JOBS.items():
        jobs.register(name, claims[name], run)
    return jobs
