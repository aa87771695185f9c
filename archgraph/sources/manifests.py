"""Dependency manifests: requirement lists, module files, package documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions import deps, ids, paths
from archgraph.functions.text import array_first, strip

PACKAGE = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>, engines map<string,string>"
PYPROJECT = ("project struct<name:string,version:string,dependencies:array<string>,`requires-python`:string>, "
             "tool struct<poetry:struct<name:string,version:string,dependencies:map<string,string>>>")


def requirements_deps(files: DataFrame) -> DataFrame:
    """One row per named requirement."""
    lines = files.select("*", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).drop("content")
    return lines.withColumn("name", F.when(strip(F.col("raw")).rlike("^[-#]"), F.lit("")).otherwise(deps.requirement_name(F.col("raw")))).where(
        "name <> ''").withColumn("line", F.col("pos") + 1).drop("pos", "raw")


def gomod(files: DataFrame) -> DataFrame:
    """module, go_version and direct dependencies of module files."""
    blocks = F.regexp_extract_all("content", F.lit(r"(?ms)^require\s*\(\s*$(.*?)^\s*\)"), F.lit(1))
    lines = F.concat(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))),
                     F.regexp_extract_all("content", F.lit(r"(?m)^require\s+([^(\s].*)$"), F.lit(1)))
    direct = F.filter(F.transform(lines, strip), lambda l: (l != "") & ~l.startswith("//") & ~l.rlike(r"//\s*indirect\b"))
    named = F.transform(direct, lambda l: F.regexp_extract(l, r'^"?([^\s"]+)', 1))
    return files.select(
        *[c for c in files.columns if c != "content"], F.regexp_extract("content", r'(?m)^module\s+"?([^\s"]+)', 1).alias("module"),
        F.regexp_extract("content", r"(?m)^go\s+(\S+)", 1).alias("go_version"), named.alias("dependencies"))


def package_json(docs: DataFrame) -> DataFrame:
    """Package documents that have a name; unreadable ones give no row here
    (``unreadable`` lists them)."""
    d = docs.withColumn("p", F.from_json("doc", PACKAGE)).where(F.coalesce("p.name", F.lit("")) != "")
    has = lambda c: F.coalesce(F.map_contains_key(F.col(c), F.lit("typescript")), F.lit(False))
    none = F.array().cast("array<string>")
    return d.select(
        "repo", "path", F.col("p.name").alias("name"), F.col("p.version").alias("version"),
        F.try_element_at("p.engines", F.lit("node")).alias("runtime_version"),
        F.when(has("p.dependencies") | has("p.devDependencies"), F.lit("typescript")).otherwise("javascript").alias("language"),
        F.array_sort(F.coalesce(F.map_keys("p.dependencies"), none)).alias("dependencies"))


def pyproject(docs: DataFrame) -> DataFrame:
    """Project documents: the standard block if it names the project, else
    Poetry's, whose 'python' entry is not a dependency."""
    d = docs.withColumn("p", F.from_json("doc", PYPROJECT))
    std = F.coalesce("p.project.name", F.lit("")) != ""
    poetry = F.coalesce("p.tool.poetry.name", F.lit("")) != ""
    none = F.array().cast("array<string>")
    named = F.transform(F.coalesce("p.project.dependencies", none), deps.requirement_name)
    listed = F.filter(F.coalesce(F.map_keys("p.tool.poetry.dependencies"), none), lambda k: k != "python")
    return d.where(std | poetry).select(
        "repo", "path", F.when(std, F.col("p.project.name")).otherwise(F.col("p.tool.poetry.name")).alias("name"),
        F.when(std, F.col("p.project.version")).otherwise(F.col("p.tool.poetry.version")).alias("version"),
        F.when(std, F.col("p.project.`requires-python`")).alias("runtime_version"), F.lit("python").alias("language"),
        F.array_sort(F.when(std, named).otherwise(listed)).alias("dependencies"))


def codebase_components(manifests: DataFrame) -> DataFrame:
    """One component per manifest, identified by its directory. ``manifests``:
    repo, path, name, language, dependencies (sorted)."""
    dir_ = F.when(paths.dir_of(F.col("path")) == "", F.lit(".")).otherwise(paths.dir_of(F.col("path")))
    framework = array_first(F.filter(F.transform("dependencies", lambda d: deps.framework_of(d)), lambda f: f.isNotNull()))
    place = F.when(dir_ == ".", F.lit("root")).otherwise(dir_)
    return manifests.select(
        "repo", "path", ids.node_id(F.lit("service"), F.lit(""), place).alias("id"), "name", dir_.alias("directory"), "language",
        F.coalesce(framework, F.lit("")).alias("framework"), F.size("dependencies").alias("dependency_count"), F.lit(80).alias("conf_pct"))


def manifest_aliases(comps: DataFrame) -> DataFrame:
    """Names a codebase answers to: its directory's and its module's last part."""
    last = lambda c: F.substring_index(c, "/", -1)
    return comps.select("repo", F.col("name").alias("target_name"), F.explode(F.array_distinct(F.array(
        last(F.col("directory")), last(F.col("name"))))).alias("name"))


def implied_infrastructure(dependencies: DataFrame) -> DataFrame:
    """One hint per (component, technology) a dependency implies, carrying the
    alphabetically first such dependency. ``dependencies``: repo, component,
    dependency, path."""
    lib = dependencies.withColumn("lib", deps.library_of(F.col("dependency"))).where("lib IS NOT NULL")
    return lib.groupBy("repo", F.col("component").alias("from_node"), F.col("lib.tech").alias("tech")).agg(
        F.min(F.struct("dependency", "path", F.col("lib.edge").alias("suggested_edge"))).alias("first"),
    ).select("repo", "from_node", "tech", "first.*").withColumn("vendor", deps.is_vendor(F.col("tech")))


def unreadable(docs: DataFrame, code_of: dict[str, str]) -> DataFrame:
    """A bad document is a diagnostic row, never a failed job. ``docs``: repo,
    path, format, doc; ``code_of``: format -> diagnostic code."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in code_of.items() for x in kv]), F.col("format"))
    # wrapped in a list, text after the document's end is an error too
    boxed = F.try_parse_json(F.concat(F.lit("["), "doc", F.lit("]")))
    bad = boxed.isNull() | F.try_variant_get(boxed, "$[1]", "variant").isNotNull() | F.try_variant_get(boxed, "$[0]", "variant").isNull()
    return docs.where(bad).select(
        "repo", "path", F.lit("warn").alias("severity"), code.alias("code"), F.lit("could not read this document").alias("message"))
