"""Measuring a graph against expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import paths
from archgraph.session import parts_for

ANY = "*"

# What an environment variable that locates a component ends in.
ADDRESS_PATTERN = r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9_]*?)_(?:ADDR|ADDRESS|URL|URI|HOST|ENDPOINT)(?![A-Za-z0-9_])"
# Source files read, and directories of other people's code.
SOURCE_EXTENSIONS = ".go .cs .py .js .ts .java .rb .php".split()
VENDORED = "node_modules vendor genproto /bin/ /obj/ site-packages third_party /proto/ /gen/".split()


def _named(edges: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """Distinct (repo, src_name, dst_name) relationships, with ``more`` columns of the edges.

    Pairs are short and alike: cut by their bytes, tens of millions of them
    would be made distinct in one task, so tasks are cut by rows.
    """
    parts, name = parts_for(edges), nodes.select("repo", "id", "name")
    ends = (edges.where("kind <> 'contains'").select("repo", "src", "dst", *more).repartition(parts, "repo", "src", "dst").distinct()
            .join(name.select("repo", F.col("id").alias("src"), F.col("name").alias("src_name")), ["repo", "src"])
            .join(name.select("repo", F.col("id").alias("dst"), F.col("name").alias("dst_name")), ["repo", "dst"]))
    return ends.select("repo", "src_name", "dst_name", *more).repartition(parts, "repo", "src_name", "dst_name").distinct()


def found_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (repo, src_name, dst_name) relationships."""
    return _named(edges, nodes)


def _by_form(wants: DataFrame, src: str, dst: str) -> list[tuple[DataFrame, list[str]]]:
    """Expectations by the sides they leave open, with the columns each form is
    matched on. Pairs are never repeated for forms that nobody wrote."""
    any_src, any_dst = F.col(src) == ANY, F.col(dst) == ANY
    return [(wants.where(~any_src & ~any_dst), ["repo", src, dst]), (wants.where(any_src & ~any_dst).drop(src), ["repo", dst]),
            (wants.where(~any_src & any_dst).drop(dst), ["repo", src]), (wants.where(any_src & any_dst).drop(src, dst), ["repo"])]


def judge_pairs(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Found pairs with is_expected and is_allowed; each form of expectation is
    one equi-join on the sides it names."""
    wants = expected.select("repo", "src_name", "dst_name", (F.col("mode") == "expected").alias("e")).groupBy(
        "repo", "src_name", "dst_name").agg(F.max("e").alias("e"), F.max(~F.col("e")).alias("a"))
    out, forms = found, _by_form(wants, "src_name", "dst_name")
    for i, (form, on) in enumerate(forms):
        out = out.join(form.withColumnsRenamed({"e": f"_e{i}", "a": f"_a{i}"}), on, "left")
    some = lambda c: F.coalesce(F.greatest(*(f"_{c}{i}" for i in range(len(forms)))), F.lit(False))
    return out.select(*found.columns, some("e").alias("is_expected"), some("a").alias("is_allowed"))


def precision_recall(judged: DataFrame, expected: DataFrame) -> DataFrame:
    """Per repo. Precision counts expected or allowed pairs; recall counts met
    expectations; both are 1 where there is nothing to count."""
    prec = judged.groupBy("repo").agg(
        F.count("*").alias("found"), F.sum((F.col("is_expected") | F.col("is_allowed")).cast("int")).alias("correct"))
    wants = expected.where("mode = 'expected'").select("repo", "src_name", "dst_name").distinct()
    rec = wants.groupBy("repo").agg(F.count("*").alias("expected"))
    met = [form.join(judged.select(*on).distinct(), on, "left_semi").select("repo")
           for form, on in _by_form(wants, "src_name", "dst_name")]
    hit = reduce(DataFrame.unionByName, met).groupBy("repo").agg(F.count("*").alias("matched"))
    out = prec.join(rec, "repo", "full_outer").join(hit, "repo", "left").na.fill(0)
    return out.withColumns({
        "precision": F.when(F.col("found") > 0, F.col("correct") / F.col("found")).otherwise(1.0),
        "recall": F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(1.0)})


def precision_by_rule(judged: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Over all repos: how many pairs each rule found, and how many are wrong."""
    ruled = _named(edges, nodes, "rule")
    return ruled.join(judged, ["repo", "src_name", "dst_name"]).groupBy("rule").agg(
        F.count("*").alias("found"), F.sum((~F.col("is_expected") & ~F.col("is_allowed")).cast("int")).alias("wrong")).withColumn(
        "precision", F.lit(1.0) - F.col("wrong") / F.col("found"))


def precision_gate(scores: DataFrame, minimum: float = 0.90) -> DataFrame:
    return scores.where(F.col("precision") < minimum)


def derive_expected_from_source(files: DataFrame, aliases: DataFrame, ignored: list[str]) -> DataFrame:
    """(repo, src_name, dst_name) stated by source code: the address variables
    it reads. ``files``: repo, caller, path, content; ``aliases``: repo, stem,
    callee."""
    vendored = F.lit(False)
    for v in VENDORED:
        vendored = vendored | F.contains("path", F.lit(v))
    read = files.where(paths.extension(F.col("path")).isin(*SOURCE_EXTENSIONS) & ~vendored)
    stems = read.select("repo", "caller", F.explode(F.array_distinct(
        F.regexp_extract_all("content", F.lit(ADDRESS_PATTERN), F.lit(1)))).alias("stem")).distinct()
    named = stems.where(~F.col("stem").isin(*ignored)).join(aliases, ["repo", "stem"], "left").select(
        "repo", F.col("caller").alias("src_name"),
        F.coalesce("callee", F.lower(F.translate("stem", "_", ""))).alias("dst_name"))
    return named.where("dst_name <> '' AND dst_name <> src_name").distinct()


def unaccounted(derived: DataFrame, expected: DataFrame) -> DataFrame:
    """Derived relationships no expectation mentions, in either list."""
    return judge_pairs(derived, expected).where("NOT is_expected AND NOT is_allowed").select("repo", "src_name", "dst_name")


def grade_answers(answers: DataFrame) -> DataFrame:
    """Adds missing, invented (counts) and passed. ``answers``: answer,
    must_mention and must_not_mention (arrays of 'a|b' alternatives), calls,
    max_calls."""
    low = F.lower("answer")
    missing = F.filter("must_mention", lambda f: ~F.exists(
        F.split(f, r"\|"), lambda a: F.contains(low, F.lower(F.btrim(a)))))
    quoted = lambda a: F.regexp_replace(a, r"([^A-Za-z0-9])", r"\\$1")
    invented = F.filter("must_not_mention", lambda f: F.exists(
        F.filter(F.transform(F.split(f, r"\|"), F.btrim), lambda a: a != ""),
        lambda a: F.regexp(F.col("answer"), F.concat(F.lit(r"(?i)(^|[^\w-])"), quoted(a), F.lit(r"($|[^\w-])")))))
    out = answers.withColumns({"missing": F.size(missing), "invented": F.size(invented)})
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("invented") == 0) & (F.col("calls") <= F.col("max_calls")))
