"""Ignore rules: which files of a repository are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions import paths

_GAP = "(?:/[^/]+)*"


def _segment_regex(seg: Column) -> Column:
    out = F.regexp_replace(seg, r"([.+$(){}|])", r"\\$1")
    out = F.regexp_replace(out, r"(?<!\[)\^", r"\\^")
    out = F.regexp_replace(out, r"\?", "[^/]")
    return F.concat(F.lit("/"), F.regexp_replace(out, r"(?<!\\)\*", "[^/]*"))


def compile_patterns(rules: DataFrame) -> DataFrame:
    """Ignore lines (repo, base, line, pattern) as regular expressions over
    '/' + path below the rule file's directory: adds negate, dir_only, regex."""
    text = F.regexp_replace("pattern", r"(?<!\\)[ \t]+$", "")
    r = rules.withColumn("t", text).where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    r = r.withColumn("negate", F.startswith("t", F.lit("!"))).withColumn("t", F.regexp_replace("t", r"^!", ""))
    r = r.withColumn("t", F.regexp_replace("t", r"^\\([#!])", "$1"))
    r = r.withColumn("dir_only", F.endswith("t", F.lit("/"))).withColumn("t", F.regexp_replace("t", "/$", "")).where("t <> ''")
    anchored = F.contains("t", F.lit("/"))
    body = F.array_join(F.transform(
        F.split(F.regexp_replace("t", "^/", ""), "/"),
        lambda s: F.when(s == "**", F.lit(_GAP)).otherwise(_segment_regex(s))), "")
    return r.withColumn("regex", F.concat(
        F.lit("^"), F.when(anchored, F.lit("")).otherwise(_GAP), body, F.lit("$"))).drop("t")


def default_verdict(prefix: Column, is_dir: Column) -> Column:
    """The built-in patterns; all of them float."""
    names = vocab.words(vocab.DEFAULT_IGNORES)
    fold = lambda ws: "|".join(w.replace(".", r"\.").replace("*", "[^/]*") for w in ws)
    dirs = fold(w[:-1] for w in names if w.endswith("/"))
    plain = fold(w for w in names if not w.endswith("/"))
    base = paths.base_name(prefix)
    return (is_dir & base.rlike(f"^({dirs})$")) | base.rlike(f"^({plain})$")


def ignored_prefixes(files: DataFrame, rules: DataFrame, defaults: bool = True) -> DataFrame:
    """(repo, prefix): directories and files the rules exclude.

    A path is judged by its prefixes, each distinct directory once. A rule file
    applies below its own directory, so rules are found by equi-join on the
    ancestors of a prefix; the deepest file and, within it, the last matching
    line decides.
    """
    p = files.select("repo", "path").distinct().select("repo", "path", F.explode(paths.ancestor_prefixes(F.col("path"))).alias("prefix"))
    prefixes = p.select("repo", "prefix", (F.col("prefix") != F.col("path")).alias("is_dir")).distinct()
    bases = prefixes.withColumn("base", F.explode(F.concat(
        F.array(F.lit("")), F.slice(paths.ancestor_prefixes(F.col("prefix")), F.lit(1), F.size(F.split("prefix", "/")) - 1))))
    below = F.when(F.col("base") == "", F.concat(F.lit("/"), "prefix")).otherwise(F.expr("substring(prefix, length(base) + 1)"))
    hits = (bases.join(compile_patterns(rules).drop("pattern"), ["repo", "base"])
            .where((F.col("is_dir") | ~F.col("dir_only")) & F.rlike(below, F.col("regex"))))
    depth = F.when(F.col("base") == "", F.lit(0)).otherwise(F.size(F.split("base", "/")))
    judged = hits.groupBy("repo", "prefix", "is_dir").agg(F.max_by(~F.col("negate"), F.struct(depth, "line")).alias("verdict"))
    fallback = default_verdict(F.col("prefix"), F.col("is_dir")) if defaults else F.lit(False)
    return (prefixes.join(judged, ["repo", "prefix", "is_dir"], "left")
            .where(F.coalesce("verdict", fallback)).select("repo", "prefix").distinct())


def ignore_filter(files: DataFrame, rules: DataFrame, defaults: bool = True) -> DataFrame:
    """Files none of whose directories, nor they themselves, are excluded."""
    excluded = ignored_prefixes(files, rules, defaults)
    dropped = (files.select("repo", "path").distinct()
               .select("repo", "path", F.explode(paths.ancestor_prefixes(F.col("path"))).alias("prefix"))
               .join(excluded, ["repo", "prefix"], "left_semi").select("repo", "path").distinct())
    return files.join(dropped, ["repo", "path"], "left_anti")
