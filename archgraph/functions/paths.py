"""Repository-relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions.text import array_first, strip


def dir_of(path: Column) -> Column:
    """Directory part, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def clean_path(path: Column) -> Column:
    """Lexical path clean-up: '.', '..' and doubled slashes are resolved."""
    absolute = F.startswith(path, F.lit("/"))
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    climbed = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
                   F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(absolute, acc).otherwise(F.concat(acc, F.array(s))))
        .otherwise(F.concat(acc, F.array(s))))
    joined = F.concat(F.when(absolute, F.lit("/")).otherwise(""), F.array_join(climbed, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def normalize_dir(dir_: Column) -> Column:
    return clean_path(strip(dir_))


def is_ancestor_dir(dir_: Column, child: Column) -> Column:
    return (dir_ == ".") | F.startswith(child, F.concat(dir_, F.lit("/")))


def common_dir_prefix(a: Column, b: Column) -> Column:
    """Number of leading segments two directories share; '.' shares none."""
    equal = F.zip_with(F.split(a, "/"), F.split(b, "/"),
                       lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_gap = F.array_position(equal, False)
    return (F.when((a == ".") | (b == "."), F.lit(0))
            .when(first_gap == 0, F.size(equal)).otherwise(first_gap - 1).cast("int"))


def valid_rel_path(path: Column) -> Column:
    return ((path == "")
            | ~(F.contains(path, F.lit("\\")) | path.rlike(r"^/|^.:|(^|/)\.\.(/|$)")))


def ancestor_prefixes(path: Column) -> Column:
    """Every directory prefix of a path, shortest first, the path included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def component_name(dir_: Column) -> Column:
    """Nearest ancestor directory that is named for a component."""
    generic = vocab.words(vocab.GENERIC_DIRECTORIES)
    named = F.filter(F.reverse(F.split(dir_, "/")),
                     lambda s: ~F.lower(s).isin(*generic) & ~s.isin("", "."))
    return F.coalesce(array_first(named), F.lit("app"))


def is_template(path: Column, content: Column) -> Column:
    braces = F.lit("{{")
    return F.contains(content, braces) & (
        dir_of(path).rlike(r"(^|/)templates(/|$)") | F.startswith(strip(content), braces))


def chart_dir(path: Column) -> Column:
    """Directory holding the templates folder a file is in, else NULL."""
    found = F.regexp_extract(path, r"^(.+?)/templates(/|$)", 1)
    return F.when(found != "", found)


def is_kustomization(name: Column) -> Column:
    return F.lower(name).isin("kustomization.yaml", "kustomization.yml", "kustomization")


def is_chart_file(name: Column) -> Column:
    return F.lower(name).isin("chart.yaml", "chart.yml")


def is_values_file(name: Column) -> Column:
    return F.lower(name).rlike(r"^values\.ya?ml$|^values[.\-].*\.ya?ml$")


def is_example_file(name: Column) -> Column:
    return F.lower(name).rlike("|".join(vocab.words(vocab.EXAMPLE_FILE_MARKERS)))
