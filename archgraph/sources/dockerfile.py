"""Image build files.

A file is one row; its lines are folded inside the row, because joining
continued lines and skipping here-documents is sequential. The size limit of
the file table bounds the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import ids, images, net, paths
from archgraph.functions.redact import redact_value
from archgraph.functions.text import array_first, let, strip

_STATE = "struct<joined:string,start:int,docs:array<string>,n:int,out:array<struct<keyword:string,args:string,line:int>>>"
_HEREDOC = r"""<<-?\s*(?:"([^"]+)"|'([^']+)'|([A-Za-z_][A-Za-z0-9_]*))"""
_VARIABLE = r"\$(?:\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)"


def _instruction(text: Column, line: Column) -> Column:
    t = strip(text)
    return F.struct(F.upper(F.substring_index(t, " ", 1)).alias("keyword"),
                    strip(F.regexp_replace(t, r"^[^ ]*", "")).alias("args"), line.alias("line"))


def _terminators(text: Column) -> Column:
    groups = [F.regexp_extract_all(text, F.lit(_HEREDOC), F.lit(i)) for i in (1, 2, 3)]
    return F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b))


def logical_lines(content: Column) -> Column:
    """array<struct(keyword, args, line)> of a build file."""
    lines = F.transform(F.split(F.regexp_replace(content, "^﻿", ""), "\n"), lambda l: F.regexp_replace(l, "\r$", ""))

    def state(joined, start, docs, n, out):
        return F.struct(joined.alias("joined"), start.alias("start"), docs.alias("docs"), n.alias("n"), out.alias("out")).cast(_STATE)

    def step(s: Column, raw: Column) -> Column:
        n = s["n"] + 1

        def read(t: Column) -> Column:
            first = s["joined"] == ""
            start = F.when(first, n).otherwise(s["start"])
            more = F.endswith(t, F.lit("\\"))
            part = F.regexp_replace(t, r"\\$", "")
            joined = F.when(first, part).otherwise(F.concat(s["joined"], F.lit(" "), part))
            skip = F.startswith(t, F.lit("#")) | (first & (t == ""))
            done = let(joined, lambda j: state(
                F.lit(""), start, _terminators(j), n,
                F.when(strip(j) == "", s["out"]).otherwise(F.concat(s["out"], F.array(_instruction(j, start))))))
            in_doc = F.size(s["docs"]) > 0
            closes = (t == array_first(s["docs"])) | (raw == array_first(s["docs"]))
            return (
                F.when(in_doc, state(s["joined"], s["start"], F.when(closes, F.slice(s["docs"], F.lit(2), F.size(s["docs"])))
                                     .otherwise(s["docs"]), n, s["out"]))
                .when(skip, state(s["joined"], s["start"], s["docs"], n, s["out"]))
                .when(more, state(joined, start, s["docs"], n, s["out"]))
                .otherwise(done))

        return let(strip(raw), read)

    empty = F.struct(F.lit("").alias("joined"), F.lit(0).alias("start"), F.array().alias("docs"), F.lit(0).alias("n"),
                     F.array().alias("out")).cast(_STATE)
    return F.aggregate(lines, empty, step, lambda s: F.when(
        strip(s["joined"]) == "", s["out"]).otherwise(F.concat(s["out"], F.array(_instruction(s["joined"], s["start"])))))


def instructions(files: DataFrame) -> DataFrame:
    """Files with their ``ins`` array; everything below starts here. Files that have it already are as they are."""
    return files if "ins" in files.columns else files.withColumn("ins", logical_lines(F.col("content"))).drop("content")


def stages(ins: Column) -> Column:
    """array<struct(image, name, line, base)>: build stages in order; ``base``
    is the image a stage really starts from, following stage names back."""
    froms = F.filter(ins, lambda i: i["keyword"] == "FROM")
    fields = F.transform(froms, lambda i: F.struct(
        F.filter(F.split(F.regexp_replace(strip(i["args"]), r"^(--\S+\s+)*(--\S+$)?", ""), r"\s+"), lambda w: w != "").alias("w"), i["line"].alias("line")))
    named = F.transform(F.filter(fields, lambda f: F.size(f["w"]) > 0), lambda f: F.struct(
        F.get(f["w"], F.lit(0)).alias("image"),
        F.when((F.size(f["w"]) >= 3) & (F.lower(F.get(f["w"], F.lit(1))) == "as"), F.get(f["w"], F.lit(2))).otherwise("").alias("name"),
        f["line"].alias("line")))
    shape = "array<struct<image:string,name:string,line:int,base:string>>"

    def follow(acc: Column, s: Column) -> Column:
        earlier = F.filter(acc, lambda e: (e["name"] != "") & (F.lower(e["name"]) == F.lower(s["image"])))
        base = F.coalesce(F.try_element_at(earlier, F.lit(-1))["base"], s["image"])
        return F.concat(acc, F.array(F.struct(s["image"].alias("image"), s["name"].alias("name"), s["line"].alias("line"), base.alias("base"))))

    return F.aggregate(named, F.array().cast(shape), follow)


def _unquote(v: Column) -> Column:
    """Value without its quotes; NULL if quotes do not pair up."""
    quoted = r"""^(["'])(.*)\1$"""
    return F.when(v.rlike(quoted) & (F.length(v) >= 2), F.regexp_extract(v, quoted, 2)).when(~v.rlike("""["']"""), v)


def assignments(keyword: Column, args: Column) -> Column:
    """array<struct(key, value)> of one ENV or ARG instruction."""
    first = F.regexp_extract(args, r"^(\S+)", 1)
    spaced = (keyword == "ENV") & ~F.contains(first, F.lit("="))
    rest = _unquote(strip(F.regexp_replace(args, r"^\S+", "")))
    single = F.array(F.struct(first.alias("key"), rest.alias("value")))
    tokens = F.regexp_extract_all(args, F.lit(r"""(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^\s"'])+"""), F.lit(0))
    pairs = F.transform(F.filter(tokens, lambda t: F.contains(t, F.lit("="))), lambda t: F.struct(
        strip(F.substring_index(t, "=", 1)).alias("key"), _unquote(strip(F.regexp_replace(t, r"^[^=]*=", ""))).alias("value")))
    return F.filter(F.when(spaced, single).otherwise(pairs), lambda a: (a["key"] != "") & a["value"].isNotNull() & (a["value"] != ""))


def substitute(text: Column, known: Column) -> Column:
    """Replace $X and ${X} whose value is fully known."""
    gaps = F.split(text, _VARIABLE)
    filled = F.transform(F.regexp_extract_all(text, F.lit(_VARIABLE), F.lit(0)), lambda m: let(
        F.try_element_at(known, F.translate(m, "${}", "")),
        lambda v: F.when(v.isNotNull() & ~F.contains(v, F.lit("$")), v).otherwise(m)))
    return F.array_join(F.zip_with(gaps, filled, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def build_args(ins: Column) -> Column:
    """map of ARG and ENV values, evaluated in file order; a later value
    replaces an earlier one."""
    sets = F.flatten(F.transform(F.filter(ins, lambda i: i["keyword"].isin("ENV", "ARG")), lambda i: assignments(i["keyword"], i["args"])))

    def put(m: Column, a: Column) -> Column:
        kept = F.map_filter(m, lambda k, v: k != a["key"])
        return F.map_concat(kept, F.create_map(a["key"], substitute(a["value"], m)))

    return F.aggregate(sets, F.create_map().cast("map<string,string>"), put)


def exposed_ports(ins: Column, known: Column) -> Column:
    args = F.filter(ins, lambda i: i["keyword"] == "EXPOSE")
    words = F.flatten(F.transform(args, lambda i: F.split(strip(substitute(i["args"], known)), r"\s+")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(words, lambda w: net.valid_port(F.substring_index(w, "/", 1))))))


def components(files: DataFrame) -> DataFrame:
    """One component per build file: named after its directory, with kind and
    language read off its base image; files without FROM have no component."""
    d = instructions(files).withColumn("stages", stages(F.col("ins"))).withColumn("dir", F.when(F.col("dir") == "", F.lit(".")).otherwise(F.col("dir")))
    d = d.withColumn("base", F.try_element_at("stages", F.lit(-1))["base"])
    d = d.withColumns({"k": images.image_kind(F.col("base")), "own_language": images.base_image_language(F.col("base")),
                       "is_os": images.base_image_is_os(F.col("base")),
                       "stage_language": array_first(F.filter(F.transform("stages", lambda s: images.base_image_language(s["base"])), lambda l: l.isNotNull()))})
    plain = ~F.col("k.recognised") | F.col("is_os")
    code = F.col("own_language").isNotNull() | (F.col("k.kind") == "cloud_resource")
    kind = F.when(plain | code, F.lit("service")).otherwise(F.col("k.kind"))
    return d.where(F.size("stages") > 0).select(
        "repo", "dir", "file_name", "ins",
        ids.node_id(kind, F.lit(""), F.when(F.col("dir") == ".", F.lit("root")).otherwise(F.col("dir"))).alias("id"),
        kind.alias("kind"), paths.component_name(F.col("dir")).alias("name"),
        F.coalesce("own_language", "stage_language", F.lit("")).alias("language"),
        F.when(plain, F.lit("")).otherwise(F.col("k.tech")).alias("framework"),
        F.col("base").alias("base_image"), F.size("stages").alias("build_stages"),
        exposed_ports(F.col("ins"), build_args(F.col("ins"))).alias("ports"),
        array_first("stages")["line"].alias("line"), F.lit("directory").alias("name_from"), F.lit(80).alias("conf_pct"))


def no_base_image(files: DataFrame) -> DataFrame:
    d = instructions(files).where(F.size(stages(F.col("ins"))) == 0)
    return d.select("repo", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "file_name").alias("path"),
                    F.lit("info").alias("severity"), F.lit("dockerfile_no_base_image").alias("code"))


def references(comps: DataFrame) -> DataFrame:
    """Locations set by ENV; values that still hold a variable are not read."""
    env = comps.select("repo", "dir", "file_name", F.col("id").alias("from_node"), F.explode(F.filter("ins", lambda i: i["keyword"] == "ENV")).alias("i"))
    sets = env.select("*", F.col("i.line").alias("line"), F.explode(assignments(F.col("i.keyword"), F.col("i.args"))).alias("a")).select(
        "repo", "dir", "file_name", "from_node", "line", "a.key", "a.value").where(~F.contains("value", F.lit("$")))
    refs = net.parse_references(sets, "key", "value")
    return refs.select("repo", "from_node", "line", "key", F.col("ref.kind").alias("kind"),
                       redact_value(F.col("key"), F.col("value")).alias("raw"), F.col("ref.tokens").alias("tokens"),
                       F.col("ref.port").alias("port"), F.col("ref.protocol").alias("protocol"), F.col("ref.edge").alias("suggested_edge"))


def aliases(comps: DataFrame) -> DataFrame:
    """The directory's own name routes to the component, unless the directory
    is named for a role."""
    from archgraph import vocab

    base = paths.base_name(F.col("dir"))
    return comps.where((base != ".") & ~F.lower(base).isin(*vocab.words(vocab.GENERIC_DIRECTORIES))).select(
        "repo", base.alias("name"), F.col("name").alias("target_name"), "dir", "line")
