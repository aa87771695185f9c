"""Merging readings, edges and evidence into one graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from archgraph import vocab
from archgraph.functions import ids, paths
from archgraph.functions.redact import redact_string, redact_value
from archgraph.session import durable, is_empty

EVIDENCE = ["rule", "path", "line", "detail", "extractor"]


# ------------------------------------------------------------------- readings
def _placed(readings: DataFrame) -> DataFrame:
    """Readings with ``place``: their order by ``seq``, where that is equal by a
    digest of what they say. One order for every step, in any partitioning."""
    told = sorted(f.name for f in readings.schema.fields if f.name != "seq" and not isinstance(f.dataType, MapType))
    return readings.withColumn("place", F.struct("seq", F.xxhash64(*told).alias("tie")))


def merge_nodes(readings: DataFrame, fields: list[str]) -> DataFrame:
    """One component per (repo, id) from readings ordered by ``seq``.

    A reading overwrites a field only if it is more confident than every
    earlier one; otherwise it fills gaps. Which readings overwrite follows from
    the earliest reading per confidence level alone, so readings are reduced to
    at most 101 levels per component, map-side first, before anything is
    ordered: no component, however often it is read, is gathered in one task.
    """
    first_of = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("place"))).alias(f"gap_{f}") for f in fields]
    first_seq = [F.min(F.when(F.col(f).isNotNull(), F.col("place"))).alias(f"gapseq_{f}") for f in fields]
    levels = _placed(readings).groupBy("repo", "id", "conf_pct").agg(
        F.min("place").alias("place"), F.min_by(F.struct(*fields), "place").alias("first"), *first_of, *first_seq)
    from pyspark.sql import Window

    higher = Window.partitionBy("repo", "id").orderBy(F.desc("conf_pct")).rowsBetween(Window.unboundedPreceding, -1)
    marked = levels.withColumn("overwrites", F.coalesce(F.col("place") < F.min("place").over(higher), F.lit(True)))
    merged = marked.groupBy("repo", "id").agg(
        F.max("conf_pct").alias("conf_pct"),
        *[F.coalesce(
            F.max_by(F.col(f"first.{f}"), F.when(F.col("overwrites") & F.col(f"first.{f}").isNotNull(), F.col("conf_pct"))),
            F.min_by(F.col(f"gap_{f}"), F.col(f"gapseq_{f}"))).alias(f) for f in fields])
    return merged


def _kinds() -> list[Column]:
    imaged = F.coalesce(F.col("image"), F.lit("")) != ""
    special = F.col("kind") != "service"
    return [F.max(imaged).alias("any_image"), F.min_by("kind", F.when(imaged & special, F.col("place"))).alias("with_image"),
            F.min_by("kind", F.when(special, F.col("place"))).alias("without")]


def _kept_kind() -> Column:
    return F.coalesce(F.when(F.col("any_image"), F.col("with_image")).otherwise(F.col("without")), F.lit("service")).alias("kind")


def _names() -> list[Column]:
    return [F.coalesce(F.min_by("name", F.when(F.col("name_from").isNull(), F.col("place"))), F.min_by("name", "place")).alias("name"),
            F.min_by("namespace", F.when(F.col("namespace") != "", F.col("place"))).alias("namespace")]


def merge_kind(readings: DataFrame) -> DataFrame:
    """(repo, id, kind): readings that carry an image outrank the rest; among
    those that count, the first that is not the fallback 'service'."""
    return _placed(readings).groupBy("repo", "id").agg(*_kinds()).select("repo", "id", _kept_kind())


def merge_name(readings: DataFrame) -> DataFrame:
    """(repo, id, name): the first declared name, else the first derived."""
    return _placed(readings).groupBy("repo", "id").agg(*_names())


def merge_place(readings: DataFrame) -> DataFrame:
    """(repo, id, kind, name, namespace, path, line, project): ``merge_kind`` and ``merge_name`` in one pass, and where the first reading stands."""
    out = _placed(readings).groupBy("repo", "id").agg(
        *_kinds(), *_names(), F.min_by(F.struct("path", "line", "project"), "seq").alias("at"))
    return out.select("repo", "id", _kept_kind(), "name", "namespace", "at.path", "at.line", "at.project")


def kind_conflicts(readings: DataFrame) -> DataFrame:
    """Readings that disagree with the kind known when they were met.

    The running kind of a component changes at most three times (first reading,
    first special kind, first imaged reading, first special imaged reading), so
    the change points are aggregated and joined back instead of a running
    window over all readings. Readings of one ``seq`` follow each other too;
    equal ones are one row with a count, the first of which the others have seen.
    """
    told = _placed(readings).select("repo", "id", "place", "path", "kind", (F.coalesce(F.col("image"), F.lit("")) != "").alias("imaged"))
    imaged, special = F.col("imaged"), F.col("kind") != "service"

    def first(cond: Column, tag: str) -> list[Column]:
        at = F.when(cond, F.col("place"))
        return [F.min(at).alias(f"{tag}_place"), F.min_by("kind", at).alias(f"{tag}_kind")]

    points = told.groupBy("repo", "id").agg(
        *first(F.lit(True), "any"), *first(special, "special"), *first(imaged, "image"), *first(imaged & special, "strong"))
    copies = F.concat(F.array(F.lit(False)), F.array_repeat(F.lit(True), (F.col("n") - 1).cast("int")))
    joined = told.groupBy(*told.columns).agg(F.count("*").alias("n")).join(points, ["repo", "id"]).withColumn("again", F.explode(copies))
    before = lambda tag: (F.col(f"{tag}_place") < F.col("place")) | (F.col("again") & (F.col(f"{tag}_place") == F.col("place")))
    running = (F.when(before("strong"), F.col("strong_kind")).when(before("image"), F.col("image_kind"))
               .when(before("special"), F.col("special_kind")).when(before("any"), F.col("any_kind")))
    seen_image = before("image")
    wins = F.when(imaged != F.coalesce(seen_image, F.lit(False)), imaged).otherwise((F.col("was") == "service") & special)
    return joined.withColumn("was", running).where(F.col("was").isNotNull() & (F.col("was") != F.col("kind"))).select(
        "repo", "id", "place.seq", "path", "was", F.col("kind").alias("also"),
        F.when(wins, F.col("kind")).otherwise(F.col("was")).alias("kept"))


# ---------------------------------------------------------------------- edges
def edge_evidence(edges: DataFrame) -> DataFrame:
    """The distinct pieces of evidence of every edge, as a fact table. Evidence
    is kept one row each, never nested: an edge may have any amount of it."""
    known = edges.withColumn("protocol", F.coalesce("protocol", F.lit("")))
    return known.select("repo", _edge_id().alias("edge_id"), *EVIDENCE).distinct()


def _edge_id() -> Column:
    return ids.edge_id(F.col("src"), F.col("dst"), F.col("kind"), F.col("protocol"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind, protocol) with its best confidence."""
    return edges.groupBy("repo", "src", "dst", "kind", F.coalesce("protocol", F.lit("")).alias("protocol")).agg(
        F.max("conf_pct").alias("conf_pct")).withColumn("id", _edge_id())


def top_evidence(edges: DataFrame) -> DataFrame:
    """The first piece of evidence of every edge in canonical order; apart from
    ``merge_edges``, which stays a hash aggregation of numbers. Edges are told
    apart by what they join, as among tens of millions some share an id."""
    first = edges.groupBy("repo", "src", "dst", "kind", F.coalesce("protocol", F.lit("")).alias("protocol")).agg(
        F.min(F.struct(*EVIDENCE)).alias("e"))
    return first.select("repo", _edge_id().alias("edge_id"), "e.*")


def collapse_generic_edges(edges: DataFrame) -> DataFrame:
    """Where a pair has a specific relationship, its generic depends_on is that
    relationship: adds ``target_id``, the edge each edge ends up in."""
    specific = edges.where(~F.col("kind").isin("depends_on", "contains")).groupBy("repo", "src", "dst").agg(
        F.max_by("id", F.struct("kind", "protocol", "id")).alias("specific_id"))
    return edges.join(specific, ["repo", "src", "dst"], "left").withColumn(
        "target_id", F.when(F.col("kind") == "depends_on", F.coalesce("specific_id", "id")).otherwise(F.col("id"))).drop("specific_id")


def collapsed(edges: DataFrame) -> DataFrame:
    """Edges after folding: confidence is the best of what was folded in."""
    moved = collapse_generic_edges(edges)
    # within a pair, as edges of other pairs may share the id
    best = moved.groupBy("repo", "src", "dst", F.col("target_id").alias("id")).agg(
        F.max("conf_pct").alias("best"), F.sum((F.col("id") != F.col("target_id")).cast("int")).alias("n_folded"))
    return moved.where(F.col("id") == F.col("target_id")).drop("target_id", "conf_pct").join(best, ["repo", "src", "dst", "id"]).withColumnRenamed(
        "best", "conf_pct")


def collapsed_evidence(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence under the edges that are left: what spoke for a folded edge
    speaks for the one it was folded into."""
    moved = collapse_generic_edges(edges).select("repo", F.col("id").alias("edge_id"), "target_id")
    return evidence.join(moved, ["repo", "edge_id"]).select("repo", F.col("target_id").alias("edge_id"), *EVIDENCE).distinct()


# --------------------------------------------------------------------- merges
def fold_directory_duplicates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merge map, refused directories) for codebases that share a directory.

    A name of its own beats a name taken from the directory; two names of their
    own leave it open which one the derived ones belong to.
    """
    code = nodes.where((F.coalesce("directory", F.lit("")) != "") & (F.size("images") == 0))
    derived = F.col("name_from").isNotNull()
    by_dir = code.groupBy("repo", "directory").agg(
        F.sum(derived.cast("int")).alias("n_derived"), F.sum((~derived).cast("int")).alias("n_declared"),
        F.min(F.when(derived, F.col("id"))).alias("first_derived"), F.min(F.when(~derived, F.col("id"))).alias("first_declared"))
    decided = by_dir.where("n_derived > 0 AND n_derived + n_declared > 1")
    folds = decided.where("n_declared < 2").select(
        "repo", "directory", F.coalesce("first_declared", "first_derived").alias("survivor"))
    merges = code.where(derived).join(folds, ["repo", "directory"]).where(F.col("id") != F.col("survivor")).select(
        "repo", F.col("id").alias("absorbed"), "survivor")
    refused = decided.where("n_declared >= 2").select("repo", "directory", "n_declared", "n_derived")
    return merges, refused


def contribute(nodes: DataFrame, merges: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Survivors with their gaps filled from what they absorbed; the absorbed
    are tried in id order. ``fields``: name -> expression, NULL meaning a gap."""
    names = list(fields)
    given = nodes.select("repo", "id", *[e.alias(f) for f, e in fields.items()])
    donated = given.join(merges.withColumnRenamed("absorbed", "id"), ["repo", "id"]).groupBy("repo", "survivor").agg(
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("id"))).alias(f"new_{f}") for f in names])
    return given.join(donated.withColumnRenamed("survivor", "id"), ["repo", "id"]).select(
        "repo", "id", *[F.coalesce(F.col(f), F.col(f"new_{f}")).alias(f) for f in names])


def follow_merges(merges: DataFrame) -> DataFrame:
    """Merge map with chains followed to their end; each round doubles the
    length already followed. Merges that run into a circle have no end and are
    left out (``merge_circles`` lists them)."""
    out, open_ = _followed(merges)
    return out.join(open_.select("repo", "absorbed"), ["repo", "absorbed"], "left_anti")


def merge_circles(merges: DataFrame) -> DataFrame:
    """(repo, absorbed) of merges that never reach a component that stays."""
    return _followed(merges)[1].select("repo", "absorbed")


def _followed(merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merge map after as many doublings as its longest possible chain
    needs, and those of its rows whose survivor is absorbed itself."""
    out = durable(merges.select("repo", "absorbed", "survivor"), "merges")
    absorbed = out.select("repo", F.col("absorbed").alias("survivor")).distinct()
    open_ = out.join(absorbed, ["repo", "survivor"], "left_semi")
    for _ in range(out.count().bit_length()):
        if is_empty(open_):
            break
        nxt = out.select("repo", F.col("absorbed").alias("survivor"), F.col("survivor").alias("end"))
        out = durable(out.join(nxt, ["repo", "survivor"], "left").select(
            "repo", "absorbed", F.coalesce("end", "survivor").alias("survivor")), "merges")
        open_ = out.join(absorbed, ["repo", "survivor"], "left_semi")
    return out, open_


def apply_merges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges with absorbed endpoints replaced; what became a self-loop is gone."""
    ends = follow_merges(merges)
    for col in ("src", "dst"):
        to = ends.select("repo", F.col("absorbed").alias(col), F.col("survivor").alias(f"_{col}"))
        edges = edges.join(to, ["repo", col], "left").withColumn(col, F.coalesce(f"_{col}", col)).drop(f"_{col}")
    return edges.where("src <> dst")


def surviving_nodes(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    return nodes.join(merges.select("repo", F.col("absorbed").alias("id")), ["repo", "id"], "left_anti")


# ------------------------------------------------------------ masking, hashing
def redact_graph(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Every stored string masked: (repo, part, key, field, value, masked).

    Lists and maps are covered as well as plain attributes.
    """
    attr = lambda k, v: F.struct(F.lit(k).alias("field"), v.alias("value"))
    node_strings = nodes.select("repo", F.lit("node").alias("part"), F.col("id").alias("key"), F.explode(F.concat(
        F.array(attr("directory", F.col("directory")), attr("buildContext", F.col("build_context"))),
        F.transform("images", lambda i: F.struct(F.lit("image").alias("field"), i.alias("value"))),
        F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"))))).alias("a"))
    parts = (
        node_strings.select("repo", "part", "key", "a.field", "a.value")
        .unionByName(edges.select("repo", F.lit("edge").alias("part"), _edge_id().alias("key"),
                                  F.lit("").alias("field"), F.col("detail").alias("value")))
        .unionByName(diagnostics.select("repo", F.lit("diagnostic").alias("part"), F.col("path").alias("key"),
                                        F.lit("").alias("field"), F.col("message").alias("value"))))
    return parts.where("value IS NOT NULL").withColumn("masked", redact_value(F.col("field"), F.col("value")))


def masked_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("repo", "part").agg(
        F.sum((F.col("masked") != F.col("value")).cast("int")).alias("n_masked"), F.count("*").alias("n"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest per repo, equal exactly when the row multisets are equal.

    Row digests are added up (two 60-bit halves and a count), which is
    associative and commutative: it combines map-side and needs neither a sort
    nor a list of a repository's rows.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy("repo").agg(F.count("*").alias("n"), F.sum(half(1)).alias("s1"), F.sum(half(16)).alias("s2"))
    return sums.select("repo", F.col("n").alias("n_rows"), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(
        "|", F.col("n").cast("string"), F.col("s1").cast("string"), F.col("s2").cast("string")), 256)).alias("content_hash"))


# ----------------------------------------------------------------- validation
def validate_graph(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Every violation of the stored layout: repo, part, key, problem."""

    def problems(df: DataFrame, part: str, key: str, checks: dict[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(p)) for p, c in checks.items()]))
        return df.select("repo", F.lit(part).alias("part"), F.col(key).alias("key"), F.explode(found).alias("problem"))

    path_ok = lambda c: paths.valid_rel_path(F.coalesce(c, F.lit("")))
    kinds, layers = vocab.words(vocab.NODE_KINDS), vocab.words(vocab.LAYERS)
    conf = F.col("conf_pct")
    out = problems(nodes, "node", "id", {
        "bad id": ~ids.is_valid_node_id(F.col("id")), "unknown kind": ~F.col("kind").isin(*kinds),
        "unknown layer": ~F.col("layer").isin(*layers), "empty name": F.col("name") == "",
        "confidence out of range": ~conf.between(0, 100), "bad path": ~path_ok(F.col("path"))})
    e = edges.withColumn("id", _edge_id())
    out = out.unionByName(problems(e, "edge", "id", {
        "bad source id": ~ids.is_valid_node_id(F.col("src")), "bad target id": ~ids.is_valid_node_id(F.col("dst")),
        "unknown kind": ~F.col("kind").isin(*vocab.words(vocab.EDGE_KINDS)),
        "confidence out of range": ~conf.between(0, 100), "empty rule": F.col("rule") == "",
        "bad path": ~path_ok(F.col("path"))}).distinct())
    out = out.unionByName(dangling(e, nodes).select("repo", F.lit("edge").alias("part"), F.col("id").alias("key"),
                                                    F.concat(F.lit("missing "), "side").alias("problem")))
    return out.unionByName(problems(diagnostics, "diagnostic", "path", {
        "unknown severity": ~F.col("severity").isin(*vocab.words(vocab.SEVERITIES)), "empty code": F.col("code") == "",
        "empty message": F.col("message") == "", "bad path": ~path_ok(F.col("path"))}))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge endpoints no component carries: repo, id, side, node_id."""
    ends = edges.select("repo", "id", F.explode(F.array(
        F.struct(F.lit("source").alias("side"), F.col("src").alias("node_id")),
        F.struct(F.lit("target").alias("side"), F.col("dst").alias("node_id")))).alias("e")).select("repo", "id", "e.*").distinct()
    return ends.join(nodes.select("repo", F.col("id").alias("node_id")), ["repo", "node_id"], "left_anti").select(
        "repo", "id", "side", "node_id")


# -------------------------------------------------------- whole readings, whole donors
#: Attributes that a component hands to the one it is folded into.
CONTRIBUTED = ("module package manifest directory dependencyCount goVersion nodeVersion pythonVersion version dockerfile "
               "baseImage buildStages").split()


def merge_attributes(readings: DataFrame) -> DataFrame:
    """(repo, id, attrs): the attribute maps of readings, merged key by key by the rule of ``merge_nodes``."""
    zero = F.char(F.lit(0))
    rows = readings.where(F.size(F.coalesce("attrs", F.create_map().cast("map<string,string>"))) > 0).select(
        "repo", "id", "conf_pct", "seq", F.explode("attrs").alias("key", "value"))
    keyed = rows.withColumn("id", F.concat("id", zero, "key"))
    parts = merge_nodes(keyed, ["value"]).withColumn("part", F.split("id", "\x00"))
    # a component has as many rows here as it has attributes
    return parts.groupBy("repo", F.get("part", F.lit(0)).alias("id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.get("part", F.lit(1)), "value")))).alias("attrs"))


def contribute_all(nodes: DataFrame, merges: DataFrame, attributes: list[str] | None = CONTRIBUTED) -> DataFrame:
    """All nodes, survivors with every gap filled that an absorbed component can fill.

    Donors are tried in id order, per field and per attribute; nothing known is
    overwritten. ``attributes`` names those that travel, and what describes the
    donor's own file (labels, images, build directory) stays behind. With None
    everything fills gaps, and technologies only where the survivor has none.
    """
    donors = nodes.join(merges.select("repo", F.col("absorbed").alias("id"), "survivor"), ["repo", "id"])
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    fields = {"language": blank("tech.language"), "framework": blank("tech.framework"), "runtime": blank("tech.runtime"),
              "directory": blank("directory"), "ports": F.when(F.size("ports") > 0, F.col("ports"))}
    if attributes is None:
        fields |= {"build_context": blank("build_context"), "images": F.when(F.size("images") > 0, F.col("images")),
                   "labels": F.when(F.size("labels") > 0, F.col("labels"))}
    plain = donors.groupBy("repo", F.col("survivor").alias("id")).agg(
        *[F.min_by(e, F.when(e.isNotNull(), F.col("id"))).alias(f"_{f}") for f, e in fields.items()])
    given = donors.select("repo", "survivor", F.col("id").alias("donor"), F.explode("attrs").alias("key", "value"))
    if attributes is not None:
        given = given.where(F.col("key").isin(*attributes))
    handed = given.groupBy("repo", F.col("survivor").alias("id"), "key").agg(F.min_by("value", "donor").alias("value")).groupBy(
        "repo", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_attrs"))
    out = nodes.join(plain, ["repo", "id"], "left").join(handed, ["repo", "id"], "left")
    own = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    more = F.map_filter(F.coalesce("_attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    parts = ("language", "framework", "runtime")
    tech = F.struct(*[F.coalesce(blank(f"tech.{f}"), F.col(f"_{f}"), F.lit("")).alias(f) for f in parts])
    if attributes is None:
        tech = F.when(F.concat(*[F.coalesce(f"tech.{f}", F.lit("")) for f in parts]) == "", tech).otherwise(F.col("tech"))
    filled = {"tech": tech, "attrs": F.map_concat(own, more)}
    for f in fields:
        if f not in parts:
            filled[f] = F.coalesce(fields[f], F.col(f"_{f}"), F.col(f))
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in nodes.columns])


def rekeyed(rows: DataFrame, merges: DataFrame, column: str = "id") -> DataFrame:
    """Rows under the component that survives: sources and references move with what was absorbed."""
    to = merges.select("repo", F.col("absorbed").alias(column), F.col("survivor").alias("_to"))
    return rows.join(to, ["repo", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(rows.columns)


def fold_generic_rows(rows: DataFrame) -> DataFrame:
    """Evidence rows of edges, those of a generic depends_on moved to the pair's specific relationship, if there is one."""
    specific = rows.where(~F.col("kind").isin("depends_on", "contains")).groupBy("repo", "src", "dst").agg(
        F.max(F.struct("kind", F.coalesce("protocol", F.lit("")).alias("protocol"))).alias("_s"))
    moves = (F.col("kind") == "depends_on") & F.col("_s").isNotNull()
    out = rows.join(specific, ["repo", "src", "dst"], "left").withColumns({
        "protocol": F.when(moves, F.col("_s.protocol")).otherwise(F.coalesce("protocol", F.lit(""))),
        "kind": F.when(moves, F.col("_s.kind")).otherwise(F.col("kind"))})
    return out.select(rows.columns)
