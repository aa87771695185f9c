"""Component, symbol and edge identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions.text import strip

_NODE_ID = r"^(context|container|component):(?:@([^/]*)/)?(.*)$"


def normalize_name(c: Column) -> Column:
    return F.translate(F.lower(c), "-_. ", "")


def layer_of(kind: Column) -> Column:
    return F.when(kind.isin("boundary", "external"), F.lit("context")).otherwise("container")


def slug_segment(c: Column) -> Column:
    folded = F.btrim(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9._]+", "-"), F.lit("-."))
    return F.when(folded == "", F.lit("unknown")).otherwise(folded)


def slug_path(c: Column) -> Column:
    folded = F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9._/]+", "-")
    kept = F.filter(F.transform(F.split(folded, "/"), lambda p: F.btrim(p, F.lit("-."))), lambda p: p != "")
    joined = F.array_join(kept, "/")
    return F.when(joined == "", F.lit("unknown")).otherwise(joined)


def _discriminated(slug: Column, original: Column, lost: Column) -> Column:
    mark = F.concat(F.lit("."), F.substring(F.sha2(original, 256), 1, 8))
    return F.when((original != "") & lost, F.concat(slug, mark)).otherwise(slug)


def name_slug(name: Column) -> Column:
    """Folded name; a letter or digit the fold cannot show adds a digest."""
    text = strip(name)
    return _discriminated(slug_path(name), text, text.rlike(r"[\p{L}\p{Nd}&&[^\x00-\x7F]]"))


def node_id(kind: Column, scope: Column, name: Column) -> Column:
    scoped = F.when(F.coalesce(strip(scope), F.lit("")) != "",
                    F.concat(F.lit("@"), slug_segment(scope), F.lit("/"))).otherwise("")
    return F.concat(layer_of(kind), F.lit(":"), scoped, name_slug(name))


def symbol_id(kind: Column, scope: Column, file: Column, symbol: Column) -> Column:
    f, s = strip(file), strip(symbol)
    name = F.when(s == "", f).when(f == "", s).otherwise(F.concat(f, F.lit("/"), s))
    slug = slug_path(name)
    return node_id(kind, scope, _discriminated(slug, strip(name), strip(name) != slug))


def parse_node_id(id_: Column) -> Column:
    """struct(layer, scope, name), NULL when malformed; scope is '' if absent."""
    scope, name = F.regexp_extract(id_, _NODE_ID, 2), F.regexp_extract(id_, _NODE_ID, 3)
    marked = id_.rlike(r"^[a-z]+:@")
    ok = (id_.rlike(_NODE_ID) & (name != "")
          & ~(marked & (~id_.rlike(r"^[a-z]+:@[^/]+/"))))
    return F.when(ok, F.struct(
        F.regexp_extract(id_, _NODE_ID, 1).alias("layer"), scope.alias("scope"), name.alias("name")))


def is_valid_node_id(id_: Column) -> Column:
    p = parse_node_id(id_)
    scoped = F.when(p["scope"] != "", F.concat(F.lit("@"), slug_segment(p["scope"]), F.lit("/"))).otherwise("")
    rebuilt = F.concat(p["layer"], F.lit(":"), scoped, name_slug(p["name"]))
    return F.coalesce(rebuilt == id_, F.lit(False))


def qualify_project(id_: Column, label: Column) -> Column:
    """Prefix the scope with a project label; malformed ids stay as they are."""
    pattern = r"^([^:]+):(?:@([^/]+)/)?(.+)$"
    scope = F.regexp_extract(id_, pattern, 2)
    joined = F.when(scope == "", label).otherwise(F.concat(label, F.lit("-"), scope))
    ok = id_.rlike(pattern) & ~(id_.rlike("^[^:]+:@") & ~id_.rlike("^[^:]+:@[^/]+/."))
    return F.when(ok & (label != ""), F.concat(
        F.regexp_extract(id_, pattern, 1), F.lit(":@"), slug_segment(joined), F.lit("/"),
        F.regexp_extract(id_, pattern, 3))).otherwise(id_)


def edge_id(src: Column, dst: Column, kind: Column, protocol: Column) -> Column:
    zero = F.char(F.lit(0))
    joined = F.concat(src, zero, dst, zero, kind, zero, F.coalesce(protocol, F.lit("")))
    return F.concat(F.lit("e:"), F.substring(F.sha2(joined, 256), 1, 12))


def base_confidence(hint_kind: Column) -> Column:
    weak = 40
    out = F.lit(weak)
    for kind, pct in vocab.rows(vocab.BASE_CONFIDENCE):
        if int(pct) != weak:
            out = F.when(hint_kind == kind, F.lit(int(pct))).otherwise(out)
    return out


def kind_for_edge(edge: Column) -> Column:
    return (F.when(edge == "persists_to", F.lit("datastore"))
            .when(edge.isin("publishes_to", "subscribes_to"), F.lit("queue")))


def edge_kind_for(suggested: Column, target_kind: Column) -> Column:
    given = F.coalesce(suggested, F.lit(""))
    return (F.when(~given.isin("", "calls", "depends_on"), given)
            .when(target_kind == "datastore", F.lit("persists_to"))
            .when(target_kind == "queue", F.lit("publishes_to"))
            .when(given != "", given).otherwise("depends_on"))


def tech_string(language: Column, framework: Column, runtime: Column) -> Column:
    return F.array_join(F.filter(F.array(language, framework, runtime), lambda t: t != ""), "/")


def display_name(name: Column, namespace: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) != "", F.concat_ws(".", name, namespace)).otherwise(name)
