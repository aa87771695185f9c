"""Registered queries: merging, aggregation, windows, graph analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.operators import graph as g
from archgraph.operators import merge as mg
from archgraph.operators import queries as q
from archgraph.operators import ranking as rk
from archgraph.operators import diagnostics as dg
from archgraph.plans import duck as D
from archgraph.plans.registry import query
from archgraph.plans.resolution import P, decisions, typed

M = dict(P)
M["dk_edges"] = """SELECT repo, src, dst, kind, coalesce(protocol, '') AS protocol, max(conf_pct) AS conf_pct,
    """ + D.edge_id("src", "dst", "kind", "coalesce(protocol, '')") + """ AS id FROM {fx_edges} GROUP BY ALL"""
M["dk_rel"] = "SELECT * FROM {dk_edges} WHERE kind <> 'contains'"


def merged(t):
    return t.table("edges", lambda: mg.merge_edges(t.fx_edges))


_FIELDS = ["image", "version", "namespace"]


@query("merge_nodes", """
    WITH r AS (SELECT *, conf_pct > coalesce(max(conf_pct) OVER (PARTITION BY repo, id ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS rec FROM {fx_readings})
    SELECT repo, id, max(conf_pct) AS conf_pct, """ + ", ".join(
        f"coalesce(arg_max({f}, seq) FILTER (rec AND {f} IS NOT NULL), arg_min({f}, seq) FILTER ({f} IS NOT NULL)) AS {f}"
        for f in _FIELDS) + " FROM r GROUP BY ALL")
def merge_nodes(t):
    return mg.merge_nodes(t.fx_readings, _FIELDS)


@query("merge_kind", """
    SELECT repo, id, coalesce(CASE WHEN bool_or(image IS NOT NULL)
             THEN arg_min(kind, seq) FILTER (image IS NOT NULL AND kind <> 'service')
             ELSE arg_min(kind, seq) FILTER (kind <> 'service') END, 'service') AS kind FROM {fx_readings} GROUP BY ALL""")
def merge_kind(t):
    return mg.merge_kind(t.fx_readings)


@query("merge_name", """
    SELECT repo, id, coalesce(arg_min(name, seq) FILTER (name_from IS NULL), arg_min(name, seq)) AS name,
           arg_min(namespace, seq) FILTER (namespace IS NOT NULL) AS namespace FROM {fx_readings} GROUP BY ALL""")
def merge_name(t):
    return mg.merge_name(t.fx_readings)


@query("kind_conflicts", """
    WITH w AS (SELECT *, image IS NOT NULL AS im,
        coalesce(bool_or(image IS NOT NULL) OVER p, false) AS seen,
        first_value(CASE WHEN image IS NOT NULL AND kind <> 'service' THEN kind END IGNORE NULLS) OVER p AS k3,
        first_value(CASE WHEN image IS NOT NULL THEN kind END IGNORE NULLS) OVER p AS k2,
        first_value(CASE WHEN kind <> 'service' THEN kind END IGNORE NULLS) OVER p AS k1,
        first_value(kind) OVER p AS k0
      FROM {fx_readings} WINDOW p AS (PARTITION BY repo, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, CASE WHEN seen THEN coalesce(k3, k2) ELSE coalesce(k1, k0) END AS was FROM w)
    SELECT repo, id, seq, path, was, kind AS also, CASE WHEN (CASE WHEN im <> seen THEN im ELSE was = 'service' AND kind <> 'service' END)
           THEN kind ELSE was END AS kept FROM x WHERE was IS NOT NULL AND was <> kind""")
def kind_conflicts(t):
    return mg.kind_conflicts(t.fx_readings)


@query("merge_edges", "SELECT id, repo, src, dst, kind, protocol, conf_pct FROM {dk_edges}", M)
def merge_edges(t):
    return mg.merge_edges(t.fx_edges)


@query("dedupe_evidence", f"""
    SELECT DISTINCT repo, {D.edge_id('src', 'dst', 'kind', 'protocol')} AS edge_id, rule, path, line, detail, extractor FROM {{fx_edges}}""")
def dedupe_evidence(t):
    return mg.edge_evidence(t.fx_edges)


@query("dedupe_sources", "SELECT DISTINCT repo, id, path, line, 'reader' AS extractor FROM {fx_readings}")
def dedupe_sources(t):
    return t.fx_readings.select("repo", "id", "path", "line", F.lit("reader").alias("extractor")).distinct()


@query("top_evidence_per_edge", """
    SELECT repo, edge_id, rule, path, line, detail FROM (
      SELECT repo, """ + D.edge_id("src", "dst", "kind", "protocol") + """ AS edge_id, rule, path, line, detail,
             row_number() OVER (PARTITION BY repo, src, dst, kind, protocol ORDER BY rule, path, line, detail, extractor) AS rn
      FROM {fx_edges}) WHERE rn = 1""")
def top_evidence_per_edge(t):
    return mg.top_evidence(t.fx_edges).drop("extractor")


M["dk_folds"] = """
    WITH code AS (SELECT * FROM {fx_nodes} WHERE directory IS NOT NULL AND image IS NULL),
    d AS (SELECT repo, directory, count(*) FILTER (name_from IS NOT NULL) AS n_derived, count(*) FILTER (name_from IS NULL) AS n_declared,
                 min(id) FILTER (name_from IS NOT NULL) AS fd, min(id) FILTER (name_from IS NULL) AS fc FROM code GROUP BY ALL)
    SELECT c.repo, c.id AS absorbed, coalesce(d.fc, d.fd) AS survivor FROM code c JOIN d USING (repo, directory)
    WHERE c.name_from IS NOT NULL AND n_declared < 2 AND n_derived + n_declared > 1 AND c.id <> coalesce(d.fc, d.fd)"""


@query("fold_directory_duplicates", """
    SELECT repo, absorbed, survivor, '' AS refused FROM {dk_folds}
    UNION ALL SELECT repo, '', '', directory FROM {fx_nodes} WHERE directory IS NOT NULL AND image IS NULL
    GROUP BY repo, directory HAVING count(*) FILTER (name_from IS NOT NULL) > 0 AND count(*) FILTER (name_from IS NULL) > 1""", M)
def fold_directory_duplicates(t):
    merges, refused = mg.fold_directory_duplicates(typed(t))
    return merges.withColumn("refused", F.lit("")).unionByName(refused.select(
        "repo", F.lit("").alias("absorbed"), F.lit("").alias("survivor"), F.col("directory").alias("refused")))


@query("contributed_attributes", """
    SELECT f.repo, s.id, coalesce(s.language, arg_min(a.language, a.id) FILTER (a.language IS NOT NULL)) AS language,
           coalesce(s.framework, arg_min(a.framework, a.id) FILTER (a.framework IS NOT NULL)) AS framework
    FROM {dk_folds} f JOIN {fx_nodes} a ON a.repo = f.repo AND a.id = f.absorbed JOIN {fx_nodes} s ON s.repo = f.repo AND s.id = f.survivor
    GROUP BY f.repo, s.id, s.language, s.framework""", M)
def contributed_attributes(t):
    nodes = typed(t)
    merges, _ = mg.fold_directory_duplicates(nodes)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return mg.contribute(nodes, merges, {"language": blank("tech.language"), "framework": blank("tech.framework")})


@query("collapse_generic_edges", """
    WITH s AS (SELECT repo, src, dst, arg_max(id, (kind, protocol, id)) AS sid FROM {dk_edges}
               WHERE kind NOT IN ('depends_on', 'contains') GROUP BY ALL),
    m AS (SELECT e.*, CASE WHEN kind = 'depends_on' THEN coalesce(sid, id) ELSE id END AS target FROM {dk_edges} e LEFT JOIN s USING (repo, src, dst))
    SELECT repo, target AS id, arg_min(src, id <> target) AS src, arg_min(dst, id <> target) AS dst, arg_min(kind, id <> target) AS kind,
           max(conf_pct) AS conf_pct, count(*) FILTER (id <> target) AS n_folded FROM m GROUP BY ALL""", M)
def collapse_generic_edges(t):
    return mg.collapsed(merged(t)).select("repo", "id", "src", "dst", "kind", "conf_pct", "n_folded")


@query("collapsed_evidence", f"""
    WITH s AS (SELECT repo, src, dst, arg_max(id, (kind, protocol, id)) AS sid FROM {{dk_edges}} WHERE kind NOT IN ('depends_on', 'contains') GROUP BY ALL),
    m AS (SELECT e.repo, e.id, CASE WHEN kind = 'depends_on' THEN coalesce(sid, id) ELSE id END AS target FROM {{dk_edges}} e LEFT JOIN s USING (repo, src, dst)),
    v AS (SELECT *, {D.edge_id('src', 'dst', 'kind', 'protocol')} AS edge_id FROM {{fx_edges}})
    SELECT DISTINCT v.repo, m.target AS edge_id, v.rule, v.path, v.line, v.detail, v.extractor FROM v JOIN m ON m.repo = v.repo AND m.id = v.edge_id""", M)
def collapsed_evidence(t):
    return mg.collapsed_evidence(mg.edge_evidence(t.fx_edges), merged(t))


@query("aggregate_diagnostics", """
    WITH a AS (SELECT repo, code, path, min(severity) AS severity, count(*) AS n, list_sort(list_distinct(list(message))) AS ds FROM {fx_diagnostics}
               WHERE code IN (""" + ", ".join(f"'{c}'" for c in dg.AGGREGATED) + """) GROUP BY ALL)
    SELECT repo, severity, code, path, 0 AS line, n, len(ds) AS n_details, array_to_string(ds[1:8], ', ')
           || CASE WHEN len(ds) > 8 THEN ' and ' || (len(ds) - 8) || ' more' ELSE '' END AS message FROM a
    UNION ALL SELECT repo, severity, code, path, line, 1, 1, message FROM {fx_diagnostics} WHERE code NOT IN (""" + ", ".join(f"'{c}'" for c in dg.AGGREGATED) + ")")
def aggregate_diagnostics(t):
    return dg.aggregate_diagnostics(t.fx_diagnostics)


@query("list_diagnostics", """
    SELECT repo, severity, code, path, line, message FROM {fx_diagnostics} WHERE severity = 'warn' AND code = 'purchase'""")
def list_diagnostics(t):
    return dg.list_diagnostics(t.fx_diagnostics, severity="WARN", code="purchase")


@query("diagnostic_details", """
    SELECT DISTINCT repo, code, path, message FROM {fx_diagnostics}
    WHERE message <> '' AND code IN (""" + ", ".join(f"'{c}'" for c in dg.AGGREGATED) + ")")
def diagnostic_details(t):
    return dg.folded_details(t.fx_diagnostics)


@query("code_breakdown", """
    WITH c AS (SELECT repo, code, count(*) AS n FROM {fx_diagnostics} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, code) AS rn, count(*) OVER (PARTITION BY repo) AS k,
                 max(n) OVER (PARTITION BY repo) AS mx FROM c)
    SELECT repo, CASE WHEN rn <= 12 THEN code ELSE 'other' END AS code, sum(n)::BIGINT AS n, min(rn)::INTEGER AS position
    FROM r WHERE k >= 2 AND mx > 1 GROUP BY repo, CASE WHEN rn <= 12 THEN code ELSE 'other' END""")
def code_breakdown(t):
    return dg.code_breakdown(t.fx_diagnostics)


@query("counts_by_kind", """
    SELECT repo, 'kind' AS what, kind AS value, count(*) AS n FROM {fx_nodes} GROUP BY ALL
    UNION ALL SELECT repo, 'layer', layer, count(*) FROM {fx_nodes} GROUP BY ALL
    UNION ALL SELECT repo, 'edge_kind', kind, count(*) FROM {dk_edges} GROUP BY ALL
    UNION ALL SELECT repo, 'severity', severity, count(*) FROM {fx_diagnostics} GROUP BY ALL
    UNION ALL SELECT repo, 'rule', rule, count(DISTINCT (src, dst, kind, coalesce(protocol, ''))) FROM {fx_edges} GROUP BY ALL""", M)
def counts_by_kind(t):
    return q.counts(typed(t), merged(t), t.fx_edges, t.fx_diagnostics)


@query("project_counts", """
    SELECT repo, project, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, project)::INTEGER AS position
    FROM {fx_nodes} WHERE kind <> 'boundary' GROUP BY repo, project""")
def project_counts(t):
    return q.project_counts(typed(t))


@query("duplicated_names", """
    SELECT repo, name, count(*) AS n FROM {fx_nodes} GROUP BY ALL HAVING count(*) > 1""")
def duplicated_names(t):
    return q.duplicated_names(typed(t))


@query("redundant_nodes", """
    SELECT repo, sum(n - 1)::BIGINT AS redundant FROM (SELECT repo, name, count(*) AS n FROM {fx_nodes} GROUP BY ALL) GROUP BY repo""")
def redundant_nodes(t):
    return q.redundant_nodes(typed(t))


@query("redact_graph", f"""
    WITH parts AS (
      SELECT repo, 'node' AS part, unnest(['directory', 'buildContext', 'image']) AS field, unnest([directory, build_context, image]) AS value FROM {{fx_nodes}}
      UNION ALL SELECT repo, 'node', string_split(kv, '=')[1], string_split(kv, '=')[2] FROM (SELECT repo, unnest(string_split(labels, ';')) AS kv FROM {{fx_nodes}})
      UNION ALL SELECT repo, 'edge', '', detail FROM {{fx_edges}} UNION ALL SELECT repo, 'diagnostic', '', message FROM {{fx_diagnostics}})
    SELECT repo, part, count(*) FILTER (({D.redact_value('field', 'value')}) <> value) AS n_masked, count(*) AS n FROM parts WHERE value IS NOT NULL GROUP BY ALL""")
def redact_graph(t):
    return mg.masked_counts(mg.redact_graph(typed(t), t.fx_edges, t.fx_diagnostics))


@query("content_hash", """
    WITH d AS (SELECT repo, sha256('{"src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '","protocol":"' || protocol
                 || '","conf_pct":' || conf_pct || '}') AS h FROM {dk_edges})
    SELECT repo, count(*) AS n_rows, 'sha256:' || sha256(count(*) || '|' || sum(('0x' || h[1:15])::BIGINT) || '|' || sum(('0x' || h[16:30])::BIGINT)) AS content_hash
    FROM d GROUP BY repo""", M)
def content_hash(t):
    return mg.content_hash(merged(t), ["src", "dst", "kind", "protocol", "conf_pct"])


_BROKEN = {
    "nodes": """SELECT repo, CASE WHEN conf_pct = 80 THEN upper(id) ELSE id END AS id, CASE WHEN kind = 'queue' THEN 'broker' ELSE kind END AS kind,
                CASE WHEN kind = 'external' THEN 'outer' ELSE layer END AS layer, CASE WHEN kind = 'boundary' THEN '' ELSE name END AS name,
                CASE WHEN line = 3 THEN '/abs/' || path ELSE path END AS path, CASE WHEN line = 7 THEN 101 ELSE conf_pct END AS conf_pct FROM {fx_nodes}""",
    "edges": """SELECT repo, src, CASE WHEN line = 5 THEN dst || '-gone' ELSE dst END AS dst, kind, protocol, conf_pct,
                CASE WHEN rule = 'declared' THEN '' ELSE rule END AS rule, CASE WHEN line = 2 THEN '../' || path ELSE path END AS path FROM {fx_edges}""",
    "diagnostics": """SELECT repo, CASE WHEN line = 4 THEN 'fatal' ELSE severity END AS severity, code, path, CASE WHEN line = 9 THEN '' ELSE message END AS message FROM {fx_diagnostics}""",
}
M["dk_bn"], M["dk_be0"], M["dk_bd"] = _BROKEN["nodes"], _BROKEN["edges"], _BROKEN["diagnostics"]
M["dk_be"] = f"SELECT *, {D.edge_id('src', 'dst', 'kind', 'protocol')} AS id FROM {{dk_be0}}"


def _rel_bad(c):
    return f"({c} <> '' AND (starts_with({c}, '/') OR list_contains(string_split({c}, '/'), '..')))"


@query("validate_graph", f"""
    SELECT repo, 'node' AS part, id AS key, unnest(list_filter([CASE WHEN conf_pct = 80 AND id = upper(id) THEN 'bad id' WHEN id <> lower(id) THEN 'bad id' END,
        CASE WHEN kind = 'broker' THEN 'unknown kind' END, CASE WHEN layer = 'outer' THEN 'unknown layer' END, CASE WHEN name = '' THEN 'empty name' END,
        CASE WHEN conf_pct > 100 THEN 'confidence out of range' END, CASE WHEN {_rel_bad('path')} THEN 'bad path' END], lambda x: x IS NOT NULL)) AS problem FROM {{dk_bn}}
    UNION ALL SELECT DISTINCT repo, 'edge', id, unnest(list_filter([CASE WHEN rule = '' THEN 'empty rule' END, CASE WHEN {_rel_bad('path')} THEN 'bad path' END], lambda x: x IS NOT NULL)) FROM {{dk_be}}
    UNION ALL SELECT DISTINCT e.repo, 'edge', e.id, 'missing source' FROM {{dk_be}} e WHERE NOT EXISTS (SELECT 1 FROM {{dk_bn}} n WHERE n.repo = e.repo AND n.id = e.src)
    UNION ALL SELECT DISTINCT e.repo, 'edge', e.id, 'missing target' FROM {{dk_be}} e WHERE NOT EXISTS (SELECT 1 FROM {{dk_bn}} n WHERE n.repo = e.repo AND n.id = e.dst)
    UNION ALL SELECT repo, 'diagnostic', path, unnest(list_filter([CASE WHEN severity = 'fatal' THEN 'unknown severity' END, CASE WHEN message = '' THEN 'empty message' END], lambda x: x IS NOT NULL)) FROM {{dk_bd}}""", M)
def validate_graph(t):
    nodes, edges, diags = (t.fx_nodes, t.fx_edges, t.fx_diagnostics)
    import re

    def broken(df, sql):
        return df.selectExpr(*_columns(sql))

    return mg.validate_graph(broken(nodes, _BROKEN["nodes"]), broken(edges, _BROKEN["edges"]), broken(diags, _BROKEN["diagnostics"]))


def _columns(sql):
    """Select list of one of the texts above (no nested commas occur)."""
    body = sql[sql.index("SELECT") + 6:sql.rindex("FROM")]
    return [c.strip() for c in body.replace("\n", " ").split(",")]


@query("dangling_check", f"""
    SELECT DISTINCT repo, id, side, node_id FROM (SELECT repo, id, unnest(['source', 'target']) AS side, unnest([src, dst]) AS node_id FROM {{dk_be}}) e
    WHERE NOT EXISTS (SELECT 1 FROM {{fx_nodes}} n WHERE n.repo = e.repo AND n.id = e.node_id)""", M)
def dangling_check(t):
    e = t.fx_edges.selectExpr(*_columns(_BROKEN["edges"]))
    return mg.dangling(e.withColumn("id", mg._edge_id()), t.fx_nodes)


# ------------------------------------------------------------------- windows
@query("canonical_order", """
    SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY src, dst, kind, protocol, id) AS position FROM {dk_edges}""", M)
def canonical_order(t):
    return rk.running(merged(t).select("repo", "src", "dst", "kind", "protocol", "id"), ["repo"],
                      [F.col(c) for c in ("src", "dst", "kind", "protocol", "id")]).select("repo", "id", "position")


@query("canonical_order_of_all", """
    SELECT repo, 'node' AS part, id AS key, row_number() OVER (PARTITION BY repo ORDER BY id) AS position FROM {fx_nodes}
    UNION ALL SELECT repo, 'diagnostic', path || '|' || line || '|' || code || '|' || severity || '|' || message,
      row_number() OVER (PARTITION BY repo ORDER BY path, line, code, severity, message) FROM {fx_diagnostics}""", M)
def canonical_order_of_all(t):
    nodes = rk.canonical_order(typed(t).select("repo", "id"), "nodes").select("repo", F.lit("node").alias("part"), F.col("id").alias("key"), "position")
    diags = rk.canonical_order(t.fx_diagnostics, "diagnostics")
    return nodes.unionByName(diags.select("repo", F.lit("diagnostic").alias("part"), F.concat_ws("|", "path", "line", "code", "severity", "message").alias("key"), "position"))


M["dk_degree"] = """
    SELECT n.repo, n.id, n.kind, (SELECT count(*) FROM {dk_rel} e WHERE e.repo = n.repo AND e.src = n.id)::INTEGER AS n_out,
           (SELECT count(*) FROM {dk_rel} e WHERE e.repo = n.repo AND e.dst = n.id)::INTEGER AS n_in FROM {fx_nodes} n"""


@query("degree", "SELECT * FROM {dk_degree}", M)
def degree(t):
    return g.degree(typed(t), merged(t))


@query("most_connected", """
    SELECT repo, id, n_in, n_out, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_in + n_out DESC, id) AS rank
      FROM {dk_degree} WHERE kind <> 'boundary' AND n_in + n_out > 0) WHERE rank <= 8""", M)
def most_connected(t):
    return q.most_connected(g.degree(typed(t), merged(t)))


@query("page", """
    WITH r AS (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY id) AS position, count(*) OVER (PARTITION BY repo) AS n FROM {fx_nodes})
    SELECT repo, id, position FROM r WHERE position > CASE WHEN 100 >= n THEN 0 ELSE 100 END AND position <= CASE WHEN 100 >= n THEN 0 ELSE 100 END + 25""")
def page(t):
    return rk.page(typed(t).select("repo", "id"), ["repo"], [F.col("id")], cursor=100, size=25)


@query("budget_prefix", """
    WITH c AS (SELECT role, conv_id, turn, (strlen(text) + 3) // 4 AS cost, sum((strlen(text) + 3) // 4) OVER (PARTITION BY role ORDER BY conv_id, turn) AS spent,
                      count(*) OVER (PARTITION BY role) AS total FROM conversations)
    SELECT role, conv_id, turn, cost::INTEGER AS cost, spent::BIGINT AS spent, total FROM c WHERE spent + 5 <= 2000""")
def budget_prefix(t):
    return rk.budget_prefix(t.conversations, ["role"], [F.col("conv_id"), F.col("turn")], "text", 2000, 5).select(
        "role", "conv_id", "turn", "cost", "spent", "total")


@query("rank_edges_of_node", """
    SELECT repo, src, dst, id, conf_pct, row_number() OVER (PARTITION BY repo, src ORDER BY conf_pct DESC, dst, kind, protocol) AS position FROM {dk_rel}""", M)
def rank_edges_of_node(t):
    e = g.relationships(merged(t)).select("repo", "src", "dst", "id", "kind", "protocol", "conf_pct")
    return rk.running(e, ["repo", "src"], [F.desc("conf_pct"), F.col("dst"), F.col("kind"), F.col("protocol")]).drop("kind", "protocol")


# ----------------------------------------------------------------- read queries
@query("list_nodes", """
    SELECT repo, id, name FROM {fx_nodes} WHERE lower(kind) = 'datastore' AND layer = 'container' AND namespace = 'ns-1'
      AND (contains(lower(name), 'redis') OR contains(lower(id), 'redis') OR contains(lower(concat_ws('/', language, framework)), 'redis'))""")
def list_nodes(t):
    return q.list_nodes(typed(t), kind="Datastore", layer="container", namespace="NS-1", text="Redis").select("repo", "id", "name")


@query("relationships", "SELECT id, repo, kind FROM {dk_rel}", M)
def relationships(t):
    # merged here: of the whole edge table, only what this list shows is shuffled, and none of it is written
    return g.relationships(mg.merge_edges(t.fx_edges)).select("id", "repo", "kind")


@query("connected_count", """
    SELECT repo, count(*) AS connected FROM {fx_nodes} n WHERE kind <> 'boundary' AND EXISTS
      (SELECT 1 FROM {dk_rel} e WHERE e.repo = n.repo AND (e.src = n.id OR e.dst = n.id)) GROUP BY repo""", M)
def connected_count(t):
    return g.connected_nodes(typed(t), merged(t)).groupBy("repo").agg(F.count("*").alias("connected"))


M["dk_und"] = "SELECT repo, src AS a, dst AS b FROM {dk_edges} UNION SELECT repo, dst, src FROM {dk_edges}"
M["dk_walk"] = """
    SELECT repo, id, id AS seen FROM {fx_nodes}
    UNION SELECT w.repo, w.id, u.b FROM dk_walk w JOIN {dk_und} u ON u.repo = w.repo AND u.a = w.seen"""
M["dk_clusters"] = "SELECT repo, id, min(seen) AS cluster FROM {dk_walk} GROUP BY ALL"


def labels(t):
    return t.table("clusters", lambda: g.clusters(typed(t), merged(t)))


@query("clusters", "SELECT repo, id, cluster FROM {dk_clusters}", M)
def clusters(t):
    return g.clusters(typed(t), merged(t))


M["dk_stats"] = """
    SELECT n.repo, n_nodes, n.components, n_edges, connected, k.clusters, connected / n.components AS cohesion FROM
      (SELECT repo, count(*) AS n_nodes, count(*) FILTER (kind <> 'boundary') AS components FROM {fx_nodes} GROUP BY ALL) n
      JOIN (SELECT repo, count(*) AS n_edges FROM {dk_edges} GROUP BY ALL) e USING (repo)
      JOIN (SELECT repo, count(*) AS connected FROM {dk_degree} WHERE kind <> 'boundary' AND n_in + n_out > 0 GROUP BY ALL) c USING (repo)
      JOIN (SELECT repo, count(DISTINCT cluster) AS clusters FROM {dk_clusters} GROUP BY ALL) k USING (repo)"""


@query("cohesion", """
    SELECT repo, n_nodes, components, n_edges, connected, clusters, cohesion,
           CASE WHEN components >= 8 AND cohesion < 0.25 AND clusters > components // 4 THEN 'inventory' WHEN cohesion < 0.5 THEN 'sparse' ELSE 'connected' END AS shape
    FROM {dk_stats}""", M)
def cohesion(t):
    return g.graph_stats(typed(t), merged(t), labels(t))


def _levels(start_sql: str, near: str, far: str, tag: str, rel: str = "dk_rel") -> None:
    """Unrolled breadth-first search: one piece per depth."""
    M[f"dk_{tag}0"] = start_sql
    for d in range(1, g.MAX_DEPTH + 1):
        settled = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {{dk_{tag}{k}}} s WHERE s.repo = e.repo AND s.start = f.start AND s.id = e.{far})" for k in range(0, d))
        M[f"dk_{tag}{d}"] = f"""
            SELECT repo, start, id, {d} AS depth, via, kind, w AS weakest_pct FROM (
              SELECT f.repo, f.start, e.{far} AS id, f.id AS via, e.kind, e.protocol, least(f.weakest_pct, e.conf_pct) AS w,
                     row_number() OVER (PARTITION BY f.repo, f.start, e.{far} ORDER BY least(f.weakest_pct, e.conf_pct) DESC, f.id, e.kind, e.protocol) AS rn
              FROM {{dk_{tag}{d - 1}}} f JOIN {{{rel}}} e ON e.repo = f.repo AND e.{near} = f.id
              WHERE e.{far} <> f.start {settled}) WHERE rn = 1"""
    M[f"dk_{tag}"] = " UNION ALL ".join(f"SELECT * FROM {{dk_{tag}{d}}}" for d in range(1, g.MAX_DEPTH + 1))


_START = "SELECT repo, id AS start, id, 0 AS depth, '' AS via, '' AS kind, 100 AS weakest_pct FROM {fx_nodes} WHERE kind = "
_levels(_START + "'queue'", "dst", "src", "up")
_levels(_START + "'boundary'", "src", "dst", "none")
_levels("SELECT repo, src AS start, src AS id, 0 AS depth, '' AS via, '' AS kind, 100 AS weakest_pct FROM {dk_rel} WHERE kind = 'publishes_to' GROUP BY ALL", "src", "dst", "down")


def queues(t):
    return typed(t).where("kind = 'queue'").select("repo", F.col("id").alias("start"))


@query("impact_of", "SELECT * FROM {dk_up}", M)
def impact_of(t):
    return g.impact_of(t.fx_edges, queues(t))


@query("impact_of_dependencies", "SELECT * FROM {dk_down}", M)
def impact_of_dependencies(t):
    publishers = t.fx_edges.where("kind = 'publishes_to'").select("repo", F.col("src").alias("start")).distinct()
    return g.impact_of(t.fx_edges, publishers, dependents=False)


@query("impact_summary", """
    WITH c AS (SELECT repo, count(*) AS components FROM {fx_nodes} WHERE kind <> 'boundary' GROUP BY ALL)
    SELECT s.repo, s.start, count(r.id) AS affected, min(r.weakest_pct) AS weakest_pct, max(r.depth) AS max_depth, components,
           round(count(r.id) / components, 4) AS share, CASE WHEN count(r.id) = 0 THEN 'nothing reached' ELSE '' END AS note, """
       + ", ".join(f"count(*) FILTER (r.depth = {d}) AS depth_{d}" for d in range(1, g.MAX_DEPTH + 1))
       + """ FROM {dk_up0} s JOIN c ON c.repo = s.repo LEFT JOIN {dk_up} r ON r.repo = s.repo AND r.start = s.start
           GROUP BY s.repo, s.start, components""", M)
def impact_summary(t):
    return g.impact_summary(g.impact_of(t.fx_edges, queues(t)), typed(t), queues(t))


M["dk_pairs"] = """
    SELECT DISTINCT x.repo, a.id AS start, b.id AS goal FROM {fx_expected} x JOIN {fx_nodes} a ON a.repo = x.repo AND a.name = x.src_name
    JOIN {fx_nodes} b ON b.repo = x.repo AND b.name = x.dst_name WHERE x.mode = 'expected'"""
M["dk_paths"] = """
    SELECT repo, start, goal, start AS cur, [start] AS nodes, []::VARCHAR[] AS legs, 100 AS w FROM {dk_pairs}
    UNION ALL SELECT p.repo, p.start, p.goal, e.dst, list_append(p.nodes, e.dst), list_append(p.legs, e.kind || ':' || e.protocol), least(p.w, e.conf_pct)
    FROM dk_paths p JOIN {dk_rel} e ON e.repo = p.repo AND e.src = p.cur
    WHERE p.cur <> p.goal AND NOT list_contains(p.nodes, e.dst) AND len(p.legs) < 8"""


@query("trace_path", """
    SELECT repo, start, goal, array_to_string(nodes, ' > ') AS nodes, array_to_string(legs, ' > ') AS legs, len(legs)::INTEGER AS hops, w AS weakest_pct, rn::INTEGER AS route, total, false AS exhausted
    FROM (SELECT *, count(*) OVER (PARTITION BY repo, start, goal) AS total, row_number() OVER (PARTITION BY repo, start, goal ORDER BY len(legs), w DESC, array_to_string(nodes, chr(0)), array_to_string(legs, chr(0))) AS rn
          FROM {dk_paths} WHERE cur = goal) WHERE rn <= 10""", M)
def trace_path(t):
    return g.trace_paths(merged(t), _wanted_routes(t)).select(
        "repo", "start", "goal", F.array_join("nodes", " > ").alias("nodes"), F.array_join("legs", " > ").alias("legs"), "hops", "weakest_pct", "route",
        "total", "exhausted")


def _wanted_routes(t):
    """Every component that has the name, with an image or without."""
    x, n = t.fx_expected.where("mode = 'expected'"), typed(t)
    return x.join(n.select("repo", F.col("name").alias("src_name"), F.col("id").alias("start")), ["repo", "src_name"]).join(
        n.select("repo", F.col("name").alias("dst_name"), F.col("id").alias("goal")), ["repo", "dst_name"]).select("repo", "start", "goal")


@query("trace_totals", """
    SELECT p.repo, p.start, p.goal, count(x.cur) AS total, false AS exhausted FROM {dk_pairs} p
    LEFT JOIN (SELECT * FROM {dk_paths} WHERE cur = goal) x ON x.repo = p.repo AND x.start = p.start AND x.goal = p.goal WHERE p.start <> p.goal GROUP BY ALL""", M)
def trace_totals(t):
    return g.trace_totals(merged(t), _wanted_routes(t))


@query("weakest_link", """
    SELECT repo, start, goal, array_to_string(nodes, ' > ') AS nodes, array_to_string(legs, ' > ') AS legs, w AS weakest_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, start, goal ORDER BY len(legs), w DESC, array_to_string(nodes, chr(0)), array_to_string(legs, chr(0))) AS rn
          FROM {dk_paths} WHERE cur = goal) WHERE rn <= 10""", M)
def weakest_link(t):
    # the routes found, by the confidences of their steps in the edge table
    route = ["repo", "start", "goal", "nodes", "legs"]
    routes = trace_path(t).select(*route)
    n, leg = F.split("nodes", " > "), F.split("legs", " > ")
    steps = routes.withColumns({"n": n, "leg": leg}).select(*route, F.posexplode("leg").alias("i", "step"), "n")
    steps = steps.select(*route, F.get("n", "i").alias("src"), F.get("n", F.col("i") + 1).alias("dst"), "step")
    pct = g.relationships(merged(t)).select("repo", "src", "dst", F.concat_ws(":", "kind", F.coalesce("protocol", F.lit(""))).alias("step"), "conf_pct")
    met = steps.join(pct, ["repo", "src", "dst", "step"]).groupBy(*route).agg(F.collect_list("conf_pct").alias("pcts"))
    return met.select(*route, g.weakest_link(F.col("pcts")).alias("weakest_pct"))


@query("describe_node", """
    SELECT n.repo, n.id, d.n_in, d.n_out, o.best_out, i.best_in, coalesce(x.n_diagnostics, 0) AS n_diagnostics,
           CASE WHEN d.n_in + d.n_out > 0 THEN '' WHEN n.kind = 'boundary' THEN 'grouping' WHEN coalesce(x.n_diagnostics, 0) > 0 THEN 'unread' ELSE 'isolated' END AS why_isolated
    FROM {fx_nodes} n JOIN {dk_degree} d ON d.repo = n.repo AND d.id = n.id
    LEFT JOIN (SELECT repo, src AS id, arg_min(id, (-conf_pct, dst, kind, protocol)) AS best_out FROM {dk_rel} GROUP BY repo, src) o ON o.repo = n.repo AND o.id = n.id
    LEFT JOIN (SELECT repo, dst AS id, arg_min(id, (-conf_pct, src, kind, protocol)) AS best_in FROM {dk_rel} GROUP BY repo, dst) i ON i.repo = n.repo AND i.id = n.id
    LEFT JOIN (SELECT repo, path, count(DISTINCT (line, code)) AS n_diagnostics FROM {fx_diagnostics} GROUP BY ALL) x ON x.repo = n.repo AND x.path = n.path""", M)
def describe_node(t):
    return q.describe_nodes(typed(t), merged(t), t.fx_diagnostics)


@query("diagnostics_for_node", """
    SELECT DISTINCT n.repo, n.id, d.path, d.line, d.code FROM {fx_nodes} n JOIN {fx_diagnostics} d ON d.repo = n.repo AND d.path = n.path""")
def diagnostics_for_node(t):
    return dg.diagnostics_for_node(typed(t).select("repo", "id", "path"), t.fx_diagnostics)


M["dk_asks"] = """SELECT repo, rule_id AS ask_id, trim(from_ref) AS ref FROM {fx_rules} UNION ALL SELECT repo, rule_id + 1000000000, to_ref FROM {fx_rules}
    UNION ALL SELECT 'a', c_custkey + 2000000000, CASE c_custkey % 3 WHEN 0 THEN 'vc-' || c_custkey WHEN 1 THEN 'SVC-' || c_custkey ELSE 'db-' || c_custkey || '.NS-1' END FROM customer"""


@query("resolve_ref", """
    WITH c AS (
      SELECT a.ask_id, a.repo, n.id, CASE WHEN n.id = a.ref THEN 0 WHEN lower(n.name) = lower(a.ref) THEN 1
               WHEN contains(a.ref, '.') AND lower(n.name) = lower(split_part(a.ref, '.', 1)) AND lower(coalesce(n.namespace, '')) = lower(a.ref[strpos(a.ref, '.') + 1:]) THEN 2
               WHEN contains(lower(n.name), lower(a.ref)) THEN 3 END AS tier
      FROM {dk_asks} a JOIN {fx_nodes} n ON n.repo = a.repo WHERE a.ref <> ''),
    b AS (SELECT *, min(tier) OVER (PARTITION BY ask_id) AS best FROM c WHERE tier IS NOT NULL),
    k AS (SELECT ask_id, count(*) AS n, min(id) AS lo FROM b WHERE tier = best GROUP BY ask_id)
    SELECT a.repo, a.ask_id, a.ref, coalesce(n, 0)::INTEGER AS n_matches, CASE WHEN n = 1 THEN lo END AS node_id FROM {dk_asks} a LEFT JOIN k USING (ask_id)""", M)
def resolve_ref(t):
    return q.resolve_refs(_asks(t), typed(t))


def _asks(t):
    return t.fx_rules.select("repo", F.col("rule_id").alias("ask_id"), F.trim("from_ref").alias("ref")).unionByName(
        t.fx_rules.select("repo", (F.col("rule_id") + 1000000000).alias("ask_id"), F.col("to_ref").alias("ref"))).unionByName(
        t.customer.selectExpr("'a' AS repo", "c_custkey + 2000000000 AS ask_id",
                              "CASE c_custkey % 3 WHEN 0 THEN 'vc-' || c_custkey WHEN 1 THEN 'SVC-' || c_custkey ELSE 'db-' || c_custkey || '.NS-1' END AS ref"))


@query("ref_candidates", """
    WITH c AS (
      SELECT a.ask_id, a.repo, a.ref, n.id, CASE WHEN n.id = a.ref THEN 0 WHEN lower(n.name) = lower(a.ref) THEN 1
               WHEN contains(a.ref, '.') AND lower(n.name) = lower(split_part(a.ref, '.', 1)) AND lower(coalesce(n.namespace, '')) = lower(a.ref[strpos(a.ref, '.') + 1:]) THEN 2
               WHEN contains(lower(n.name), lower(a.ref)) THEN 3 END AS tier
      FROM {dk_asks} a JOIN {fx_nodes} n ON n.repo = a.repo WHERE a.ref <> ''),
    b AS (SELECT *, min(tier) OVER (PARTITION BY ask_id) AS best FROM c WHERE tier IS NOT NULL),
    k AS (SELECT *, count(*) OVER (PARTITION BY ask_id) AS n FROM b WHERE tier = best)
    SELECT DISTINCT repo, tier, CASE WHEN tier = 0 THEN ref ELSE lower(ref) END AS form, id AS node_id FROM k WHERE n > 1""", M)
def ref_candidates(t):
    return q.ref_candidates(_asks(t), typed(t))


@query("node_edges", f"""
    WITH v AS (SELECT DISTINCT repo, {D.edge_id('src', 'dst', 'kind', 'protocol')} AS edge, rule, path, line, detail, extractor FROM {{fx_edges}}),
    f AS (SELECT * FROM (SELECT *, count(*) OVER w AS n_evidence, row_number() OVER (PARTITION BY repo, edge ORDER BY rule, path, line, detail, extractor) AS rn FROM v WINDOW w AS (PARTITION BY repo, edge)) WHERE rn = 1)
    SELECT e.repo, unnest([e.src, e.dst]) AS id, unnest(['out', 'in']) AS direction, unnest([e.dst, e.src]) AS peer, e.id AS edge, e.kind, e.protocol, e.conf_pct, f.n_evidence, f.rule, f.path, f.line, f.detail
    FROM {{dk_rel}} e JOIN f ON f.repo = e.repo AND f.edge = e.id""", M)
def node_edges(t):
    return q.node_edges(merged(t), mg.edge_evidence(t.fx_edges))


@query("overview_parts", """
    SELECT repo, 'kind' AS part, kind AS value, count(*) AS n FROM {fx_nodes} GROUP BY ALL
    UNION ALL SELECT repo, 'project', project, count(*) FROM {fx_nodes} WHERE kind <> 'boundary' GROUP BY ALL
    UNION ALL SELECT repo, 'relationship', kind, count(*) FROM {dk_rel} GROUP BY ALL
    UNION ALL SELECT repo, 'severity', severity, count(*) FROM {fx_diagnostics} GROUP BY ALL
    UNION ALL SELECT repo, 'size', unnest(['components', 'connected', 'clusters']), unnest([components::BIGINT, connected::BIGINT, clusters::BIGINT]) FROM {dk_stats}
    UNION ALL SELECT repo, 'shape', CASE WHEN components >= 8 AND connected * 4 < components AND clusters > components // 4 THEN 'inventory' WHEN components > 0 AND connected * 2 < components THEN 'sparse' ELSE 'connected' END, 1 FROM {dk_stats}
    UNION ALL SELECT repo, 'most_connected', id, n_in + n_out FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_in + n_out DESC, id) AS rank FROM {dk_degree} WHERE kind <> 'boundary' AND n_in + n_out > 0) WHERE rank <= 8
    UNION ALL SELECT repo, 'files', unnest(['files_scanned', 'files_parsed']), unnest([count(DISTINCT path), count(DISTINCT CASE WHEN path IN (SELECT path FROM {fx_nodes}) THEN path END)])
      FROM (SELECT repo, path FROM {fx_nodes} UNION ALL SELECT repo, path FROM {fx_diagnostics}) GROUP BY repo""", M)
def overview_parts(t):
    nodes = typed(t)
    seen = nodes.select("repo", "path").unionByName(t.fx_diagnostics.select("repo", "path")).distinct()
    given = nodes.select("path").distinct().withColumn("given", F.lit(True))
    files = seen.join(given, "path", "left").groupBy("repo").agg(F.count("*").alias("files_scanned"), F.count("given").alias("files_parsed"))
    return q.overview_parts(nodes, merged(t), t.fx_diagnostics, labels(t), files)


@query("overview", """
    SELECT s.repo, components, connected, clusters, r.relationships, coalesce(d.gaps, 0) AS gaps, coalesce(f.n_files, 0) AS n_files, top.id AS top_node
    FROM {dk_stats} s JOIN (SELECT repo, count(*) AS relationships FROM {dk_rel} GROUP BY ALL) r USING (repo)
    LEFT JOIN (SELECT repo, count(*) AS gaps FROM {fx_diagnostics} WHERE severity <> 'info' GROUP BY ALL) d USING (repo)
    LEFT JOIN (SELECT repo, count(DISTINCT path) AS n_files FROM {fx_nodes} GROUP BY ALL) f USING (repo)
    LEFT JOIN (SELECT repo, arg_min(id, (-(n_in + n_out), id)) AS id FROM {dk_degree} WHERE kind <> 'boundary' GROUP BY repo) top USING (repo)""", M)
def overview(t):
    return q.overview(typed(t), merged(t), t.fx_diagnostics, labels(t))


@query("shape_report", """
    SELECT repo, unnest(['nodes', 'edges', 'connected', 'clusters', 'redundant']) AS what,
           unnest([n_nodes, n_edges, connected, clusters, redundant::BIGINT]) AS n FROM {dk_stats}
    JOIN (SELECT repo, sum(n - 1) AS redundant FROM (SELECT repo, name, count(*) AS n FROM {fx_nodes} GROUP BY ALL) GROUP BY repo) USING (repo)
    UNION ALL SELECT repo, 'kind ' || kind, count(*) FROM {fx_nodes} GROUP BY ALL
    UNION ALL SELECT repo, 'relationship ' || kind, count(*) FROM {dk_edges} GROUP BY ALL
    UNION ALL SELECT repo, 'diagnostic ' || code, count(*) FROM {fx_diagnostics} GROUP BY ALL""", M)
def shape_report(t):
    return q.shape_report(typed(t), merged(t), t.fx_diagnostics, labels(t))


M["dk_reach_rel"] = """SELECT repo, src, dst, kind, coalesce(protocol, '') AS protocol, max(conf_pct) AS conf_pct
    FROM {dk_resolved} WHERE kind <> 'contains' GROUP BY ALL"""
_levels(_START.replace("WHERE kind =", "WHERE kind = 'datastore' OR kind =") + "'queue'", "dst", "src", "blast", "dk_reach_rel")


@query("blast_radius", "SELECT * FROM {dk_blast}", M)
def blast_radius(t):
    """References to edges to dependents: which components lose something if a
    queue fails, from environment rows alone."""
    d, nodes, _ = decisions(t)
    edges = t.table("env_edges", lambda: mg.merge_edges(_matched(d, nodes)))
    starts = nodes.where("kind IN ('queue', 'datastore')").select("repo", F.col("id").alias("start"))
    return g.impact_of(edges, starts)


def _matched(d, nodes):
    from archgraph.operators.match import resolved_edges

    return resolved_edges(d, nodes)
