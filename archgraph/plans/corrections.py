"""Registered queries: code joins, projects, corrections, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions import deps
from archgraph.operators import joins as jn
from archgraph.operators import merge as mg
from archgraph.operators import overrides as ov
from archgraph.operators import projects as pj
from archgraph.operators import quality as ql
from archgraph.plans import duck as D
from archgraph.plans.graphs import M, merged
from archgraph.plans.registry import query
from archgraph.plans.resolution import decisions, graph_inputs, typed

C = dict(M)
C["dk_bctx"] = """
    SELECT n.repo, h.code, n.id AS deployment FROM {fx_nodes} n JOIN (SELECT repo, directory, count(*) AS n, min(id) AS code FROM {fx_nodes}
      WHERE directory IS NOT NULL GROUP BY ALL) h ON h.repo = n.repo AND h.directory = n.build_context WHERE h.n = 1 AND h.code <> n.id"""
C["dk_codekeys"] = """
    SELECT repo, project, id AS code, directory AS dir, string_split(directory, '/')[-1] AS key FROM {fx_nodes} WHERE directory IS NOT NULL AND image IS NULL
    UNION SELECT n.repo, n.project, n.id, n.directory, f.form FROM {fx_nodes} n JOIN {dk_forms} f ON f.repo = n.repo AND f.node_id = n.id AND f.form_kind = 'name'
    WHERE n.directory IS NOT NULL AND n.image IS NULL"""
C["dk_depkeys"] = r"""
    SELECT DISTINCT n.repo, n.project, n.id AS deployment, regexp_replace(n.path, '/[^/]*$', '') AS dir,
           CASE WHEN f.form_kind = 'image' THEN string_split(f.form, '/')[-1] ELSE f.form END AS key
    FROM {fx_nodes} n JOIN {dk_forms} f ON f.repo = n.repo AND f.node_id = n.id AND f.form_kind IN ('name', 'image')
    WHERE n.image IS NOT NULL AND n.build_context IS NULL"""
C["dk_pairs2"] = """
    SELECT d.repo, c.code, d.deployment, d.key, d.project = c.project AND (d.project <> '.' OR c.dir = d.dir OR starts_with(c.dir, d.dir || '/')
             OR string_split(c.dir, '/')[1] <> string_split(d.dir, '/')[1]) AS same_tree
    FROM {dk_depkeys} d JOIN {dk_codekeys} c ON c.repo = d.repo AND c.key = d.key"""
C["dk_claims"] = """
    SELECT repo, code, deployment, 'build_context' AS how FROM {dk_bctx}
    UNION ALL SELECT repo, min(code), deployment, 'basename' FROM {dk_pairs2} WHERE same_tree GROUP BY repo, deployment HAVING count(DISTINCT code) = 1"""
C["dk_codemerges"] = """
    SELECT repo, code AS absorbed, min(deployment) AS survivor, min(how) AS how FROM {dk_claims} GROUP BY ALL HAVING count(*) = 1""".replace("GROUP BY ALL", "GROUP BY repo, code")


def code_merges(t):
    nodes, forms = graph_inputs(t)
    return t.table("code_merges", lambda: jn.code_merges(nodes, forms))


@query("build_context_join", "SELECT * FROM {dk_bctx}", C)
def build_context_join(t):
    return jn.build_context_join(typed(t))


@query("basename_join", """
    SELECT repo, min(code) AS code, deployment FROM {dk_pairs2} WHERE same_tree GROUP BY repo, deployment HAVING count(DISTINCT code) = 1""", C)
def basename_join(t):
    return jn.basename_join(*graph_inputs(t))


@query("code_merges", "SELECT repo, absorbed, survivor, how FROM {dk_codemerges}", C)
def code_merges_query(t):
    return jn.code_merges(*graph_inputs(t))


@query("cross_project_report", """
    SELECT p.repo, p.code, p.key, count(*) AS n_refused FROM {dk_pairs2} p LEFT JOIN {dk_codemerges} m ON m.repo = p.repo AND m.absorbed = p.code
    WHERE NOT same_tree AND m.absorbed IS NULL GROUP BY ALL""", C)
def cross_project_report(t):
    nodes, forms = graph_inputs(t)
    return jn.cross_project_report(nodes, forms, code_merges(t))


C["dk_owned"] = f"""
    WITH o AS (SELECT DISTINCT x.repo, x.dir, coalesce(m.survivor, x.id) AS owner FROM (
                 SELECT repo, id, directory AS dir FROM {{fx_nodes}} WHERE kind = 'service' AND directory IS NOT NULL
                 UNION ALL SELECT repo, id, build_context FROM {{fx_nodes}} WHERE kind = 'service' AND build_context IS NOT NULL) x
               LEFT JOIN {{dk_codemerges}} m ON m.repo = x.repo AND m.absorbed = x.id),
    k AS (SELECT repo, dir, count(*) AS n, min(owner) AS owner FROM o GROUP BY repo, dir)
    SELECT h.repo, h.hint_id, h.path, coalesce(n, 0)::INTEGER AS n_owners, CASE WHEN n = 1 THEN owner END AS from_node
    FROM (SELECT *, {D.clean_path('owner_dir')} AS d FROM {{fx_dir_hints}}) h LEFT JOIN k ON k.repo = h.repo AND k.dir = h.d"""


@query("directory_owner_join", "SELECT repo, hint_id, n_owners, from_node FROM {dk_owned}", C)
def directory_owner_join(t):
    return jn.directory_owner_join(t.fx_dir_hints, typed(t), code_merges(t)).select("repo", "hint_id", "n_owners", "from_node")


@query("owner_diagnostics", """
    SELECT repo, path, CASE WHEN max(n_owners) = 0 THEN 'env_file_unowned' ELSE 'env_file_ambiguous_owner' END AS code,
           CASE WHEN max(n_owners) = 0 THEN 'info' ELSE 'warn' END AS severity, max(n_owners) AS n_owners FROM {dk_owned} WHERE n_owners <> 1 GROUP BY repo, path""", C)
def owner_diagnostics(t):
    return jn.owner_diagnostics(jn.directory_owner_join(t.fx_dir_hints, typed(t), code_merges(t)))


# -------------------------------------------------------------- technologies
C["dk_depnames"] = f"SELECT DISTINCT dependency, {D.norm_dep('dependency')} AS name FROM {{fx_deps}}"
C["dk_deplib"] = """
    SELECT dependency, tech, kind, edge FROM (SELECT d.dependency, l.*, row_number() OVER (PARTITION BY d.dependency ORDER BY l.dep = d.name DESC, length(l.dep) DESC) AS rn
      FROM {dk_depnames} d JOIN {dk_libraries} l ON l.dep = d.name OR ((contains(l.dep, '/') OR ends_with(l.dep, '-')) AND starts_with(d.name, l.dep))) WHERE rn = 1"""
C["dk_implied"] = """
    SELECT f.repo, f.component AS from_node, l.tech, min(f.dependency) AS dependency, arg_min(f.path, (f.dependency, f.path)) AS path,
           arg_min(l.edge, (f.dependency, f.path)) AS edge
    FROM {fx_deps} f JOIN {dk_deplib} l USING (dependency) GROUP BY f.repo, f.component, l.tech"""


def implied(t):
    from archgraph.sources.manifests import implied_infrastructure

    return implied_infrastructure(t.fx_deps)


@query("implied_infrastructure", f"""
    SELECT repo, from_node, tech, dependency, path, edge AS suggested_edge, tech IN ({D.in_list(vocab.VENDOR_TECHNOLOGIES)}) AS vendor FROM {{dk_implied}}""", C)
def implied_infrastructure(t):
    return implied(t)


@query("uses_technology", "SELECT repo, from_node, tech FROM {dk_implied}", C)
def uses_technology(t):
    return jn.uses_technology(implied(t))


C["dk_allrel"] = """
    SELECT DISTINCT repo, src, dst FROM {dk_resolved} UNION SELECT repo, from_node, """ + D.node_id("'external'", "''", "host") + " FROM {dk_ext}"
C["dk_extnodes"] = """SELECT repo, id, name, kind, project, framework FROM {fx_nodes} UNION ALL
    SELECT repo, """ + D.node_id("'external'", "''", "host") + ", host, 'external', '.', NULL FROM {dk_ext} WHERE rn = 1"
C["dk_corr"] = """
    WITH s AS (SELECT i.repo, i.from_node, i.tech, count(*) AS n, min(n.id) AS target FROM {dk_implied} i
      JOIN {fx_nodes} f ON f.repo = i.repo AND f.id = i.from_node
      JOIN {fx_nodes} n ON n.repo = i.repo AND n.framework = i.tech AND n.id <> i.from_node AND n.kind <> 'boundary' AND (n.kind = 'external' OR n.project = f.project)
      GROUP BY ALL HAVING count(*) = 1)
    SELECT s.repo, s.from_node, s.tech, s.target FROM s JOIN {dk_allrel} e ON e.repo = s.repo AND e.src = s.from_node AND e.dst = s.target"""


def all_edges(t):
    from archgraph.operators import match

    d, nodes, _ = decisions(t)
    ext_nodes, ext_edges = match.external_synthesis(d)
    return match.resolved_edges(d, nodes).unionByName(ext_edges), ext_nodes


@query("library_corroboration", "SELECT repo, from_node, tech, target FROM {dk_corr}", C)
def library_corroboration(t):
    nodes, forms = graph_inputs(t)
    return jn.library_corroboration(implied(t), nodes, forms, all_edges(t)[0])


@query("vendor_synthesis", f"""
    SELECT i.repo, i.from_node AS src, 'context:' || i.tech AS dst, i.tech AS dst_name, 'https' AS protocol, 40 AS conf_pct,
           'dependency_names_vendor' AS rule, i.path, i.dependency FROM {{dk_implied}} i
    WHERE i.tech IN ({D.in_list(vocab.VENDOR_TECHNOLOGIES)})
      AND NOT EXISTS (SELECT 1 FROM {{dk_corr}} c WHERE c.repo = i.repo AND c.from_node = i.from_node AND c.tech = i.tech)
      AND NOT EXISTS (SELECT 1 FROM {{dk_allrel}} e JOIN {{dk_extnodes}} n ON n.repo = e.repo AND n.id = e.dst
                      WHERE e.repo = i.repo AND e.src = i.from_node AND contains(lower(n.name), i.tech))""", C)
def vendor_synthesis(t):
    nodes, forms = graph_inputs(t)
    edges, ext = all_edges(t)
    known = nodes.select("repo", "id", "name").unionByName(ext.select("repo", "id", "name"))
    return jn.vendor_synthesis(implied(t), known, edges, jn.library_corroboration(implied(t), nodes, forms, edges))


# ------------------------------------------------------------------- merges
C["dk_merged_edges"] = """
    SELECT e.repo, coalesce(a.survivor, e.src) AS src, coalesce(b.survivor, e.dst) AS dst, e.kind, e.conf_pct, e.rule, e.line
    FROM {dk_resolved} e LEFT JOIN {dk_codemerges} a ON a.repo = e.repo AND a.absorbed = e.src
    LEFT JOIN {dk_codemerges} b ON b.repo = e.repo AND b.absorbed = e.dst WHERE coalesce(a.survivor, e.src) <> coalesce(b.survivor, e.dst)"""


@query("apply_merges", "SELECT * FROM {dk_merged_edges}", C)
def apply_merges(t):
    from archgraph.operators import match

    d, nodes, _ = decisions(t)
    e = match.resolved_edges(d, nodes).select("repo", "src", "dst", "kind", "conf_pct", "rule", "line")
    return mg.apply_merges(e, code_merges(t).select("repo", "absorbed", "survivor"))


# ----------------------------------------------------------------- projects
_SUB = "(SELECT repo, root FROM {fx_projects} WHERE root <> '.')"
C["dk_proj"] = f"""
    SELECT f.repo, f.page_id, f.path, coalesce(arg_max(r.root, length(r.root)), '.') AS project FROM {{fx_paths}} f
    LEFT JOIN {_SUB} r ON r.repo = f.repo AND (f.path = r.root OR starts_with(f.path, r.root || '/')) GROUP BY ALL"""


@query("project_of", "SELECT repo, page_id, project FROM {dk_proj}", C)
def project_of(t):
    return pj.project_of(t.fx_paths, t.fx_projects).select("repo", "page_id", "project")


_SCOPES = "SELECT repo, project AS root, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'src-svc-5' ELSE 'ns-' || (page_id % 4) END AS scope FROM {dk_proj}"
C["dk_scopes"] = f"SELECT DISTINCT * FROM ({_SCOPES} UNION ALL SELECT repo, root, CASE root WHEN 'proj-1' THEN 'src-svc-5' ELSE '' END FROM {{fx_projects}} WHERE root <> '.')"
C["dk_lab0"] = "SELECT DISTINCT repo, root, replace(root, '/', '-') AS label FROM {fx_projects} WHERE root <> '.'"
_CLASH = """SELECT repo, bool_or(k > 1) AS clash FROM (SELECT l.repo, {seg} AS seg, count(DISTINCT l.root) AS k
    FROM {{{t}}} l JOIN {{dk_scopes}} s ON s.repo = l.repo AND s.root = l.root GROUP BY l.repo, {seg}) GROUP BY repo"""
_SEG = D.slug_segment("CASE WHEN s.scope = '' THEN l.label ELSE l.label || '-' || s.scope END")
C["dk_cl0"] = _CLASH.format(seg="(" + _SEG + ")", t="dk_lab0")
C["dk_lab1"] = """SELECT l.repo, l.root, CASE WHEN coalesce(c.clash, false) THEN l.label || '-' || substr(sha256(l.root), 1, 6) ELSE l.label END AS label
    FROM {dk_lab0} l LEFT JOIN {dk_cl0} c ON c.repo = l.repo"""
C["dk_cl1"] = _CLASH.format(seg="(" + _SEG + ")", t="dk_lab1")


def scopes(t):
    placed = pj.project_of(t.fx_paths, t.fx_projects).select("repo", F.col("project").alias("root"), F.expr(
        "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'src-svc-5' ELSE 'ns-' || (page_id % 4) END AS scope"))
    return placed.unionByName(t.fx_projects.where("root <> '.'").select(
        "repo", "root", F.expr("CASE root WHEN 'proj-1' THEN 'src-svc-5' ELSE '' END AS scope")))


@query("project_label_collisions", """
    SELECT l.repo, l.root, l.label, coalesce(c.clash, false) AS collides FROM {dk_lab1} l LEFT JOIN {dk_cl1} c ON c.repo = l.repo""", C)
def project_label_collisions(t):
    return pj.project_labels(t.fx_projects, scopes(t))


@query("qualify_by_project", f"""
    SELECT p.repo, p.page_id, p.project, CASE WHEN l.label IS NULL THEN 'container:web' ELSE 'container:@' || ({D.slug_segment('l.label')}) || '/web' END AS id,
           CASE WHEN l.label IS NULL THEN 'container:@ns-1/api' ELSE 'container:@' || ({D.slug_segment("l.label || '-ns-1'")}) || '/api' END AS peer
    FROM {{dk_proj}} p LEFT JOIN {{dk_lab1}} l ON l.repo = p.repo AND l.root = p.project""", C)
def qualify_by_project(t):
    rows = t.fx_paths.select("repo", "page_id", "path", F.lit("container:web").alias("id"), F.lit("container:@ns-1/api").alias("peer"))
    return pj.qualify_by_project(rows, pj.project_labels(t.fx_projects, scopes(t)), t.fx_projects, ["id", "peer"]).select(
        "repo", "page_id", "project", "id", "peer")


C["sp_r"] = r"SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM {fx_decls}"
C["sp_depth"] = """
    SELECT id, count(*) - 1 AS depth FROM (
      SELECT id, 0 AS d FROM {sp_r} GROUP BY id HAVING count(DISTINCT dir) > 1
      UNION ALL SELECT x.id, x.d FROM (SELECT id, unnest(range(1, len(parts) + 1)) AS d, parts FROM {sp_r}) x
      JOIN (SELECT id, count(*) AS n, count(DISTINCT dir) AS k FROM {sp_r} GROUP BY id) n ON n.id = x.id AND n.k > 1
      GROUP BY x.id, x.d, n.n HAVING count(*) = n.n AND count(DISTINCT x.parts[1:x.d]) = 1) GROUP BY id"""
C["sp_placed"] = "SELECT r.*, s.depth, array_to_string(parts[1:s.depth + 1], '/') AS tree FROM {sp_r} r JOIN {sp_depth} s USING (id) WHERE len(parts) > s.depth"
C["sp_tree"] = """SELECT id, depth, tree, arg_min(lower(string_split(string_split(image, ':')[1], '/')[-1]), seq) FILTER (image IS NOT NULL) AS image,
    arg_min(build, seq) FILTER (build IS NOT NULL) AS build FROM {sp_placed} GROUP BY ALL"""
C["sp_sets"] = """SELECT id, depth, count(*) AS n_trees, list_sort(list(tree)) AS trees, count(DISTINCT image) > 1 OR count(DISTINCT build) > 1 AS differs,
    bool_and(tree = 'apps/g5' OR starts_with(tree, 'apps/g5/')) AS together FROM {sp_tree} GROUP BY id, depth HAVING count(*) >= 2"""
C["sp_shared"] = """SELECT DISTINCT trees FROM (SELECT m.trees, r.id, count(DISTINCT m.tree) AS n FROM (SELECT DISTINCT trees, unnest(trees) AS tree FROM {sp_sets}) m
    JOIN {sp_r} r ON starts_with(r.path, m.tree || '/') WHERE r.kind NOT IN ('boundary', 'external') GROUP BY ALL) WHERE n >= 2"""


def _eight(x):
    return f"array_to_string({x}[1:8], ', ') || CASE WHEN len({x}) > 8 THEN ' and ' || (len({x}) - 8) || ' more' ELSE '' END"


@query("suspect_projects", f"""
    WITH h AS (SELECT s.*, CASE WHEN differs THEN 'described-differently' ELSE 'unrelated' END AS ground FROM {{sp_sets}} s
      WHERE NOT together AND (differs OR (depth > 0 AND trees NOT IN (SELECT trees FROM {{sp_shared}})))),
    n AS (SELECT id, coalesce(arg_min(name, seq) FILTER (name_from IS NULL), arg_min(name, seq)) AS name FROM {{fx_decls}} GROUP BY id),
    g AS (SELECT ground, trees, list_sort(list(DISTINCT name)) AS names FROM h JOIN n USING (id) GROUP BY ground, trees)
    SELECT 'a' AS repo, ground, len(trees)::INTEGER AS n_trees, {_eight('trees')} AS trees, len(names) AS n_shared, {_eight('names')} AS shared FROM g""", C)
def suspect_projects(t):
    return pj.suspect_projects(t.fx_decls, t.fx_decl_projects)


# -------------------------------------------------------------- corrections
C["ov_forms"] = """
    SELECT repo, form, count(DISTINCT node_id) AS n, min(node_id) AS node_id FROM (
      SELECT repo, id AS node_id, unnest([lower(id), lower(name), CASE WHEN namespace IS NOT NULL THEN lower(name) || '.' || lower(namespace) END]) AS form FROM {fx_nodes})
    WHERE form IS NOT NULL GROUP BY repo, form"""
C["ov_same"] = """SELECT r.repo, rule_id, pos, trim(ref) AS ref, coalesce(f.n, 0) AS n, CASE WHEN f.n = 1 THEN f.node_id END AS node FROM (
      SELECT repo, rule_id, 0 AS pos, from_ref AS ref FROM {fx_rules} WHERE action = 'same'
      UNION ALL SELECT repo, rule_id, 1, to_ref FROM {fx_rules} WHERE action = 'same' AND rule_id % 9 <> 2) r
    LEFT JOIN {ov_forms} f ON f.repo = r.repo AND f.form = lower(trim(r.ref))"""
C["ov_merges"] = """
    WITH u AS (SELECT repo, rule_id, arg_min(node, pos) AS survivor FROM {ov_same} GROUP BY ALL HAVING count(*) = count(node) AND count(*) >= 2)
    SELECT s.repo, s.node AS absorbed, arg_min(u.survivor, s.rule_id) AS survivor FROM {ov_same} s JOIN u USING (repo, rule_id) WHERE s.node <> u.survivor GROUP BY s.repo, s.node"""
C["ov_rel"] = f"""
    SELECT r.*, a.node_id AS a_id, b.node_id AS b_id, CASE WHEN a.n = 1 THEN a.node_id END AS src, CASE WHEN b.n = 1 THEN b.node_id END AS dst,
      r.kind = '' AS any_kind, CASE WHEN r.kind = '' THEN 'depends_on' ELSE lower(trim(r.kind)) END AS edge_kind,
      CASE WHEN coalesce(a.n, 0) = 0 THEN 'override_unresolved' WHEN a.n > 1 THEN 'override_ambiguous' WHEN coalesce(b.n, 0) = 0 THEN 'override_unresolved'
           WHEN b.n > 1 THEN 'override_ambiguous' WHEN a.node_id = b.node_id THEN 'override_unresolved'
           WHEN r.kind <> '' AND lower(trim(r.kind)) NOT IN ({D.in_list(vocab.EDGE_KINDS)}) THEN 'override_unknown_kind' END AS problem
    FROM {{fx_rules}} r LEFT JOIN {{ov_forms}} a ON a.repo = r.repo AND a.form = lower(trim(r.from_ref))
    LEFT JOIN {{ov_forms}} b ON b.repo = r.repo AND b.form = lower(trim(r.to_ref)) WHERE r.action <> 'same'"""
C["ov_rm"] = "SELECT * FROM {ov_rel} WHERE action = 'remove' AND problem IS NULL"
C["ov_adds"] = """SELECT * FROM {ov_rel} a WHERE action = 'add' AND problem IS NULL AND NOT EXISTS (SELECT 1 FROM {ov_rm} r
    WHERE r.repo = a.repo AND r.src = a.src AND r.dst = a.dst AND (r.any_kind OR r.edge_kind = a.edge_kind) AND r.rule_id > a.rule_id)"""
C["ov_kept"] = """SELECT * FROM {dk_edges} e WHERE NOT EXISTS (SELECT 1 FROM {ov_rm} r WHERE r.repo = e.repo AND r.src = e.src AND r.dst = e.dst
    AND (r.any_kind OR r.edge_kind = e.kind))"""
C["ov_final"] = """
    WITH d AS (SELECT repo, src, dst, edge_kind AS kind, count(*) AS declared FROM {ov_adds} GROUP BY ALL)
    SELECT coalesce(e.repo, d.repo) AS repo, coalesce(e.src, d.src) AS src, coalesce(e.dst, d.dst) AS dst, coalesce(e.kind, d.kind) AS kind,
           coalesce(e.protocol, '') AS protocol, CASE WHEN d.declared > 0 THEN 100 ELSE e.conf_pct END AS conf_pct, coalesce(d.declared, 0) AS declared
    FROM {ov_kept} e FULL JOIN d ON d.repo = e.repo AND d.src = e.src AND d.dst = e.dst AND d.kind = e.kind"""


def same_rules(t):
    both = F.array(F.struct(F.lit(0).alias("pos"), F.col("from_ref").alias("ref")), F.struct(F.lit(1).alias("pos"), F.col("to_ref").alias("ref")))
    return t.fx_rules.where("action = 'same'").select("repo", "rule_id", F.explode(both).alias("m")).select("repo", "rule_id", "m.*").where(
        "pos = 0 OR rule_id % 9 <> 2")


def relationship_rules(t):
    return ov.relationship_rules(t.fx_rules.where("action <> 'same'"), ov.reference_forms(typed(t)))


@query("override_merge", """
    SELECT 'edge' AS part, e.repo, coalesce(a.survivor, e.src) AS src, coalesce(b.survivor, e.dst) AS dst, e.kind FROM {dk_edges} e
    LEFT JOIN {ov_merges} a ON a.repo = e.repo AND a.absorbed = e.src LEFT JOIN {ov_merges} b ON b.repo = e.repo AND b.absorbed = e.dst
    WHERE coalesce(a.survivor, e.src) <> coalesce(b.survivor, e.dst)
    UNION ALL SELECT 'node', n.repo, n.id, '', n.kind FROM {fx_nodes} n WHERE NOT EXISTS (SELECT 1 FROM {ov_merges} m WHERE m.repo = n.repo AND m.absorbed = n.id)""", C)
def override_merge(t):
    merges = ov.component_merges(same_rules(t), ov.reference_forms(typed(t)))
    nodes, edges = ov.override_merge(typed(t), merged(t).select("repo", "src", "dst", "kind"), merges)
    return edges.select(F.lit("edge").alias("part"), "repo", "src", "dst", "kind").unionByName(
        nodes.select(F.lit("node").alias("part"), "repo", F.col("id").alias("src"), F.lit("").alias("dst"), "kind"))


@query("override_remove", "SELECT repo, id FROM {ov_kept}", C)
def override_remove(t):
    return ov.override_remove(merged(t), relationship_rules(t)).select("repo", "id")


@query("override_add", "SELECT * FROM {ov_final}", C)
def override_add(t):
    rules = relationship_rules(t)
    return ov.override_add(ov.override_remove(merged(t), rules), ov.surviving_adds(rules))


@query("drop_orphan_externals", """
    SELECT repo, id FROM {fx_nodes} n WHERE kind <> 'external' OR EXISTS (SELECT 1 FROM {ov_final} e WHERE e.repo = n.repo AND (e.src = n.id OR e.dst = n.id))""", C)
def drop_orphan_externals(t):
    rules = relationship_rules(t)
    edges = ov.override_add(ov.override_remove(merged(t), rules), ov.surviving_adds(rules))
    return ov.drop_orphan_externals(typed(t), edges).select("repo", "id")


@query("rule_diagnostics", """
    SELECT repo, rule_id, code FROM (SELECT repo, rule_id, CASE WHEN count(*) < 2 THEN 'override_incomplete'
        WHEN count(node) < count(*) THEN arg_min(CASE WHEN ref <> '' AND n > 1 THEN 'override_ambiguous' ELSE 'override_unresolved' END, pos) FILTER (node IS NULL)
        WHEN min(node) = max(node) THEN 'override_no_effect' END AS code FROM {ov_same} GROUP BY repo, rule_id) WHERE code IS NOT NULL
    UNION ALL SELECT repo, rule_id, problem FROM {ov_rel} WHERE problem IS NOT NULL
    UNION ALL SELECT repo, rule_id, 'override_no_effect' FROM {ov_rm} r WHERE rule_id NOT IN (
        SELECT min(m.rule_id) FROM {dk_edges} e JOIN {ov_rm} m ON m.repo = e.repo AND m.src = e.src AND m.dst = e.dst AND (m.any_kind OR m.edge_kind = e.kind) GROUP BY e.repo, e.id
        UNION SELECT min(m.rule_id) FROM {ov_rel} a JOIN {ov_rm} m ON m.repo = a.repo AND m.src = a.src AND m.dst = a.dst AND (m.any_kind OR m.edge_kind = a.edge_kind) AND m.rule_id > a.rule_id
        WHERE a.action = 'add' AND a.problem IS NULL GROUP BY a.repo, a.rule_id)""", C)
def rule_diagnostics(t):
    return ov.rule_diagnostics(same_rules(t), ov.reference_forms(typed(t)), relationship_rules(t), merged(t))


C["dk_new"] = "SELECT id, repo, CASE WHEN kind = 'publishes_to' THEN conf_pct + 5 ELSE conf_pct END AS conf_pct FROM {ov_kept} WHERE protocol <> 'grpc'"


@query("snapshot_diff", """
    SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM {dk_edges} a FULL JOIN (SELECT * FROM {dk_new} UNION ALL SELECT 'new' || id, repo, conf_pct FROM {dk_new} WHERE conf_pct = 45) b ON a.repo = b.repo AND a.id = b.id
    WHERE a.id IS NULL OR b.id IS NULL OR a.conf_pct <> b.conf_pct""", C)
def snapshot_diff(t):
    old = merged(t).select("repo", "id", "conf_pct", "protocol", "kind", "src", "dst")
    new = ov.override_remove(old, relationship_rules(t)).where("protocol <> 'grpc'").withColumn(
        "conf_pct", F.when(F.col("kind") == "publishes_to", F.col("conf_pct") + 5).otherwise(F.col("conf_pct")))
    extra = new.where("conf_pct = 45").withColumn("id", F.concat(F.lit("new"), "id"))
    return ov.snapshot_diff(old, new.unionByName(extra), ["repo", "id"], ["conf_pct"])


# ------------------------------------------------------------------- quality
C["q_named"] = """SELECT e.repo, a.name AS src_name, b.name AS dst_name, e.rule FROM {fx_edges} e JOIN {fx_nodes} a ON a.repo = e.repo AND a.id = e.src
    JOIN {fx_nodes} b ON b.repo = e.repo AND b.id = e.dst WHERE e.kind <> 'contains'"""
C["q_judged"] = """SELECT f.*, EXISTS (SELECT 1 FROM {fx_expected} x WHERE x.repo = f.repo AND x.mode = 'expected' AND x.src_name IN (f.src_name, '*') AND x.dst_name IN (f.dst_name, '*')) AS is_expected,
    EXISTS (SELECT 1 FROM {fx_expected} x WHERE x.repo = f.repo AND x.mode = 'allowed' AND x.src_name IN (f.src_name, '*') AND x.dst_name IN (f.dst_name, '*')) AS is_allowed
    FROM (SELECT DISTINCT repo, src_name, dst_name FROM {q_named}) f"""
C["q_scores"] = """
    WITH p AS (SELECT repo, count(*) AS found, count(*) FILTER (is_expected OR is_allowed) AS correct FROM {q_judged} GROUP BY repo),
    w AS (SELECT DISTINCT repo, src_name, dst_name FROM {fx_expected} WHERE mode = 'expected'),
    r AS (SELECT w.repo, count(*) AS expected, count(*) FILTER (EXISTS (SELECT 1 FROM {q_judged} j WHERE j.repo = w.repo AND w.src_name IN (j.src_name, '*') AND w.dst_name IN (j.dst_name, '*'))) AS matched FROM w GROUP BY w.repo)
    SELECT repo, coalesce(found, 0) AS found, coalesce(correct, 0) AS correct, coalesce(expected, 0) AS expected, coalesce(matched, 0) AS matched,
      CASE WHEN found > 0 THEN correct / found ELSE 1.0 END::DOUBLE AS precision, CASE WHEN expected > 0 THEN matched / expected ELSE 1.0 END::DOUBLE AS recall FROM p FULL JOIN r USING (repo)"""


def judged(t):
    return ql.judge_pairs(ql.found_pairs(merged(t), typed(t)), t.fx_expected)


@query("precision_recall", "SELECT * FROM {q_scores}", C)
def precision_recall(t):
    return ql.precision_recall(judged(t), t.fx_expected)


@query("precision_by_rule", """
    SELECT rule, count(*) AS found, count(*) FILTER (NOT is_expected AND NOT is_allowed) AS wrong,
           1.0::DOUBLE - count(*) FILTER (NOT is_expected AND NOT is_allowed) / count(*) AS precision
    FROM (SELECT DISTINCT * FROM {q_named}) n JOIN {q_judged} j USING (repo, src_name, dst_name) GROUP BY rule""", C)
def precision_by_rule(t):
    return ql.precision_by_rule(judged(t), t.fx_edges, typed(t))


@query("precision_gate", "SELECT * FROM {q_scores} WHERE precision < 0.9", C)
def precision_gate(t):
    return ql.precision_gate(ql.precision_recall(judged(t), t.fx_expected))


_SRC_RE = r"\b([A-Z][A-Z0-9_]*?)_(?:ADDR|ADDRESS|URL|URI|HOST|ENDPOINT)\b"
C["q_derived"] = f"""
    SELECT DISTINCT s.repo, s.caller AS src_name, coalesce(a.callee, lower(replace(s.stem, '_', ''))) AS dst_name FROM (
      SELECT repo, caller, unnest(regexp_extract_all(content, '{_SRC_RE}', 1)) AS stem FROM {{fx_sources}}
      WHERE regexp_matches(lower(path), '\\.(go|cs|py|js|ts|java|rb|php)$') AND NOT regexp_matches(path, '{"|".join(ql.VENDORED)}')) s
    LEFT JOIN {{fx_stems}} a ON a.repo = s.repo AND a.stem = s.stem
    WHERE s.stem <> 'LISTEN' AND coalesce(a.callee, lower(replace(s.stem, '_', ''))) <> s.caller"""


@query("derive_expected_from_source", "SELECT * FROM {q_derived}", C)
def derive_expected_from_source(t):
    return ql.derive_expected_from_source(t.fx_sources, t.fx_stems, ["LISTEN"])


@query("unaccounted", """
    SELECT * FROM {q_derived} d WHERE NOT EXISTS (SELECT 1 FROM {fx_expected} x WHERE x.repo = d.repo AND x.src_name IN (d.src_name, '*') AND x.dst_name IN (d.dst_name, '*'))""", C)
def unaccounted(t):
    return ql.unaccounted(ql.derive_expected_from_source(t.fx_sources, t.fx_stems, ["LISTEN"]), t.fx_expected)


@query("grade_answers", r"""
    SELECT conv_id, turn, missing::INTEGER AS missing, invented::INTEGER AS invented, missing = 0 AND invented = 0 AND turn * 3 <= 6 AS passed FROM (
      SELECT conv_id, turn, (NOT (contains(lower(text), 'the') OR contains(lower(text), 'zz')))::INT + (NOT contains(lower(text), 'a'))::INT AS missing,
        regexp_matches(text, '(?i)(^|[^\w-])(is|c\+\+)($|[^\w-])')::INT + regexp_matches(text, '(?i)(^|[^\w-])sqs($|[^\w-])')::INT AS invented FROM conversations)""")
def grade_answers(t):
    a = t.conversations.select(
        "conv_id", "turn", F.col("text").alias("answer"), F.array(F.lit("The| zz "), F.lit("a")).alias("must_mention"),
        F.array(F.lit("is|c++|"), F.lit("sqs")).alias("must_not_mention"), (F.col("turn") * 3).alias("calls"), F.lit(6).alias("max_calls"))
    return ql.grade_answers(a).select("conv_id", "turn", "missing", "invented", "passed")
