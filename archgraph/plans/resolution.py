"""Registered queries: identity, matching, aliases, synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from archgraph.operators import aliases as al
from archgraph.operators import match, nodes as nd
from archgraph.plans import duck as D
from archgraph.plans.registry import query

_I = D.image("image")

P = dict(D.hints("fx_env"))
P["dk_selected"] = """
    SELECT a.*, array_to_string(list_sort(string_split(a.selector, ';')), ',') AS entries,
           count(n.id) AS n, min(n.id) AS lo
    FROM {fx_aliases} a LEFT JOIN {fx_nodes} n ON n.repo = a.repo AND n.project = a.project AND n.namespace = a.namespace
         AND n.labels IS NOT NULL AND list_has_all(string_split(n.labels, ';'), string_split(a.selector, ';'))
    WHERE a.external IS NULL AND a.selector <> '' GROUP BY ALL"""
P["dk_names"] = f"""
    SELECT DISTINCT repo, id AS node_id, kind, namespace, project, lower(x) AS form FROM (
      SELECT *, unnest([name, string_split(regexp_replace(id, '^[a-z]+:(@[^/]*/)?', ''), '/')[-1],
                        CASE WHEN image IS NOT NULL THEN {_I['name']} END,
                        CASE WHEN kind = 'external' THEN name END]) AS x FROM {{fx_nodes}}) u WHERE x IS NOT NULL"""
P["dk_named"] = """
    WITH c AS (SELECT a.repo, a.alias_key, n.node_id, n.namespace = a.namespace AS near
               FROM {fx_aliases} a JOIN {dk_names} n ON n.repo = a.repo AND n.form = lower(a.target_name)
                    AND (n.kind = 'external' OR n.project = a.project)
               WHERE a.external IS NULL AND a.selector = ''),
    k AS (SELECT *, bool_or(coalesce(near, false)) OVER (PARTITION BY repo, alias_key) AS has_near FROM c),
    f AS (SELECT repo, alias_key, count(DISTINCT node_id) AS n, min(node_id) AS lo FROM k WHERE near OR NOT has_near GROUP BY ALL)
    SELECT a.*, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN lo END AS node_id
    FROM {fx_aliases} a LEFT JOIN f USING (repo, alias_key)
    WHERE a.external IS NULL AND a.selector = '' AND a.target_name IS NOT NULL"""
P["dk_routes"] = """
    SELECT repo, lo AS node_id, name, namespace, port FROM {dk_selected} WHERE n = 1
    UNION SELECT repo, node_id, name, namespace, port FROM {dk_named} WHERE node_id IS NOT NULL"""
P["dk_forms"] = f"""
    WITH dns AS (SELECT repo, id AS node_id, lower(name) AS form FROM {{fx_nodes}} WHERE kind = 'external'
                 UNION SELECT repo, node_id, unnest([name, name || '.' || namespace, name || '.' || namespace || '.svc',
                       name || '.' || namespace || '.svc.cluster.local']) FROM {{dk_routes}}),
    names AS (SELECT repo, node_id, form FROM {{dk_names}} WHERE kind <> 'boundary' UNION SELECT * FROM dns),
    img AS (SELECT repo, id AS node_id, unnest([lower(image), lower({_I['repository']}), lower({_I['name']})]) AS form
            FROM {{fx_nodes}} WHERE image IS NOT NULL)
    SELECT repo, 'dns' AS form_kind, form, node_id FROM dns UNION SELECT repo, 'name', form, node_id FROM names
    UNION SELECT repo, 'norm', translate(form, '-_. ', ''), node_id FROM names UNION SELECT repo, 'image', form, node_id FROM img
    UNION SELECT repo, 'tech', framework, id FROM {{fx_nodes}} WHERE framework IS NOT NULL AND kind <> 'boundary'
    UNION SELECT repo, 'dir', directory, id FROM {{fx_nodes}} WHERE directory IS NOT NULL"""
P["dk_nodes2"] = """
    SELECT n.*, list_distinct(list_concat(CASE WHEN n.port IS NULL THEN [] ELSE [n.port] END, coalesce(r.ports, []))) AS ports
    FROM {fx_nodes} n LEFT JOIN (SELECT repo, node_id, list(DISTINCT port) AS ports FROM {dk_routes} GROUP BY ALL) r
    ON r.repo = n.repo AND r.node_id = n.id"""
P["dk_cand"] = """
    SELECT h.row_id AS hint_id, h.repo, h.from_node, h.port AS hport, h.edge, coalesce(f.namespace, '') AS from_ns,
           h.pos, r.rule_rank, r.rule, r.penalty, n.id AS node_id, n.kind = 'external' OR n.namespace = f.namespace AS is_local,
           coalesce(n.namespace, '') AS ns, n.ports, n.kind AS nk, h.form
    FROM (SELECT t.*, unnest([lower(t.token), lower(t.token), translate(lower(t.token), '-_. ', ''), lower(t.token)]) AS form,
                 unnest([0, 1, 2, 3]) AS rr
          FROM (SELECT *, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {dk_ref}) t) h
    JOIN {fx_nodes} f ON f.repo = h.repo AND f.id = h.from_node
    JOIN {dk_rules} r ON r.rule_rank = h.rr
    JOIN {dk_forms} x ON x.repo = h.repo AND x.form_kind = r.form_kind AND x.form = h.form
    JOIN {dk_nodes2} n ON n.repo = x.repo AND n.id = x.node_id
    WHERE n.id <> h.from_node AND (n.kind = 'external' OR n.project = f.project)"""
P["dk_ranked"] = """
    SELECT * FROM (
      SELECT *, 0 AS is_wide FROM {dk_cand} WHERE from_ns <> '' AND is_local
      UNION ALL SELECT *, 1 FROM {dk_cand}) c
    QUALIFY rank() OVER (PARTITION BY repo, hint_id ORDER BY pos, is_wide, rule_rank) = 1"""
P["dk_tb1"] = """SELECT *, from_ns <> '' AND ns = from_ns AS f, bool_or(from_ns <> '' AND ns = from_ns) OVER (PARTITION BY repo, hint_id) AS any_f,
    count(*) OVER (PARTITION BY repo, hint_id) AS n0 FROM {dk_ranked}"""
P["dk_tb2"] = """SELECT * EXCLUDE (f, any_f), count(*) OVER w AS n1, hport > 0 AND list_contains(ports, hport) AS f,
    bool_or(hport > 0 AND list_contains(ports, hport)) OVER w AS any_f
    FROM (SELECT * FROM {dk_tb1} WHERE f OR NOT any_f) WINDOW w AS (PARTITION BY repo, hint_id)"""
P["dk_tb3"] = """SELECT * EXCLUDE (f, any_f), count(*) OVER w AS n2, want IS NOT NULL AND nk = want AS f,
    bool_or(want IS NOT NULL AND nk = want) OVER w AS any_f
    FROM (SELECT *, CASE edge WHEN 'persists_to' THEN 'datastore' WHEN 'publishes_to' THEN 'queue' END AS want
          FROM {dk_tb2} WHERE n1 = 1 OR f OR NOT any_f) WINDOW w AS (PARTITION BY repo, hint_id)"""
P["dk_tb4"] = """SELECT *, count(*) OVER (PARTITION BY repo, hint_id) AS n3 FROM {dk_tb3} WHERE n2 = 1 OR f OR NOT any_f"""
P["dk_decided"] = """
    SELECT h.*, h.row_id AS hint_id, d.from_ns, d.n0, d.rule AS base_rule, d.is_wide,
      CASE WHEN d.n0 IS NULL THEN 'none' WHEN (d.is_wide = 0 OR d.from_ns = '') AND d.n3 = 1 THEN 'matched'
           WHEN d.n0 > 1 THEN 'ambiguous' ELSE 'out_of_scope' END AS outcome,
      d.rule || CASE WHEN (d.is_wide = 0 OR d.from_ns = '') AND d.n3 = 1 AND d.n0 > 1 THEN '+scoped' ELSE '' END AS rule,
      CASE WHEN (d.is_wide = 0 OR d.from_ns = '') AND d.n3 = 1 THEN d.node_id END AS node_id,
      CASE WHEN (d.is_wide = 0 OR d.from_ns = '') AND d.n3 = 1 THEN b.pct - d.penalty - CASE WHEN d.n0 > 1 THEN 5 ELSE 0 END END AS match_pct
    FROM {dk_ref} h JOIN {fx_nodes} f ON f.repo = h.repo AND f.id = h.from_node
    JOIN {dk_base} b ON b.kind = h.kind
    LEFT JOIN (SELECT repo, hint_id, from_ns, any_value(n0) AS n0, any_value(n3) AS n3, any_value(rule) AS rule,
                      any_value(penalty) AS penalty, any_value(is_wide) AS is_wide, min(node_id) AS node_id
               FROM {dk_tb4} GROUP BY ALL) d ON d.repo = h.repo AND d.hint_id = h.row_id"""
P["dk_masked"] = f"""SELECT row_id AS hint_id, {D.redact_value('key', 'value')} AS raw, key FROM {{fx_env}}"""


def typed(t):
    return t.table("nodes", lambda: nd.typed_nodes(t.fx_nodes))


def graph_inputs(t):
    """Nodes with alias ports, and forms with alias network names."""
    nodes = typed(t)
    aliases = al.typed_aliases(t.fx_aliases)
    routes = t.table("routes", lambda: al.attached(
        al.selector_alias_join(aliases, nodes), al.named_alias_join(aliases, nodes)))
    return (t.table("routed_nodes", lambda: al.attach_ports(nodes, routes)),
            t.table("forms", lambda: nd.identity_forms(nodes, t.table("alias_dns", lambda: nd.alias_dns(routes)))))


def decisions(t):
    nodes, forms = graph_inputs(t)
    hints = t.table("hints", lambda: match.hints_from_values(t.fx_env))
    return t.table("decisions", lambda: match.match_ladder(hints, nodes, forms)), nodes, forms


@query("identity_forms", "SELECT repo, form_kind, form, node_id FROM {dk_forms}", P)
def identity_forms(t):
    return graph_inputs(t)[1]


@query("selector_alias_join", """
    SELECT repo, alias_key, entries AS selector, n::INTEGER AS n_selected, CASE WHEN n = 1 THEN lo END AS node_id,
           CASE WHEN n = 0 THEN 'unmatched_service_selector' WHEN n > 1 THEN 'service_selects_many' END AS code
    FROM {dk_selected}""", P)
def selector_alias_join(t):
    return al.selector_alias_join(al.typed_aliases(t.fx_aliases), typed(t)).select(
        "repo", "alias_key", "selector", "n_selected", "node_id", "code")


@query("named_alias_join", "SELECT repo, alias_key, target_name, n::INTEGER AS n_targets, node_id FROM {dk_named}", P)
def named_alias_join(t):
    return al.named_alias_join(al.typed_aliases(t.fx_aliases), typed(t)).select(
        "repo", "alias_key", "target_name", "n_targets", "node_id")


@query("label_selector_match", """
    SELECT a.alias_key, a.repo, count(n.id)::INTEGER AS n_matching
    FROM {fx_aliases} a LEFT JOIN {fx_nodes} n ON n.repo = a.repo AND n.labels IS NOT NULL AND a.selector <> ''
      AND list_has_all(string_split(n.labels, ';'), string_split(a.selector, ';')) GROUP BY ALL""")
def label_selector_match(t):
    return al.selector_counts(al.typed_aliases(t.fx_aliases), typed(t)).select(
        "repo", "alias_key", F.col("n").cast("int").alias("n_matching"))


@query("match_ladder", """
    SELECT repo, hint_id, outcome, rule, node_id, match_pct::INTEGER AS match_pct, coalesce(n0, 0)::INTEGER AS n_candidates
    FROM {dk_decided}""", P)
def match_ladder(t):
    return decisions(t)[0].select("repo", "hint_id", "outcome", "rule", "node_id", "match_pct", "n_candidates")


@query("scope_locality", """
    SELECT repo, coalesce(from_ns, '') <> '' AS scoped, is_wide = 1 AND from_ns <> '' AS outside, outcome, count(*) AS n
    FROM {dk_decided} WHERE n0 IS NOT NULL GROUP BY ALL""", P)
def scope_locality(t):
    d = decisions(t)[0].where("n_candidates > 0")
    scoped = F.col("from_namespace") != ""
    return d.groupBy("repo", scoped.alias("scoped"), (scoped & F.col("reach").startswith("p|")).alias("outside"), "outcome").agg(
        F.count("*").alias("n"))


@query("tie_break", """
    SELECT repo, hint_id, outcome, rule, node_id, match_pct::INTEGER AS match_pct, n0::INTEGER AS n_candidates
    FROM {dk_decided} WHERE n0 > 1""", P)
def tie_break(t):
    return decisions(t)[0].where("n_candidates > 1").select(
        "repo", "hint_id", "outcome", "rule", "node_id", "match_pct", "n_candidates")


@query("refusal_diagnostics", """
    WITH lab AS (SELECT r.repo, r.hint_id, list_sort(list(n.name || CASE WHEN n.namespace IS NOT NULL THEN '.' || n.namespace ELSE '' END)) AS ls
                 FROM {dk_ranked} r JOIN {fx_nodes} n ON n.repo = r.repo AND n.id = r.node_id GROUP BY ALL),
    d AS (SELECT d.*, m.raw, l.ls, f.name || CASE WHEN f.namespace IS NOT NULL THEN '.' || f.namespace ELSE '' END AS from_name,
                 array_to_string(l.ls[1:8], ', ') || CASE WHEN n0 > 8 THEN ' and ' || (n0 - 8) || ' more' ELSE '' END AS listing
          FROM {dk_decided} d JOIN {dk_masked} m USING (hint_id) JOIN {fx_nodes} f ON f.repo = d.repo AND f.id = d.from_node
          LEFT JOIN lab l ON l.repo = d.repo AND l.hint_id = d.hint_id WHERE outcome <> 'matched')
    SELECT repo, hint_id, CASE WHEN outcome = 'ambiguous' THEN 'warn' ELSE 'info' END AS severity,
           CASE outcome WHEN 'none' THEN 'unresolved_reference' WHEN 'ambiguous' THEN 'ambiguous_reference' ELSE 'out_of_scope_reference' END AS code,
           path, line, CASE outcome WHEN 'none' THEN '"' || from_name || '" refers to "' || tokens[1] || '", which matches no component'
             WHEN 'ambiguous' THEN '"' || raw || '" matches ' || n0 || ' components (' || listing || ')'
             ELSE '"' || raw || '" matches only ' || listing || ' outside "' || from_ns || '"' END AS message
    FROM d WHERE outcome <> 'none' OR NOT """ + D.external_host("tokens[1]"), P)
def refusal_diagnostics(t):
    return match.refusal_diagnostics(*decisions(t))


@query("refusal_candidates", """
    SELECT DISTINCT r.repo, x.form_kind, r.form, CASE WHEN r.is_wide = 0 THEN 's|' || n.project || '|' || r.from_ns ELSE 'p|' || f.project END AS reach, c.node_id,
           c.label FROM {dk_ranked} r JOIN {dk_decided} d ON d.repo = r.repo AND d.hint_id = r.hint_id
    JOIN {dk_rules} x ON x.rule_rank = r.rule_rank
    JOIN {fx_nodes} f ON f.repo = r.repo AND f.id = r.from_node JOIN {fx_nodes} n ON n.repo = r.repo AND n.id = r.from_node
    JOIN (SELECT o.repo, o.form_kind, o.form, o.node_id, m.kind, m.project, m.namespace,
                 m.name || CASE WHEN m.namespace IS NOT NULL THEN '.' || m.namespace ELSE '' END AS label
          FROM {dk_forms} o JOIN {fx_nodes} m ON m.repo = o.repo AND m.id = o.node_id) c
      ON c.repo = r.repo AND c.form_kind = x.form_kind AND c.form = r.form
     AND (c.kind = 'external' OR (c.project = f.project AND (r.is_wide = 1 OR c.namespace = r.from_ns)))
    WHERE d.outcome IN ('ambiguous', 'out_of_scope')""", P)
def refusal_candidates(t):
    return match.refusal_candidates(*decisions(t))


P["dk_ext"] = f"""
    SELECT d.*, m.raw, m.key, d.tokens[1] AS host, row_number() OVER (PARTITION BY d.repo, d.tokens[1] ORDER BY from_node, path, line, raw, hint_id) AS rn
    FROM {{dk_decided}} d JOIN {{dk_masked}} m USING (hint_id) WHERE outcome = 'none' AND {D.external_host('d.tokens[1]')}"""


@query("external_synthesis", f"""
    SELECT repo, from_node AS src, {D.node_id("'external'", "''", 'host')} AS dst, edge AS kind, protocol, b.pct::INTEGER AS conf_pct,
           CASE WHEN rn = 1 THEN 'external_host' ELSE 'dns_exact' END AS rule, path, line,
           'env ' || key || '=' || raw || ' (resolves to ' || host || ')' AS detail FROM {{dk_ext}} e JOIN {{dk_base}} b ON b.kind = e.kind""", P)
def external_synthesis(t):
    return match.external_synthesis(decisions(t)[0])[1].drop("extractor")


@query("external_nodes", f"""
    SELECT repo, {D.node_id("'external'", "''", 'host')} AS id, 'external' AS kind, 'context' AS layer, host AS name, 'net' AS namespace,
           path, line, 80 AS conf_pct FROM {{dk_ext}} WHERE rn = 1""", P)
def external_nodes(t):
    return match.external_synthesis(decisions(t)[0])[0]


P["dk_resolved"] = """
    SELECT d.repo, d.from_node AS src, d.node_id AS dst, CASE WHEN d.edge NOT IN ('calls', 'depends_on') THEN d.edge
             WHEN n.kind = 'datastore' THEN 'persists_to' WHEN n.kind = 'queue' THEN 'publishes_to' ELSE d.edge END AS kind,
           d.protocol, d.match_pct::INTEGER AS conf_pct, d.rule, d.path, d.line,
           'env ' || m.key || '=' || m.raw || ' (resolves to ' || n.name || ')' AS detail
    FROM {dk_decided} d JOIN {dk_masked} m USING (hint_id) JOIN {fx_nodes} n ON n.repo = d.repo AND n.id = d.node_id
    WHERE outcome = 'matched'"""


@query("env_hints", """
    SELECT repo, r.row_id AS hint_id, from_node, kind, raw, array_to_string(tokens, ' ') AS tokens, port, protocol,
           edge AS suggested_edge, 'env ' || m.key || '=' || raw AS detail FROM {dk_ref} r JOIN {dk_masked} m ON m.hint_id = r.row_id""", P)
def env_hints(t):
    return match.hints_from_values(t.fx_env).select(
        "repo", "hint_id", "from_node", "kind", "raw", F.array_join("tokens", " ").alias("tokens"), "port", "protocol",
        "suggested_edge", "detail")


@query("resolved_edges", "SELECT * FROM {dk_resolved}", P)
def resolved_edges(t):
    d, nodes, _ = decisions(t)
    return match.resolved_edges(d, nodes).drop("extractor")


@query("candidate_filters", """
    SELECT repo, id, kind = 'external' OR coalesce(namespace, '') = 'ns-1' AS scope, kind = 'external' OR project = 'proj-0' AS project,
           coalesce(namespace, '') = 'ns-1' AS namespace, coalesce(port, 0) = 8001 AS port, kind = 'datastore' AS kind,
           id <> 'container:@ns-1/svc-1' AND kind <> 'boundary' AND (kind = 'external' OR project = '.') AS without_self
    FROM {fx_nodes}""")
def candidate_filters(t):
    n = typed(t)
    c = F.col
    return n.select(
        "repo", "id", match.in_scope(c("kind"), c("namespace"), F.lit("ns-1")).alias("scope"),
        match.in_project(c("kind"), c("project"), F.lit("proj-0")).alias("project"),
        match.in_namespace(c("namespace"), F.lit("ns-1")).alias("namespace"),
        match.on_port(c("ports"), F.lit(8001)).alias("port"), match.of_kind(c("kind"), F.lit("datastore")).alias("kind"),
        match.without_self(c("id"), c("kind"), c("project"), F.lit("container:@ns-1/svc-1"), F.lit(".")).alias("without_self"))
