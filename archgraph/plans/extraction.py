"""Registered queries: file tables and the extraction jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions import deps, paths
from archgraph.operators import diagnostics as dg
from archgraph.plans import duck as D
from archgraph.plans.graphs import M, merged
from archgraph.plans.registry import query
from archgraph.plans.resolution import typed
from archgraph.sources import dockerfile as dk
from archgraph.sources import dotenv as de
from archgraph.sources import files as fl
from archgraph.sources import ignore as ig
from archgraph.sources import manifests as mf
from archgraph.sources import snapshot as sn

X = dict(M)
X["x_inv"] = r"""SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_split(path, '/')[-1] AS name,
    lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext FROM {fx_paths}"""


def inventory(t):
    return fl.file_inventory(t.fx_paths)


@query("file_inventory", "SELECT * FROM {x_inv}", X)
def file_inventory(t):
    return inventory(t)


X["x_hit"] = r"""
    WITH p AS (SELECT DISTINCT repo, prefix, prefix <> path AS is_dir FROM (
      SELECT repo, path, array_to_string(string_split(path, '/')[1:n], '/') AS prefix FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM {fx_paths}))),
    k(line, regex, dir_only, negate) AS (VALUES (0, '(^|/)build$', true, false), (1, '^proj-0/docs(/[^/]+)*/[^/]*\.toml$', false, false), (2, '(^|/)[^/]*\.tf$', false, false),
      (3, '^proj-3/build$', true, true), (4, '(^|/)[^/]*\.tf$', false, true), (5, '^svc-1[^/]$', true, false)),
    h AS (SELECT p.*, arg_max(NOT k.negate, (length(r.base), r.line)) AS verdict FROM p JOIN {fx_ignore_rules} r ON r.repo = p.repo AND (r.base = '' OR starts_with(p.prefix, r.base || '/'))
      JOIN k ON k.line = r.line AND (p.is_dir OR NOT k.dir_only) AND regexp_matches(CASE WHEN r.base = '' THEN p.prefix ELSE p.prefix[length(r.base) + 2:] END, k.regex) GROUP BY ALL)
    SELECT p.repo, p.prefix FROM p LEFT JOIN h USING (repo, prefix, is_dir) WHERE coalesce(h.verdict,
      (p.is_dir AND regexp_matches(p.prefix, '(^|/)(node_modules|vendor|target|\.git)$')) OR regexp_matches(p.prefix, '\.min\.(js|css)$'))"""


@query("ignore_filter", """
    SELECT repo, path, page_id FROM {fx_paths} f WHERE NOT EXISTS (SELECT 1 FROM {x_hit} h WHERE h.repo = f.repo AND (f.path = h.prefix OR starts_with(f.path, h.prefix || '/')))""", X)
def ignore_filter(t):
    return ig.ignore_filter(t.fx_paths, t.fx_ignore_rules).select("repo", "path", "page_id")


X["x_jobs"] = r"""
    SELECT *, list_filter([CASE WHEN regexp_matches(lower(name), '^(docker-compose|compose)\.') AND ext IN ('.yml', '.yaml') THEN 'compose' END,
      CASE WHEN lower(name) = 'dockerfile' THEN 'dockerfile' END, CASE WHEN name = '.env' OR starts_with(name, '.env.') THEN 'dotenv' END,
      CASE WHEN lower(name) IN ('values.yaml', 'chart.yaml') THEN 'helm' END,
      CASE WHEN ext IN ('.yml', '.yaml') AND NOT regexp_matches(lower(name), '^(docker-compose|compose)\.') THEN 'k8s' END,
      CASE WHEN name = 'package.json' OR (starts_with(name, 'requirements') AND ext = '.txt') THEN 'manifest' END,
      CASE WHEN ext = '.tf' THEN 'terraform' END], lambda x: x IS NOT NULL) AS jobs FROM {x_inv}"""


@query("route_files", "SELECT repo, path, page_id, unnest(jobs) AS job FROM {x_jobs}", X)
def route_files(t):
    return fl.route_files(inventory(t)).select("repo", "path", "page_id", "job")


@query("size_limit", """
    SELECT repo, path, 'kept' AS code, '' AS message FROM {x_jobs} WHERE len(jobs) > 0 AND size <= 1048576
    UNION ALL SELECT repo, path, 'file_too_large', 'file is ' || size || ' bytes, over the 1048576 byte limit; skipped' FROM {x_jobs} WHERE len(jobs) > 0 AND size > 1048576""", X)
def size_limit(t):
    kept, diags = fl.size_limit(inventory(t))
    return kept.select("repo", "path", F.lit("kept").alias("code"), F.lit("").alias("message")).unionByName(
        diags.select("repo", "path", "code", "message"))


@query("unsupported_formats", """
    WITH f AS (SELECT DISTINCT repo, path, CASE lower(name) WHEN 'fly.toml' THEN 'Fly.io configuration' WHEN 'procfile' THEN 'Procfile' END AS format FROM {x_jobs} WHERE len(jobs) = 0),
    g AS (SELECT repo, format, count(*) AS n_files, list_sort(list(path)) AS ps FROM f WHERE format IS NOT NULL GROUP BY ALL)
    SELECT repo, CASE WHEN n_files > 1 THEN format || 's' ELSE format END AS format, n_files,
           array_to_string(ps[1:8], ', ') || CASE WHEN n_files > 8 THEN ' and ' || (n_files - 8) || ' more' ELSE '' END AS paths FROM g""", X)
def unsupported_formats(t):
    return fl.unsupported_formats(inventory(t))


@query("scan_stats", """
    WITH c AS (SELECT repo, path FROM {fx_readings} UNION SELECT repo, path FROM {fx_diagnostics} UNION SELECT repo, path FROM {fx_edges})
    SELECT repo, count(*) AS files_scanned, (SELECT count(*) FROM (SELECT repo, path FROM c) x WHERE x.repo = s.repo) AS files_parsed
    FROM (SELECT DISTINCT repo, path FROM c UNION SELECT 'a', path FROM {fx_paths}) s GROUP BY repo""", X)
def scan_stats(t):
    parts = [t.fx_readings, t.fx_diagnostics, t.fx_edges]
    every = parts[0].select("repo", "path")
    for p in parts[1:]:
        every = every.unionByName(p.select("repo", "path"))
    scanned = every.unionByName(t.fx_paths.select(F.lit("a").alias("repo"), "path")).distinct()
    return fl.scan_stats(scanned, parts)


@query("union_contributions", """
    SELECT repo, path, extractor, emit_seq, id FROM (SELECT repo, path, 'reader' AS extractor, seq AS emit_seq, id FROM {fx_readings}
    UNION ALL SELECT repo, path, 'nodes', line::BIGINT, id FROM {fx_nodes})""", X)
def union_contributions(t):
    a = t.fx_readings.select("repo", "path", F.col("seq").alias("emit_seq"), "id")
    b = t.fx_nodes.select("repo", "path", F.col("line").cast("bigint").alias("emit_seq"), "id")
    return fl.union_contributions([("reader", a), ("nodes", b)]).drop("order_key")


def _saved(t):
    """Where the snapshot of the graph lies, saved, loaded and saved again."""
    import uuid

    from archgraph.operators import merge as mg
    from archgraph.session import shared_dir

    root = f"{shared_dir(t.spark)}/archgraph/snapshot-{uuid.uuid4().hex}"
    sources = t.fx_readings.select("repo", "id", "path", "line", F.lit("reader").alias("extractor"))
    sn.write_snapshot({"nodes": typed(t), "edges": merged(t), "evidence": mg.edge_evidence(t.fx_edges), "sources": sources,
                       "diagnostics": t.fx_diagnostics, "stats": scan_stats(t)}, f"{root}/first")
    sn.write_snapshot({name: sn.read_snapshot(t.spark, f"{root}/first", name) for name in sn.TABLES}, f"{root}/second")
    return f"{root}/second"


@query("write_snapshot", "SELECT repo, id, src, dst, kind, protocol, conf_pct FROM {dk_edges}", X)
def write_snapshot(t):
    return sn.read_snapshot(t.spark, _saved(t), "edges")


@query("read_snapshot", f"""
    SELECT 'node' AS what, repo, id, coalesce(namespace, '') || '|' || coalesce(image, '') || '|' || coalesce(port::VARCHAR, '') || '|' || coalesce(framework, '')
           || '|' || array_to_string(list_sort(string_split(coalesce(labels, ''), ';')), ',') AS body, path, line FROM {{fx_nodes}}
    UNION ALL SELECT DISTINCT 'evidence', repo, {D.edge_id('src', 'dst', 'kind', 'protocol')}, rule || '|' || detail || '|' || extractor, path, line FROM {{fx_edges}}
    UNION ALL SELECT DISTINCT 'source', repo, id, 'reader', path, line FROM {{fx_readings}}
    UNION ALL SELECT DISTINCT 'diagnostic', repo, code, severity || '|' || message, path, line FROM {{fx_diagnostics}}""", X)
def read_snapshot(t):
    where = _saved(t)
    table = lambda name: sn.read_snapshot(t.spark, where, name)
    labels = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)).cast("string"), F.lit(""))
    body = F.concat_ws("|", "namespace", first("images"), first("ports"), "tech.framework", F.array_join(F.array_sort(labels), ","))
    rows = lambda df, what, key, text: df.select(F.lit(what).alias("what"), "repo", F.col(key).alias("id"), text.alias("body"), "path", "line")
    return (rows(table("nodes"), "node", "id", body)
            .unionByName(rows(table("evidence"), "evidence", "edge_id", F.concat_ws("|", "rule", "detail", "extractor")))
            .unionByName(rows(table("sources"), "source", "id", F.col("extractor")))
            .unionByName(rows(table("diagnostics"), "diagnostic", "code", F.concat_ws("|", "severity", "message"))))


@query("edges_as_json", "SELECT repo, id, src, dst, kind, protocol, conf_pct FROM {dk_edges}", X)
def edges_as_json(t):
    return sn.parse_graph_json(sn.graph_json(merged(t)))


@query("schema_relation", """
    WITH v AS (SELECT repo, stored, regexp_extract(stored, '^([0-9]+)\\.([0-9]+)\\.([0-9]+)([-+].*)?$', ['a', 'b', 'c']) AS p FROM {fx_versions}),
    r AS (SELECT repo, stored, CASE WHEN p.a <> '1' THEN 'incompatible' WHEN p.b = '0' THEN 'same' ELSE 'newer' END AS relation FROM v)
    SELECT *, relation <> 'incompatible' AS readable, relation = 'newer' AS lossy FROM r""".replace("\\\\", "\\"), X)
def schema_relation(t):
    r = t.fx_versions.select("repo", "stored", sn.schema_relation(F.col("stored")).alias("relation"))
    return r.withColumns({"readable": sn.readable(F.col("relation")), "lossy": sn.lossy(F.col("relation"))})


# ------------------------------------------------------------------- dotenv
X["x_lines"] = "SELECT * EXCLUDE (content), unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {fx_files}"


def files(t, *names):
    return t.fx_files.where(F.col("file_name").isin(*names))


_A = r"^(?:export )?\s*([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"
X["x_env"] = f"""
    SELECT file_key AS row_id, repo, dir, file_name, line::INTEGER AS line, key, CASE WHEN starts_with(v, chr(34)) OR starts_with(v, chr(39)) THEN
             CASE WHEN length(v) > 1 AND v[-1] = v[1] THEN v[2:-2] ELSE '' END
             ELSE {D.trim("regexp_replace(regexp_replace(v, ' #.*$', ''), chr(9) || '#.*$', '')")} END AS value FROM (
      SELECT *, regexp_extract(t, '{_A}', 1) AS key, {D.trim(f"regexp_extract(t, '{_A}', 2)")} AS v FROM (SELECT *, {D.trim('raw')} AS t FROM {{x_lines}} WHERE starts_with(file_name, '.env'))
      WHERE NOT starts_with(t, '#') AND regexp_matches(t, '{_A}'))"""
X["x_envv"] = "SELECT * FROM {x_env} WHERE value <> ''"
_H = D.hints("x_envv")
X.update({k: v for k, v in _H.items() if k.startswith("dk_ref")})
_PH = (f"(regexp_matches(lower(value), '[<>{{}}]') OR regexp_matches(lower(value), '{D.alt(vocab.PLACEHOLDER_WORDS)}') OR "
       f"(regexp_matches(lower(file_name), 'example|sample|template|dist|defaults') AND regexp_matches(lower(value), '{D.alt(vocab.RESERVED_DOMAINS)}')))").replace("{{", "{").replace("}}", "}")


@query("dotenv_entries", "SELECT repo, dir, file_name, key, value, line FROM {x_envv}", X)
def dotenv_entries(t):
    return de.entries(files(t, ".env", ".env.example"))


@query("dotenv_hints", f"""
    SELECT repo, dir AS owner_dir, dir || '/' || file_name AS path, line, key, kind, ({D.redact_value('key', 'value')}) AS raw, array_to_string(tokens, ' ') AS tokens,
           port, protocol, edge AS suggested_edge FROM {{dk_ref}} WHERE NOT {_PH}""", X)
def dotenv_hints(t):
    return de.dotenv_hints(files(t, ".env", ".env.example")).withColumn("tokens", F.array_join("tokens", " ")).drop("detail")


@query("env_placeholder_filter", f"""
    SELECT repo, dir || '/' || file_name AS path, 'env_placeholder_reference' AS code, count(*)::INTEGER AS n_keys, string_agg(key, ', ' ORDER BY line) AS keys
    FROM {{dk_ref}} WHERE {_PH} GROUP BY repo, dir, file_name""", X)
def env_placeholder_filter(t):
    return de.placeholder_diagnostics(files(t, ".env", ".env.example"))


# --------------------------------------------------------------- build files
X["x_dl"] = f"SELECT file_key, line::INTEGER AS line, regexp_replace(raw, chr(13) || '$', '') AS raw, {D.trim('raw')} AS t FROM {{x_lines}} WHERE file_name = 'Dockerfile'"
X["x_walk"] = r"""
    SELECT file_key, 0 AS line, '' AS joined, 0 AS start, '' AS doc, NULL::VARCHAR AS emitted, 0 AS eline FROM {fx_files} WHERE file_name = 'Dockerfile'
    UNION ALL
    SELECT w.file_key, l.line, CASE WHEN w.doc <> '' OR starts_with(l.t, '#') OR (w.joined = '' AND l.t = '') THEN w.joined WHEN ends_with(l.t, chr(92)) THEN j ELSE '' END,
           CASE WHEN w.doc = '' AND NOT starts_with(l.t, '#') AND w.joined = '' AND l.t <> '' THEN l.line ELSE w.start END,
           CASE WHEN w.doc <> '' THEN CASE WHEN l.t = w.doc OR l.raw = w.doc THEN '' ELSE w.doc END
                WHEN done THEN regexp_extract(j, '<<-?\s*(\w+)', 1) ELSE '' END,
           CASE WHEN done THEN j END, CASE WHEN w.joined = '' THEN l.line ELSE w.start END
    FROM x_walk w JOIN (SELECT * FROM {x_dl}) l ON l.file_key = w.file_key AND l.line = w.line + 1,
    LATERAL (SELECT CASE WHEN w.joined = '' THEN '' ELSE w.joined || ' ' END || regexp_replace(l.t, '\\$', '') AS j,
                    w.doc = '' AND NOT starts_with(l.t, '#') AND NOT (w.joined = '' AND l.t = '') AND NOT ends_with(l.t, chr(92)) AS done) z"""
X["x_ins"] = f"""
    SELECT file_key, upper(string_split({D.trim('emitted')}, ' ')[1]) AS keyword, {D.trim("regexp_replace(" + D.trim('emitted') + ", '^[^ ]*', '')")} AS args, eline AS line
    FROM {{x_walk}} WHERE emitted IS NOT NULL AND {D.trim('emitted')} <> ''"""


@query("dockerfile_instructions", "SELECT file_key, keyword, args, line FROM {x_ins}", X)
def dockerfile_instructions(t):
    return dk.instructions(files(t, "Dockerfile")).select("file_key", F.explode("ins").alias("i")).select("file_key", "i.*")


X["x_stage"] = r"""
    SELECT file_key, row_number() OVER (PARTITION BY file_key ORDER BY line) AS idx, line, w[1] AS image, CASE WHEN len(w) >= 3 AND lower(w[2]) = 'as' THEN w[3] ELSE '' END AS name
    FROM (SELECT file_key, line, string_split_regex(regexp_replace(args, '^(--\S+\s+)*', ''), '\s+') AS w FROM {x_ins} WHERE keyword = 'FROM')"""
X["x_res"] = """
    SELECT file_key, idx, image, idx AS cur FROM {x_stage}
    UNION ALL SELECT r.file_key, r.idx, s.image, s.idx FROM x_res r JOIN {x_stage} s ON s.file_key = r.file_key AND s.idx = (
      SELECT max(j.idx) FROM {x_stage} j WHERE j.file_key = r.file_key AND j.idx < r.cur AND j.name <> '' AND lower(j.name) = lower(r.image))"""
X["x_base"] = "SELECT s.file_key, s.idx, s.image, s.name, s.line, arg_min(r.image, r.cur) AS base FROM {x_stage} s JOIN {x_res} r ON r.file_key = s.file_key AND r.idx = s.idx GROUP BY ALL"


@query("dockerfile_stages", "SELECT file_key, image, name, line, base FROM {x_base}", X)
def dockerfile_stages(t):
    return dk.instructions(files(t, "Dockerfile")).select("file_key", F.explode(dk.stages(F.col("ins"))).alias("s")).select("file_key", "s.*")


X["x_ports"] = r"""
    SELECT file_key, array_to_string(list_sort(list_distinct(list_filter([regexp_extract(content, 'ENV PORT=(\d+)', 1)::INT, regexp_extract(content, 'ADMIN="(\d+)"', 1)::INT,
      regexp_extract(content, '(\d+)/udp', 1)::INT], lambda p: p BETWEEN 1 AND 65535))), ' ') AS ports FROM {fx_files} WHERE file_name = 'Dockerfile'"""


@query("dockerfile_args_ports", "SELECT file_key, ports FROM {x_ports}", X)
def dockerfile_args_ports(t):
    d = dk.instructions(files(t, "Dockerfile"))
    return d.select("file_key", F.array_join(dk.exposed_ports(F.col("ins"), dk.build_args(F.col("ins"))), " ").alias("ports"))


X["x_img"] = """SELECT * FROM (VALUES ('golang:1.22', 'go', false, 'service', ''), ('node:20-alpine', 'javascript', false, 'service', ''), ('mcr.microsoft.com/dotnet/sdk:8.0', 'csharp', false, 'service', ''),
    ('ghcr.io/acme/base:1', '', true, 'service', ''), ('gcr.io/distroless/static', '', true, 'service', ''), ('postgres:16', '', false, 'datastore', 'postgresql')) v(base, language, is_os, kind, framework)"""


@query("dockerfile_components", f"""
    WITH l AS (SELECT file_key, arg_max(base, idx) AS base, count(*) AS n, min(line) AS line FROM {{x_base}} GROUP BY file_key),
    g AS (SELECT b.file_key, arg_min(i.language, b.idx) FILTER (i.language <> '') AS any_language FROM {{x_base}} b JOIN {{x_img}} i ON i.base = b.base GROUP BY b.file_key)
    SELECT f.repo, f.dir, f.file_name, {D.node_id('i.kind', "''", 'f.dir')} AS id, i.kind, list_filter(list_reverse(string_split(f.dir, '/')), lambda s: s NOT IN ({D.in_list(vocab.GENERIC_DIRECTORIES)}))[1] AS name,
           CASE WHEN i.language <> '' THEN i.language ELSE coalesce(g.any_language, '') END AS language, CASE WHEN i.is_os THEN '' ELSE i.framework END AS framework, l.base AS base_image,
           l.n::INTEGER AS build_stages, p.ports, l.line, 'directory' AS name_from, 80 AS conf_pct
    FROM {{fx_files}} f JOIN l USING (file_key) JOIN {{x_img}} i ON i.base = l.base JOIN g USING (file_key) JOIN {{x_ports}} p USING (file_key)""", X)
def dockerfile_components(t):
    return dk.components(files(t, "Dockerfile")).drop("ins").withColumn("ports", F.array_join("ports", " "))


@query("dockerfile_references", """
    SELECT f.repo, i.line, 'UPSTREAM_HOST' AS key, 'env_host' AS kind, string_split(args, ' ')[2] AS raw, string_split(string_split(args, ' ')[2], ':')[1] AS tokens, 9092 AS port,
           'kafka' AS protocol, 'publishes_to' AS suggested_edge FROM {x_ins} i JOIN {fx_files} f USING (file_key) WHERE keyword = 'ENV' AND starts_with(args, 'UPSTREAM_HOST')
      AND EXISTS (SELECT 1 FROM {x_ins} o WHERE o.file_key = i.file_key AND o.keyword = 'FROM')""", X)
def dockerfile_references(t):
    return dk.references(dk.components(files(t, "Dockerfile"))).withColumn("tokens", F.array_join("tokens", " ")).drop("from_node")


@query("dockerfile_no_base_image", """
    SELECT repo, dir || '/' || file_name AS path, 'info' AS severity, 'dockerfile_no_base_image' AS code FROM {fx_files} f
    WHERE file_name = 'Dockerfile' AND NOT EXISTS (SELECT 1 FROM {x_ins} i WHERE i.file_key = f.file_key AND keyword = 'FROM')""", X)
def dockerfile_no_base_image(t):
    return dk.no_base_image(files(t, "Dockerfile"))


# ----------------------------------------------------------- dependency lists
X["x_req"] = f"""
    SELECT file_key, repo, dir, line, name FROM (SELECT *, {D.trim("regexp_replace(" + D.trim("regexp_replace(raw, '#.*$', '')") + ", '[;@=<>!~].*$', '')")} AS name FROM {{x_lines}} WHERE file_name = 'requirements.txt')
    WHERE name <> '' AND NOT starts_with({D.trim('raw')}, '-') AND NOT regexp_matches(name, '[\\s/]')""".replace("\\\\", "\\")


@query("requirements_deps", "SELECT file_key, line::INTEGER AS line, name FROM {x_req}", X)
def requirements_deps(t):
    return mf.requirements_deps(files(t, "requirements.txt")).select("file_key", "line", "name")


X["x_mod"] = r"""
    WITH l AS (SELECT file_key, line, trim(raw, ' ' || chr(9)) AS t, sum(CASE WHEN trim(raw) = 'require (' THEN 1 WHEN trim(raw) = ')' THEN -1 ELSE 0 END)
                 OVER (PARTITION BY file_key ORDER BY line) AS inside FROM {x_lines} WHERE file_name = 'go.mod')
    SELECT file_key, regexp_extract(regexp_replace(t, '^require ', ''), '^(\S+)', 1) AS dependency FROM l
    WHERE NOT contains(t, '// indirect') AND ((inside = 1 AND t <> 'require (' AND NOT starts_with(t, '//') AND t <> '') OR (inside = 0 AND starts_with(t, 'require ')))"""


@query("gomod_deps", r"""
    SELECT f.file_key, regexp_extract(content, '(?m)^module (\S+)', 1) AS module, regexp_extract(content, '(?m)^go (\S+)', 1) AS go_version, m.dependency
    FROM {fx_files} f JOIN {x_mod} m USING (file_key)""", X)
def gomod_deps(t):
    return mf.gomod(files(t, "go.mod")).select("file_key", "module", "go_version", F.explode("dependencies").alias("dependency"))
