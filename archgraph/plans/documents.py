"""Registered queries: JSON manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.operators import joins as jn
from archgraph.plans import duck as D
from archgraph.plans.extraction import X
from archgraph.plans.registry import query
from archgraph.sources import charts as ch
from archgraph.sources import compose as cp
from archgraph.sources import k8s
from archgraph.sources import manifests as mf
from archgraph.sources import resources as rs

J = dict(X)
J["j_docs"] = "SELECT *, CASE WHEN json_valid(doc) THEN doc ELSE '{}' END::JSON AS j FROM {fx_manifests}"


def docs(t, fmt):
    return t.fx_manifests.where(F.col("format") == fmt)


def s(path, of="j"):
    return f"json_extract_string({of}, '$.{path}')"


def image_kinds(name, images):
    """Piece: (key, kind, tech) of image references, by the variants rule."""
    part = D.image("ref")
    J[name] = f"""
        SELECT ref, arg_min(i.kind, pos) AS kind, arg_min(i.tech, pos) AS tech FROM (
          SELECT ref, unnest(vs) AS name, generate_subscripts(vs, 1) AS pos FROM (SELECT ref, {D.variants(part['name'])} AS vs FROM (SELECT DISTINCT ref FROM ({images})) r)) v
        JOIN {{dk_images}} i USING (name) GROUP BY ref"""


# --------------------------------------------------------------- package files
J["j_pkg"] = f"""
    SELECT repo, path, {s('name')} AS name, {s('version')} AS version, {s('engines.node')} AS runtime_version,
           CASE WHEN list_contains(json_keys(j, '$.dependencies'), 'typescript') OR list_contains(json_keys(j, '$.devDependencies'), 'typescript') THEN 'typescript' ELSE 'javascript' END AS language,
           list_sort(json_keys(j, '$.dependencies')) AS deps FROM {{j_docs}} WHERE format = 'package' AND {s('name')} <> ''"""
J["j_py"] = f"""
    SELECT repo, path, coalesce({s('project.name')}, {s('tool.poetry.name')}) AS name, CASE WHEN {s('project.name')} IS NOT NULL THEN {s('project.version')} END AS version,
           {s('project.requires-python')} AS runtime_version, 'python' AS language,
           list_sort(CASE WHEN {s('project.name')} IS NOT NULL THEN list_transform(json_extract_string(j, '$.project.dependencies[*]'), lambda d: CASE WHEN contains(d, ' ') THEN '' ELSE regexp_replace(d, '[=<>!~;@].*$', '') END)
             ELSE list_filter(json_keys(j, '$.tool.poetry.dependencies'), lambda k: k <> 'python') END) AS deps FROM {{j_docs}} WHERE format = 'pyproject'"""
J["j_man"] = "SELECT * FROM {j_pkg} UNION ALL SELECT * FROM {j_py}"


def _listed(df):
    return df.withColumn("dependencies", F.array_join("dependencies", " "))


@query("package_json_deps", "SELECT * EXCLUDE (deps), array_to_string(deps, ' ') AS dependencies FROM {j_pkg}", J)
def package_json_deps(t):
    return _listed(mf.package_json(docs(t, "package")))


@query("pyproject_deps", "SELECT * EXCLUDE (deps), array_to_string(deps, ' ') AS dependencies FROM {j_py}", J)
def pyproject_deps(t):
    return _listed(mf.pyproject(docs(t, "pyproject")))


def manifests(t):
    return mf.package_json(docs(t, "package")).unionByName(mf.pyproject(docs(t, "pyproject")))


J["j_code"] = """
    SELECT repo, path, 'container:' || regexp_replace(path, '/[^/]*$', '') AS id, name, regexp_replace(path, '/[^/]*$', '') AS directory, language,
           coalesce(CASE WHEN list_contains(deps, '@nestjs/core') THEN 'nestjs' WHEN list_contains(deps, 'express') THEN 'express' WHEN list_contains(deps, 'Django') THEN 'django'
             WHEN list_contains(deps, 'fastapi') THEN 'fastapi' END, '') AS framework, len(deps)::INTEGER AS dependency_count, 80 AS conf_pct FROM {j_man}"""


@query("codebase_components", "SELECT * FROM {j_code}", J)
def codebase_components(t):
    return mf.codebase_components(manifests(t))


@query("manifest_aliases", """
    SELECT DISTINCT repo, name AS target_name, unnest([string_split(directory, '/')[-1], string_split(name, '/')[-1]]) AS name FROM {j_code}""", J)
def manifest_aliases(t):
    return mf.manifest_aliases(mf.codebase_components(manifests(t))).distinct()


@query("job_error_rows", """
    SELECT repo, path, 'warn' AS severity, CASE format WHEN 'workload' THEN 'k8s_parse_failed' WHEN 'compose' THEN 'compose_parse_failed' WHEN 'package' THEN 'manifest_parse_failed' END AS code,
           'could not read this document' AS message FROM {fx_manifests} WHERE NOT json_valid(doc)""", J)
def job_error_rows(t):
    return mf.unreadable(t.fx_manifests, {
        "workload": "k8s_parse_failed", "service": "k8s_parse_failed", "configmap": "k8s_parse_failed", "ingress": "k8s_parse_failed",
        "compose": "compose_parse_failed", "package": "manifest_parse_failed", "pyproject": "manifest_parse_failed",
        "chart": "helm_chart_parse_failed", "values": "helm_values_parse_failed"})


# ------------------------------------------------------------ cluster objects
def objects(t, fmt):
    return k8s.objects(docs(t, fmt))


_TPL = "coalesce(json_extract(j, '$.spec.template'), json_extract(j, '$.spec.jobTemplate.spec.template'))"
J["j_wl"] = f"""
    SELECT repo, path, k, {s('kind')} AS workload, {s('metadata.name')} AS name, coalesce({s('metadata.namespace')}, 'default') AS namespace, {_TPL} AS tpl, j
    FROM {{j_docs}} WHERE format = 'workload' AND {s('kind')} <> ''"""
image_kinds("j_kinds", "SELECT unnest(list_concat(json_extract_string(tpl, '$.spec.initContainers[*].image'), json_extract_string(tpl, '$.spec.containers[*].image'))) AS ref FROM {j_wl}")
J["j_best"] = """
    SELECT path, coalesce(arg_min(kind, pos) FILTER (kind IN ('datastore', 'queue')), arg_min(kind, pos) FILTER (kind <> 'service'), 'service') AS kind,
           coalesce(arg_min(tech, pos) FILTER (kind IN ('datastore', 'queue')), arg_min(tech, pos) FILTER (kind <> 'service'), '') AS framework,
           array_to_string(list_sort(list(DISTINCT ref)), ' ') AS images FROM (
      SELECT path, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM (SELECT path, list_concat(json_extract_string(tpl, '$.spec.initContainers[*].image'), json_extract_string(tpl, '$.spec.containers[*].image')) AS refs FROM {j_wl} WHERE tpl IS NOT NULL))
    LEFT JOIN {j_kinds} USING (ref) GROUP BY path"""
_NS = "CASE WHEN namespace = 'default' THEN '' ELSE '@' || namespace || '/' END"
J["j_work"] = f"""
    SELECT w.repo, w.path, 'container:' || {_NS} || w.name AS id, b.kind, w.name, w.namespace, w.workload, b.framework, b.images,
           array_to_string(list_sort(json_extract_string(tpl, '$.spec.containers[0].ports[*].containerPort')), ' ') AS ports, {s('spec.replicas', 'w.j')}::INTEGER AS replicas, {s('spec.schedule', 'w.j')} AS schedule,
           'app=' || {s('metadata.labels.app', 'tpl')} || ';tier=' || {s('metadata.labels.tier', 'tpl')} AS labels, {s('spec.serviceAccountName', 'tpl')} AS service_account, 100 AS conf_pct, w.tpl
    FROM {{j_wl}} w JOIN {{j_best}} b USING (path)"""


@query("k8s_workloads", "SELECT * EXCLUDE (tpl) FROM {j_work}", J)
def k8s_workloads(t):
    w = k8s.workloads(objects(t, "workload"))
    return w.withColumns({"images": F.array_join("images", " "), "ports": F.array_join("ports", " "), "labels": F.array_join(F.array_sort(F.transform(
        F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")})


@query("k8s_patch_fragments", """
    SELECT repo, path, 'info' AS severity, 'k8s_patch_fragment' AS code, workload || ' "' || name || '"' AS subject FROM {j_wl} WHERE tpl IS NULL""", J)
def k8s_patch_fragments(t):
    return k8s.patch_fragments(objects(t, "workload"))


_BND = "'context:' || CASE WHEN namespace = 'default' THEN '' ELSE '@' || namespace || '/' END || namespace"


@query("k8s_namespace_members", f"""
    SELECT DISTINCT repo, {_BND} AS src, '' AS dst, 'boundary' AS kind, namespace AS detail FROM {{j_work}}
    UNION ALL SELECT DISTINCT repo, {_BND}, id, 'contains', path FROM {{j_work}}""", J)
def k8s_namespace_members(t):
    nodes, edges = k8s.namespace_members(k8s.workloads(objects(t, "workload")))
    return nodes.select("repo", F.col("id").alias("src"), F.lit("").alias("dst"), "kind", F.col("name").alias("detail")).unionByName(
        edges.select("repo", "src", "dst", "kind", F.col("path").alias("detail")))


_DNS = "name || '.' || namespace || '.svc.cluster.local ' || name || '.' || namespace || '.svc ' || name || '.' || namespace || ' ' || name"


@query("k8s_service_aliases", f"""
    SELECT repo, path, name, namespace, {_DNS} AS dns, ports, selector, target_name, external FROM (
      SELECT repo, path, {s('metadata.name')} AS name, {s('metadata.namespace')} AS namespace,
             array_to_string(list_sort(list_transform(json_extract_string(j, '$.spec.ports[*].port'), lambda p: p::INTEGER)), ' ') AS ports,
             coalesce('app=' || {s('spec.selector.app')}, '') AS selector, NULL AS target_name, {s('spec.externalName')} AS external
      FROM {{j_docs}} WHERE format = 'service'
      UNION ALL SELECT repo, path, {s('spec.serviceName')}, namespace, '', '', name, NULL FROM {{j_wl}} WHERE {s('spec.serviceName')} IS NOT NULL)""", J)
def k8s_service_aliases(t):
    a = k8s.service_aliases(k8s.objects(t.fx_manifests.where("format IN ('service', 'workload')")))
    return a.withColumns({"dns": F.array_join("dns", " "), "ports": F.array_join("ports", " "), "selector": F.coalesce(F.array_join(F.transform(
        F.map_entries("selector"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"), F.lit(""))})


@query("services_without_selector", f"""
    SELECT repo, path, 'k8s_service_without_selector' AS code, {s('metadata.name')} AS name FROM {{j_docs}}
    WHERE format = 'service' AND {s('spec.selector.app')} IS NULL AND {s('spec.externalName')} IS NULL""", J)
def services_without_selector(t):
    return k8s.services_without_selector(k8s.service_aliases(objects(t, "service")))


J["j_ing"] = f"""SELECT repo, path, k, {s('metadata.name')} AS name, {s('metadata.namespace')} AS namespace, j FROM {{j_docs}} WHERE format = 'ingress'"""


@query("ingress_nodes", f"""
    SELECT repo, path, 'container:@' || namespace || '/' || name AS id, name, namespace, {s('spec.ingressClassName')} AS ingress_class,
           array_to_string(list_sort(list_distinct(list_concat(json_extract_string(j, '$.spec.rules[*].host'), json_extract_string(j, '$.spec.tls[*].hosts[*]')))), ' ') AS hosts, true AS tls FROM {{j_ing}}""", J)
def ingress_nodes(t):
    return k8s.ingresses(objects(t, "ingress")).drop("spec").withColumn("hosts", F.array_join("hosts", " "))


@query("ingress_routes", f"""
    WITH b AS (SELECT *, {s('spec.defaultBackend.service.name')} AS raw, 80 AS port, 'the default route' AS route FROM {{j_ing}} WHERE {s('spec.defaultBackend.service.name')} IS NOT NULL
      UNION ALL SELECT *, {s('spec.rules[0].http.paths[0].backend.service.name')}, {s('spec.rules[0].http.paths[0].backend.service.port.number')}::INTEGER, {s('spec.rules[0].host')} || '/a' FROM {{j_ing}}
      UNION ALL SELECT *, {s('spec.rules[0].http.paths[1].backend.serviceName')}, 0, {s('spec.rules[0].host')} FROM {{j_ing}})
    SELECT repo, path, 'container:@' || namespace || '/' || name AS from_node, 'selector' AS kind, raw,
           {_DNS.replace('name ||', 'raw ||').replace("' ' || name", "' ' || raw")} AS tokens, port, 'http' AS protocol, 'exposes' AS suggested_edge, route FROM b""", J)
def ingress_routes(t):
    return k8s.ingress_routes(objects(t, "ingress")).withColumn("tokens", F.array_join("tokens", " "))


J["j_cfg"] = f"""SELECT *, 'configmap:' || coalesce({s('metadata.namespace')}, 'default') || '/' || {s('metadata.name')} AS ref, {s('metadata.name')} AS name FROM {{j_docs}} WHERE format = 'configmap'"""
J["j_cfgv"] = f"""
    SELECT repo, path, ref, 'HOST' AS key, {s('data.HOST')} AS raw, {s('data.HOST')} AS tokens, 0 AS port, '' AS protocol, 'calls' AS suggested_edge, 'ConfigMap "' || name || '" key HOST=' || {s('data.HOST')} AS detail FROM {{j_cfg}}
    UNION ALL SELECT repo, path, ref, 'PAY_URL', {s('data.PAY_URL')}, regexp_replace({s('data.PAY_URL')}, '^https://', ''), 443, 'https', 'calls', 'ConfigMap "' || name || '" key PAY_URL=' || {s('data.PAY_URL')} FROM {{j_cfg}}"""


@query("configmap_values", "SELECT * FROM {j_cfgv}", J)
def configmap_values(t):
    return k8s.configmap_values(objects(t, "configmap")).withColumn("tokens", F.array_join("tokens", " "))


J["j_uses"] = f"""
    SELECT repo, path, id AS from_node, 'configmap:' || namespace || '/' || m AS ref, detail FROM (
      SELECT *, {s('spec.containers[0].env[2].valueFrom.configMapKeyRef.name', 'tpl')} AS m, 'env CFG_HOST comes from ConfigMap "' || {s('spec.containers[0].env[2].valueFrom.configMapKeyRef.name', 'tpl')} || '" key "HOST"' AS detail FROM {{j_work}}
      UNION ALL SELECT *, {s('spec.containers[0].envFrom[0].configMapRef.name', 'tpl')}, 'container "main" takes its environment from ConfigMap "' || {s('spec.containers[0].envFrom[0].configMapRef.name', 'tpl')} || '"' FROM {{j_work}}
      UNION ALL SELECT *, {s('spec.volumes[0].configMap.name', 'tpl')}, 'volume "v" mounts ConfigMap "' || {s('spec.volumes[0].configMap.name', 'tpl')} || '"' FROM {{j_work}})"""


@query("configmap_uses", "SELECT * FROM {j_uses}", J)
def configmap_uses(t):
    return k8s.configmap_uses(objects(t, "workload"))


@query("configmap_join", """
    SELECT u.repo, u.path, u.from_node, u.ref, 'config_value' AS kind, v.key, v.raw, v.tokens, v.port, v.protocol, v.suggested_edge, u.detail || '; ' || v.detail AS detail
    FROM {j_uses} u JOIN {j_cfgv} v ON v.repo = u.repo AND v.ref = u.ref""", J)
def configmap_join(t):
    return jn.configmap_join(k8s.configmap_uses(objects(t, "workload")), k8s.configmap_values(objects(t, "configmap"))).withColumn(
        "tokens", F.array_join("tokens", " "))


@query("container_env_hints", f"""
    SELECT repo, path, id AS from_node, 'conn_string' AS kind, ({D.redact('v')}) AS raw, regexp_extract(v, '@([^:]*)', 1) AS tokens, 5432 AS port, 'postgres' AS protocol, 'persists_to' AS suggested_edge,
           'container "main" env DB_URL=' || ({D.redact('v')}) AS detail FROM (SELECT *, {s('spec.containers[0].env[0].value', 'tpl')} AS v FROM {{j_work}})""", J)
def container_env_hints(t):
    return k8s.container_env(objects(t, "workload")).withColumn("tokens", F.array_join("tokens", " "))


# ------------------------------------------------------------------- stacks
J["j_stack"] = f"""
    SELECT repo, path, k, {s('name')} AS stack, unnest(['web-' || k, 'db']) AS name, unnest([json_extract(j, '$.services."web-' || k || '"'), json_extract(j, '$.services.db')]) AS sj
    FROM {{j_docs}} WHERE format = 'compose' AND json_valid(doc)"""
image_kinds("j_ckinds", f"SELECT coalesce({s('image', 'sj')}, '') AS ref FROM {{j_stack}}")
J["j_comp"] = f"""
    SELECT repo, path, stack, 'container:' || name AS id, name, CASE WHEN {s('build', 'sj')} IS NOT NULL THEN 'service' ELSE coalesce(i.kind, 'service') END AS kind, coalesce(i.tech, '') AS framework,
           {s('image', 'sj')} AS image, CASE {s('build', 'sj')} WHEN './app/../web' THEN 'deploy/compose/web' WHEN 'web' THEN 'deploy/compose/web' END AS build_context,
           CASE WHEN name = 'db' THEN '' ELSE '7070 8080 9090' END AS ports, {s('deploy.replicas', 'sj')}::INTEGER AS replicas,
           CASE WHEN name = 'db' THEN NULL ELSE 'dev' END AS profiles, CASE WHEN name = 'db' THEN '' ELSE 'data' || (k % 3) END AS volumes, {s('restart', 'sj')} AS restart
    FROM {{j_stack}} LEFT JOIN {{j_ckinds}} i ON i.ref = coalesce({s('image', 'sj')}, '')"""


@query("compose_services", "SELECT * FROM {j_comp}", J)
def compose_services(t):
    return cp.compose_services(docs(t, "compose")).withColumns(
        {c: F.array_join(c, " ") for c in ("ports", "profiles", "volumes")})


@query("stack_members", """
    SELECT DISTINCT repo, 'context:' || stack AS src, '' AS dst, 'boundary' AS kind, stack AS detail FROM {j_comp}
    UNION ALL SELECT DISTINCT repo, 'context:' || stack, id, 'contains', path FROM {j_comp}""", J)
def stack_members(t):
    nodes, edges = cp.stack_members(cp.compose_services(docs(t, "compose")))
    return nodes.select("repo", F.col("id").alias("src"), F.lit("").alias("dst"), "kind", F.col("name").alias("detail")).unionByName(
        edges.select("repo", "src", "dst", "kind", F.col("path").alias("detail")))


@query("compose_depends_on", """
    SELECT repo, path, 'container:' || name AS src, unnest(['container:db', NULL]) AS dst, unnest([NULL, 'ghost']) AS token, 'depends_on' AS kind, 100 AS conf_pct, 'compose_depends_on' AS rule
    FROM {j_stack} WHERE name <> 'db'""", J)
def compose_depends_on(t):
    return cp.compose_depends_on(docs(t, "compose"))


@query("compose_env_hints", """
    SELECT repo, path, 'container:' || name AS from_node, 'env_host' AS kind, 'db:5432' AS raw, 'db' AS tokens, 5432 AS port, 'postgres' AS protocol, 'persists_to' AS suggested_edge, 'env DB_HOST=db:5432' AS detail
    FROM {j_stack} WHERE name <> 'db'""", J)
def compose_env_hints(t):
    return cp.compose_env(docs(t, "compose")).withColumn("tokens", F.array_join("tokens", " "))


# ------------------------------------------------------------------- charts
J["j_chart"] = f"""
    SELECT repo, path, {s('name')} AS chart_name, unnest(json_extract(j, '$.dependencies[*]')) AS d FROM {{j_docs}} WHERE format = 'chart'"""
image_kinds("j_dkinds", f"SELECT {s('name', 'd')} AS ref FROM {{j_chart}}")


@query("chart_dependencies", f"""
    WITH x AS (SELECT *, CASE WHEN {s('alias', 'd')} <> '' THEN {s('alias', 'd')} ELSE {s('name', 'd')} END AS name FROM {{j_chart}} LEFT JOIN {{j_dkinds}} i ON i.ref = {s('name', 'd')})
    SELECT repo, path, 'context:' || chart_name AS boundary, 'container:' || name AS id, name, coalesce(kind, 'service') AS kind, coalesce(tech, '') AS framework, {s('name', 'd')} AS chart,
           {s('version', 'd')} AS chart_version, chart_name || '-' || name AS release_name, 95 AS conf_pct FROM x""", J)
def chart_dependencies(t):
    return ch.chart_dependencies(docs(t, "chart"))


J["j_vals"] = "SELECT * FROM {j_docs} WHERE format = 'values'"


@query("chart_values_components", f"""
    SELECT repo, path, 'container:values' AS id, 'values' AS name, 'service' AS kind, '' AS framework, '' AS values_key, {s('image.repository')} || ':' || {s('image.tag')} AS image, NULL::INTEGER AS replicas,
           {s('service.port')}::INTEGER AS port, true AS enabled, 40 AS conf_pct FROM {{j_vals}} WHERE {s('image.repository')} IS NOT NULL
    UNION ALL SELECT repo, path, 'container:web-' || k, 'web-' || k, 'service', '', 'web', {s('web.image.repository')}, {s('web.replicaCount')}::INTEGER, {s('web.service.port')}::INTEGER, true, 40 FROM {{j_vals}} WHERE {s('web.name')} IS NOT NULL
    UNION ALL SELECT repo, path, 'container:redis', 'redis', 'datastore', 'redis', 'worker', '', NULL, NULL, false, 40 FROM {{j_vals}} WHERE {s('worker.name')} IS NOT NULL""", J)
def chart_values_components(t):
    return ch.chart_values_components(docs(t, "values"))


@query("helm_values_inferred", f"""
    SELECT repo, path, CASE WHEN {s('web.name')} IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS n_components, 'helm_values_inferred' AS code FROM {{j_vals}}""", J)
def helm_values_inferred(t):
    return ch.values_inferred(ch.chart_values_components(docs(t, "values")))


J["j_leaf"] = r"""
    SELECT v.repo, v.path, regexp_replace(regexp_replace(replace(e.fullkey, '"', ''), '^\$\.?', ''), '\[(\d+)\]', '.\1', 'g') AS trail,
           e.key AS k0, json_extract_string(e.value, '$') AS value FROM {j_vals} v, json_tree(v.j) e WHERE e.type = 'VARCHAR'"""
J["j_leaves"] = "SELECT repo, path, trail, string_split(trail, '.')[-1] AS key, value FROM {j_leaf}"


@query("walk_values", "SELECT * FROM {j_leaves}", J)
def walk_values(t):
    return ch.walk_values(docs(t, "values"))


J["j_leafrows"] = "SELECT row_number() OVER () AS row_id, * FROM {j_leaves}"
J2 = dict(J)
J2.update({k: v for k, v in D.hints("j_leafrows").items() if k.startswith("dk_ref")})


@query("values_references", f"""
    SELECT repo, path, trail, kind, ({D.redact_value('key', 'value')}) AS raw, array_to_string(tokens, ' ') AS tokens, port, protocol, edge AS suggested_edge FROM {{dk_ref}}""", J2)
def values_references(t):
    return ch.values_references(docs(t, "values")).withColumn("tokens", F.array_join("tokens", " "))


# ---------------------------------------------------------------- resources
J["j_res"] = f"""
    SELECT r.*, c.kind AS ck, c.tech FROM {{fx_resources}} r LEFT JOIN {{dk_resources}} c ON c.type = r.type"""


@query("resource_classify", """
    SELECT repo, path, line, CASE WHEN ck = 'boundary' THEN 'context' ELSE 'container' END || ':' || type || '.' || name AS id, ck AS kind, CASE WHEN ck = 'boundary' THEN 'context' ELSE 'container' END AS layer,
           name, CASE WHEN block = 'data' THEN 'data.' ELSE '' END || type || '.' || name AS address, tech AS framework, string_split(type, '_')[1] AS provider, block = 'resource' AS managed,
           CASE WHEN has_count = 1 THEN 'count' END AS multiplicity, CASE WHEN block = 'resource' THEN 100 ELSE 95 END AS conf_pct FROM {j_res} WHERE block <> 'module' AND ck IS NOT NULL""", J)
def resource_classify(t):
    return rs.resource_classify(t.fx_resources)


@query("resource_diagnostics", """
    SELECT repo, 'info' AS severity, code, path, 0 AS line, message FROM (
      SELECT repo, 'terraform_unrecognized_resource' AS code, regexp_replace(path, '/[^/]*$', '') AS path, type AS message FROM {j_res} r WHERE block <> 'module' AND ck IS NULL
        AND NOT EXISTS (SELECT 1 FROM {dk_plumbing} p WHERE starts_with(r.type, p.prefix))
      UNION ALL SELECT repo, 'terraform_unexpanded', regexp_replace(path, '/[^/]*$', ''), type || '.' || name || ' uses count' FROM {j_res} WHERE block <> 'module' AND ck IS NOT NULL AND has_count = 1)""", J)
def resource_diagnostics(t):
    return rs.resource_diagnostics(t.fx_resources)


J["j_decl"] = """SELECT DISTINCT repo, path, CASE WHEN block = 'module' THEN 'module.' || name ELSE type || '.' || name END AS a,
    CASE WHEN block = 'module' THEN 'container:module.' || name ELSE CASE WHEN ck = 'boundary' THEN 'context:' ELSE 'container:' END || type || '.' || name END AS id
    FROM {j_res} WHERE block = 'module' OR (block = 'resource' AND ck IS NOT NULL)"""


@query("resource_references", f"""
    WITH r AS (SELECT *, CASE WHEN block = 'module' THEN 'module.' || name ELSE type || '.' || name END AS own, starts_with(ref_address, 'var.') AS var,
                 CASE WHEN block = 'module' THEN 'container:module.' || name ELSE CASE WHEN ck = 'boundary' THEN 'context:' ELSE 'container:' END || type || '.' || name END AS me
               FROM {{j_res}} WHERE ref_address IS NOT NULL AND (block = 'module' OR ck IS NOT NULL)),
    f AS (SELECT repo, path, own, me, var, ref_address, min(line) AS line FROM r WHERE own <> ref_address AND (NOT var OR ref_attr = 'queue_url') GROUP BY ALL),
    k AS (SELECT f.*, d.id AS target, CASE c.kind WHEN 'datastore' THEN 'persists_to' WHEN 'queue' THEN 'publishes_to' WHEN 'service' THEN 'calls' WHEN 'boundary' THEN 'contains' ELSE 'depends_on' END AS rel
          FROM f LEFT JOIN {{j_decl}} d ON d.repo = f.repo AND d.path = f.path AND d.a = f.ref_address LEFT JOIN {{dk_resources}} c ON c.type = string_split(f.ref_address, '.')[1])
    SELECT repo, path, line, CASE WHEN var THEN 'unresolved' WHEN target IS NOT NULL THEN 'edge' ELSE 'hint' END AS outcome,
           CASE WHEN target IS NOT NULL AND rel = 'contains' THEN target ELSE me END AS src, CASE WHEN target IS NOT NULL THEN CASE WHEN rel = 'contains' THEN me ELSE target END END AS dst, ref_address,
           CASE WHEN NOT var THEN rel END AS kind, CASE WHEN target IS NOT NULL THEN 95 END AS conf_pct,
           CASE WHEN var THEN NULL WHEN target IS NOT NULL AND rel = 'contains' THEN 'terraform_containment' ELSE 'terraform_reference' END AS rule FROM k""", J)
def resource_references(t):
    return rs.resource_references(t.fx_resources)


@query("module_calls", """
    SELECT repo, path, line, 'container:module.' || name AS id, name, source, NOT starts_with(source, './') AS external, CASE WHEN NOT starts_with(source, './') THEN 'terraform_external_module' END AS code, 100 AS conf_pct
    FROM {fx_resources} WHERE block = 'module'""", J)
def module_calls(t):
    return rs.module_calls(t.fx_resources)
