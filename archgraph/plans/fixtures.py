"""Input views derived from the given tables.

Each view is one SQL text that both engines evaluate: expressions are limited
to what Spark and DuckDB share. Every view reads whole tables; cases are
assigned with CASE, never by filtering rows away, so the work grows with the
tables. ``{name}`` refers to a base table or to another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

Q = "chr(34)"  # a double quote, spelled so that both dialects agree


def _json(*parts: str) -> str:
    """Concatenate SQL pieces; a piece starting with = is an SQL expression,
    anything else is literal JSON text."""
    out = []
    for part in parts:
        out.append(f"cast({part[1:]} as string)" if part.startswith("=") else "'" + part + "'")
    return " || ".join(out)


VIEWS: dict[str, str] = {}

# ---------------------------------------------------------------- graph input
VIEWS["fx_suppliers"] = """
SELECT s_suppkey AS k, 'a' AS repo FROM {supplier}
UNION ALL SELECT s_suppkey, 'b' FROM {supplier}
"""
VIEWS["fx_stores"] = """
SELECT DISTINCT cast(floor(p_partkey / 10) as bigint) AS q, 'a' AS repo FROM {part}
UNION SELECT DISTINCT cast(floor(p_partkey / 10) as bigint), 'b' FROM {part}
"""
VIEWS["fx_nodes"] = """
SELECT repo, 'container:@ns-' || (k % 5) || '/svc-' || k AS id, 'service' AS kind,
       'container' AS layer, 'svc-' || k AS name, 'ns-' || (k % 5) AS namespace,
       CASE WHEN repo = 'b' THEN 'proj-' || (k % 2) ELSE '.' END AS project,
       cast(NULL as string) AS language, cast(NULL as string) AS framework,
       'ghcr.io/acme/app-' || (k % 40) || ':1.' || (k % 7) AS image,
       cast(8000 + floor(k / 10) % 10 as int) AS port,
       'app=svc-' || k || ';tier=' || (k % 3) AS labels,
       cast(NULL as string) AS directory,
       CASE WHEN k % 6 = 0 THEN 'services/svc-' || k END AS build_context,
       cast(NULL as string) AS name_from, cast(NULL as string) AS hostname,
       'deploy/ns-' || (k % 5) || '/svc-' || k || '.yaml' AS path,
       cast(1 + k % 9 as int) AS line, cast(100 as int) AS conf_pct
FROM {fx_suppliers}
UNION ALL
SELECT repo, 'container:@ns-' || (q % 5) || '/db-' || cast(floor(q / 5) as bigint),
       CASE WHEN q % 3 = 2 THEN 'queue' ELSE 'datastore' END, 'container',
       'db-' || cast(floor(q / 5) as bigint), 'ns-' || (q % 5),
       CASE WHEN repo = 'b' THEN 'proj-' || (q % 2) ELSE '.' END, NULL,
       CASE q % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'redis' ELSE 'amqp' END,
       CASE q % 3 WHEN 0 THEN 'postgres:16-alpine' WHEN 1 THEN 'redis:7'
                  ELSE 'rabbitmq:3-management' END,
       CASE q % 3 WHEN 0 THEN 5432 WHEN 1 THEN 6379 ELSE 5672 END,
       'app=db-' || cast(floor(q / 5) as bigint) || ';tier=data', NULL, NULL, NULL, NULL,
       'deploy/ns-' || (q % 5) || '/stores.yaml', cast(1 + q % 30 as int), 100
FROM {fx_stores}
UNION ALL
SELECT repo, 'container:@ns-' || (q % 5) || '/db_' || cast(floor(q / 5) as bigint),
       'service', 'container', 'db_' || cast(floor(q / 5) as bigint), 'ns-' || (q % 5),
       CASE WHEN repo = 'b' THEN 'proj-' || (q % 2) ELSE '.' END, 'go', NULL,
       'ghcr.io/acme/db-proxy-' || q || ':2', cast(6432 as int),
       'app=proxy-' || q || ';tier=proxy', NULL, NULL, NULL, NULL,
       'deploy/ns-' || (q % 5) || '/proxies.yaml', cast(1 + q % 30 as int), 100
FROM {fx_stores}
UNION ALL
SELECT repo, 'container:services/svc-' || k, 'service', 'container',
       CASE WHEN k % 4 = 1 THEN 'svc-' || k ELSE 'acme/svc-' || k END, NULL,
       CASE WHEN repo = 'b' THEN 'proj-' || (k % 2) ELSE '.' END,
       CASE k % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'typescript' END,
       CASE WHEN k % 3 = 1 THEN 'flask' END, NULL, NULL, NULL,
       CASE WHEN k % 10 = 7 THEN 'services/shared-' || (k % 20)
            WHEN k % 10 = 3 THEN 'deploy/code/svc-' || k
            ELSE 'services/svc-' || k END, NULL,
       CASE WHEN k % 4 = 1 THEN 'directory' END, NULL,
       'services/svc-' || k || '/package.json', 1, 80
FROM {fx_suppliers}
UNION ALL
SELECT DISTINCT repo, 'context:@ns-' || (k % 5) || '/ns-' || (k % 5), 'boundary', 'context',
       'ns-' || (k % 5), 'ns-' || (k % 5), '.', NULL, NULL, NULL, cast(NULL as int), NULL, NULL,
       NULL, NULL, NULL, 'deploy/ns-' || (k % 5) || '/namespace.yaml', 1, 100
FROM {fx_suppliers}
UNION ALL
SELECT DISTINCT 'a', 'context:api-' || (c_custkey % 3) || '.example.com', 'external', 'context',
       'api-' || (c_custkey % 3) || '.example.com', 'net', '.', NULL,
       CASE WHEN c_custkey % 3 = 1 THEN 'stripe' END, NULL,
       cast(NULL as int), NULL, NULL, NULL, NULL,
       'api-' || (c_custkey % 3) || '.example.com', 'deploy/external.yaml',
       cast(1 + c_custkey % 3 as int), 80
FROM {customer}
"""

# Duplicates on purpose (merge tests); the chain gives routes of log2(N) hops.
VIEWS["fx_edges"] = """
SELECT 'a' AS repo, 'container:@ns-' || (k % 5) || '/svc-' || k AS src,
       'container:@ns-' || (d % 5) || '/svc-' || d AS dst, kind, protocol,
       cast(conf as int) AS conf_pct, rule,
       'deploy/ns-' || (k % 5) || '/svc-' || k || '.yaml' AS path,
       cast(10 + k % 7 as int) AS line, 'chain ' || k AS detail, 'k8s' AS extractor
FROM (
  SELECT s_suppkey AS k, 2 * s_suppkey + 1 AS d, 'calls' AS kind, 'http' AS protocol,
         80 AS conf, 'dns_exact' AS rule FROM {supplier}
  UNION ALL SELECT s_suppkey, 2 * s_suppkey + 2, 'calls', 'http', 70 + s_suppkey % 3 * 5,
         'name_exact' FROM {supplier}
  UNION ALL SELECT s_suppkey, 4 * s_suppkey + 3, 'publishes_to', 'kafka', 40,
         'image_basename' FROM {supplier}
  UNION ALL SELECT s_suppkey, 2 * s_suppkey + 1 + s_suppkey % 2, 'depends_on', NULL, 100,
         'declared' FROM {supplier}
) c WHERE d < (SELECT count(*) FROM {supplier})
UNION ALL
SELECT 'a', 'container:@ns-' || (l_suppkey % 5) || '/svc-' || l_suppkey,
       'container:@ns-' || (cast(floor(l_partkey / 10) as bigint) % 5) || '/db-'
         || cast(floor(l_partkey / 50) as bigint),
       'persists_to', 'postgres',
       CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 80 ELSE 40 END, 'name_exact',
       'orders/' || (l_orderkey % 50) || '.yaml', cast(l_linenumber as int),
       'env DB_URL=postgres://svc:pw' || (l_orderkey % 5) || '@db-' || cast(floor(l_partkey / 50) as bigint),
       'dotenv'
FROM {lineitem}
UNION ALL
SELECT 'a', 'context:@ns-' || (s_suppkey % 5) || '/ns-' || (s_suppkey % 5),
       'container:@ns-' || (s_suppkey % 5) || '/svc-' || s_suppkey, 'contains', NULL, 100,
       'k8s_namespace_member', 'deploy/ns-' || (s_suppkey % 5) || '/svc-' || s_suppkey || '.yaml',
       1, 'namespace', 'k8s'
FROM {supplier}
UNION ALL
SELECT 'b', 'container:@ns-' || (s_suppkey % 5) || '/svc-' || s_suppkey,
       'container:@ns-' || (cast(floor(s_suppkey / 2) as bigint) % 5) || '/svc-'
         || cast(floor(s_suppkey / 2) as bigint), 'calls', 'grpc', 80, 'dns_exact',
       'deploy/b/svc-' || s_suppkey || '.yaml', 3, 'chain', 'k8s'
FROM {supplier} WHERE s_suppkey > 0
UNION ALL
SELECT 'a', 'container:services/svc-' || s_suppkey, 'container:@ns-' || (s_suppkey % 5) || '/svc-' || s_suppkey, 'depends_on', NULL, 40,
       'image_basename', 'services/svc-' || s_suppkey || '/package.json', 1, 'code of ' || s_suppkey, 'manifest'
FROM {supplier} WHERE s_suppkey % 4 = 1
"""

# One environment row per order.
VIEWS["fx_env"] = """
SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 4 = 3 THEN 'b' ELSE 'a' END AS repo,
       CASE WHEN o_orderkey % 3 = 1 THEN 'container:services/svc-' || k
            ELSE 'container:@ns-' || (k % 5) || '/svc-' || k END AS from_node,
       CASE o_orderkey % 16
         WHEN 0 THEN 'DATABASE_URL' WHEN 1 THEN 'CACHE_HOST' WHEN 2 THEN 'LOG_PREFIX'
         WHEN 3 THEN 'PAY_URL' WHEN 4 THEN 'KAFKA_BROKERS' WHEN 5 THEN 'API_TOKEN'
         WHEN 6 THEN 'PEER_ADDR' WHEN 7 THEN 'UPSTREAM_HOST' WHEN 8 THEN 'SVC_ADDR'
         WHEN 9 THEN 'APP_HOST' WHEN 10 THEN 'STORE_ADDR' WHEN 11 THEN 'search-endpoint'
         WHEN 12 THEN 'HOST' WHEN 13 THEN 'QUEUE_URL' WHEN 14 THEN 'SHIPPING_SERVICE_ADDR'
         ELSE 'dbPassword' END AS key,
       CASE o_orderkey % 16
         WHEN 0 THEN 'postgres://svc:pw' || o_custkey || '@db-' || (o_custkey % 40) || ':5432/app'
         WHEN 1 THEN 'db-' || (o_custkey % 40) || '.ns-' || (o_custkey % 5) || '.svc.cluster.local:6379'
         WHEN 2 THEN 'svc-' || (o_custkey % 100)
         WHEN 3 THEN 'https://' || CASE o_custkey % 7 WHEN 5 THEN 'api.stripe.com'
                     ELSE 'api-' || (o_custkey % 7) || '.example.com' END || '/v1'
         WHEN 4 THEN 'svc-' || (o_custkey % 100) || ':9092, svc-1:9092'
         WHEN 5 THEN 'sk-live' || o_custkey || 'abcdefghij'
         WHEN 6 THEN '127.0.0.1:80'
         WHEN 7 THEN 'my_db_' || (o_custkey % 9)
         WHEN 8 THEN 'svc_' || (o_custkey % 100) || ':8080'
         WHEN 9 THEN 'app-' || (o_custkey % 40) || ':' || (8000 + o_custkey % 10)
         WHEN 10 THEN 'db' || (o_custkey % 40) || ':' || CASE WHEN o_custkey % 2 = 0 THEN '5432' ELSE '9200' END
         WHEN 11 THEN 'http://' || chr(36) || '{HOST_' || (o_custkey % 9) || '}:80'
         WHEN 12 THEN 'SVC-' || (o_custkey % 100) || '.'
         WHEN 13 THEN 'AMQP://guest:guest@alias-' || (o_custkey % 60) || ':notaport/q'
         WHEN 14 THEN 'alias-' || (o_custkey % 60) || '.ns-' || (o_custkey % 5) || ':70000'
         ELSE 'hunter2 ' || o_custkey END AS value,
       'deploy/ns-' || (k % 5) || '/svc-' || k || '.yaml' AS path,
       cast(10 + o_orderkey % 16 as int) AS line
FROM (SELECT o_orderkey, o_custkey, o_orderkey % (SELECT count(*) FROM {supplier}) AS k
      FROM {orders}) o
"""

VIEWS["fx_aliases"] = """
SELECT 'a' AS repo, c_custkey AS alias_key, 'alias-' || (c_custkey % 60) || CASE
         WHEN c_custkey >= 60 THEN '-' || c_custkey ELSE '' END AS name,
       'ns-' || (c_custkey % 5) AS namespace, '.' AS project,
       CASE WHEN c_custkey % 9 = 0 OR c_custkey % 50 = 1 THEN ''
            WHEN c_custkey % 10 = 4 THEN 'tier=' || (c_custkey % 3)
            ELSE 'app=svc-' || (c_custkey % (SELECT count(*) FROM {supplier}))
              || CASE WHEN c_custkey % 7 = 0 THEN ';tier=' || (c_custkey % 4) ELSE '' END
       END AS selector,
       CASE WHEN c_custkey % 9 = 0 THEN 'db-' || (c_custkey % 50) END AS target_name,
       CASE WHEN c_custkey % 50 = 1 THEN 'rds-' || (c_custkey % 20) || '.example.org' END AS external,
       cast(8080 + c_custkey % 4 as int) AS port,
       'deploy/ns-' || (c_custkey % 5) || '/services.yaml' AS path,
       cast(c_custkey % 400 as int) AS line
FROM {customer}
"""

# Many readings per component, for the merge rules.
VIEWS["fx_readings"] = """
SELECT 'a' AS repo, 'container:part-' || l_partkey AS id,
       cast(l_orderkey * 8 + l_linenumber as bigint) AS seq,
       CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 80 ELSE 40 END AS conf_pct,
       CASE WHEN l_quantity > 25 THEN 'service' WHEN l_linenumber % 2 = 0 THEN 'datastore'
            ELSE 'queue' END AS kind,
       CASE WHEN l_linestatus = 'F' AND l_quantity < 15 THEN 'img-' || l_suppkey END AS image,
       CASE WHEN l_linenumber % 3 = 0 THEN 'v' || l_suppkey END AS version,
       CASE WHEN l_linenumber % 2 = 0 THEN 'directory' END AS name_from,
       'name-' || l_linenumber || '-' || l_partkey AS name,
       CASE WHEN l_linenumber = 5 THEN 'ns-' || (l_suppkey % 5) END AS namespace,
       CASE WHEN l_linenumber % 4 = 1 THEN 'apps/t' || (l_partkey % 3) || '/t' || (l_suppkey % 4) || '/x'
            WHEN l_linenumber % 4 = 2 THEN 'libs/u' || (l_suppkey % 3)
            ELSE 'apps/t' || (l_partkey % 3) || '/shared' END
         || '/' || CASE WHEN l_partkey % 5 = 0 THEN 'a' ELSE 'b' END || '.yaml' AS path,
       cast(l_linenumber as int) AS line
FROM {lineitem}
"""

VIEWS["fx_diagnostics"] = """
SELECT 'a' AS repo, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
            ELSE 'info' END AS severity,
       CASE event_type WHEN 'click' THEN 'terraform_unresolved_reference'
            WHEN 'view' THEN 'k8s_patch_fragment' WHEN 'signup' THEN 'terraform_unexpanded'
            ELSE event_type END AS code,
       'deploy/ns-' || (user_id % 5) || '/svc-' || (user_id % 100) || '.yaml' AS path,
       cast(event_id % 40 as int) AS line, 'detail ' || (event_id % 30) AS message
FROM {events}
"""

VIEWS["fx_dir_hints"] = """
SELECT repo, row_id AS hint_id, key,
       CASE row_id % 4 WHEN 0 THEN 'services/svc-' || k WHEN 1 THEN './services//shared-' || (k % 20) || '/'
            WHEN 2 THEN 'services/svc-' || k || '/src/..' ELSE 'nowhere/' || (k % 9) END AS owner_dir,
       'services/' || (row_id % 300) || '/.env' AS path
FROM (SELECT *, row_id % (SELECT count(*) FROM {supplier}) AS k FROM {fx_env}) e
"""
VIEWS["fx_decls"] = """
SELECT 'a' AS repo, cast(l_orderkey * 8 + l_linenumber as bigint) AS seq,
       CASE l_linenumber % 3 WHEN 0 THEN 'context:prod-' || g
            WHEN 1 THEN CASE WHEN g < 3 THEN 'container:c-' || g || '-' || tt || '-' || (l_partkey % 50)
                             ELSE 'container:c-' || g || '-' || (l_partkey % 50) END
            ELSE 'container:root-' || (l_partkey % 20) END AS id,
       CASE l_linenumber % 3 WHEN 0 THEN 'boundary' ELSE 'service' END AS kind,
       CASE l_linenumber % 3 WHEN 0 THEN 'prod-' || g WHEN 1 THEN 'c-' || (l_partkey % 50) ELSE 'root-' || (l_partkey % 20) END AS name,
       CASE WHEN l_linenumber % 2 = 0 THEN 'directory' END AS name_from,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 2 THEN
                 CASE WHEN l_partkey % 2 = 0 THEN 'acme/R-' || tt || ':1' END
            WHEN g = 4 THEN 'acme/img-' || tt || ':1' ELSE 'img-x:1' END AS image,
       CASE WHEN l_linenumber % 3 = 1 AND g = 5 THEN 'build/' || tt END AS build,
       CASE l_linenumber % 3 WHEN 0 THEN 'apps/g' || g || '/t' || tt || '/ns.yaml'
            WHEN 1 THEN 'apps/g' || g || '/t' || tt || '/deploy/x.yaml'
            ELSE 'top' || tt || '/x.yaml' END AS path
FROM (SELECT *, l_partkey % 6 AS g, l_suppkey % 3 AS tt FROM {lineitem}) l
"""
VIEWS["fx_decl_projects"] = """
SELECT DISTINCT 'a' AS repo, CASE l_partkey % 6 WHEN 5 THEN ' ./apps/g5/' WHEN 4 THEN '../out' ELSE '.' END AS root FROM {lineitem}
"""
VIEWS["fx_sources"] = """
SELECT 'a' AS repo, 'svc-' || k AS caller,
       'src/svc-' || k || CASE o_orderkey % 5 WHEN 0 THEN '/vendor/x.go' WHEN 1 THEN '/readme.md'
          WHEN 2 THEN '/app.PY' ELSE '/main' || o_orderkey || '.go' END AS path,
       'x := os.Getenv(' || chr(34) || 'SVC_' || (o_custkey % 100) || '_ADDR' || chr(34) || ') + DB_URL_HOST + '
         || 'MY_SVC_URLS + APP' || (o_custkey % 7) || '_ENDPOINT; lower_host LISTEN_HOST' AS content
FROM (SELECT o_orderkey, o_custkey, o_orderkey % (SELECT count(*) FROM {supplier}) AS k FROM {orders}) o
"""
VIEWS["fx_stems"] = """
SELECT 'a' AS repo, 'SVC_' || s_suppkey AS stem,
       CASE WHEN s_suppkey % 3 = 0 THEN 'svc-' || (2 * s_suppkey + 1) ELSE 'svc-' || s_suppkey END AS callee FROM {supplier}
"""

# ------------------------------------------------------------------ file input
VIEWS["fx_paths"] = """
SELECT 'repo-' || (page_id % 3) AS repo,
       'proj-' || (page_id % 4)
         || CASE page_id % 7 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/build/out'
              WHEN 2 THEN '/charts/web/templates' WHEN 3 THEN '/docs' ELSE '/src' END
         || '/svc-' || (page_id % 20) || '/'
         || CASE page_id % 13
         WHEN 0 THEN 'Dockerfile' WHEN 1 THEN '.env' WHEN 2 THEN 'package.json'
         WHEN 3 THEN 'values.yaml' WHEN 4 THEN 'docker-compose.prod.yml' WHEN 5 THEN 'main.tf'
         WHEN 6 THEN 'fly.toml' WHEN 7 THEN 'requirements-dev.txt' WHEN 8 THEN 'Procfile'
         WHEN 9 THEN 'main.GO' WHEN 10 THEN 'Chart.yaml' WHEN 11 THEN '.env.example'
         ELSE 'app.min.js' END AS path,
       cast(length(html) * 300 as bigint) AS size, page_id,
       cast(1700000000 + page_id as bigint) AS mtime
FROM {pages}
"""
VIEWS["fx_ignore_rules"] = """
SELECT DISTINCT 'repo-' || (cast(floor(page_id / 6) as bigint) % 3) AS repo,
       CASE page_id % 6 WHEN 4 THEN 'proj-1' WHEN 5 THEN 'proj-2/src' ELSE '' END AS base,
       cast(page_id % 6 as int) AS line,
       CASE page_id % 6 WHEN 0 THEN 'build/' WHEN 1 THEN 'proj-0/docs/**/*.toml' WHEN 2 THEN '*.tf'
            WHEN 3 THEN '!proj-3/build/' WHEN 4 THEN '!*.tf' ELSE '/svc-1?/' END AS pattern
FROM {pages}
"""
VIEWS["fx_projects"] = """
SELECT DISTINCT 'repo-' || (page_id % 3) AS repo, CASE page_id % 5
         WHEN 0 THEN 'proj-0' WHEN 1 THEN 'proj-1' WHEN 2 THEN 'proj-2'
         WHEN 3 THEN 'proj-1/src/svc-5' ELSE '.' END AS root
FROM {pages}
"""
# One small text file per order, format by order key.
VIEWS["fx_files"] = """
SELECT 'repo-' || (o_orderkey % 3) AS repo, o_orderkey AS file_key,
       'services/team-' || (o_custkey % 60) || CASE WHEN o_orderkey % 5 = 0 THEN '/src' ELSE '' END
         || '/u' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '/docker' ELSE '' END AS dir,
       CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 3 = 0 THEN '.env.example' ELSE '.env' END
            WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'requirements.txt' ELSE 'go.mod' END AS file_name,
       CASE o_orderkey % 4
       WHEN 0 THEN
         '# settings ' || o_orderkey || chr(10)
         || 'export DATABASE_URL=postgres://svc:pw' || o_custkey || '@db-' || (o_custkey % 40) || ':5432/app' || chr(13) || chr(10)
         || 'CACHE_HOST=' || chr(34) || 'cache-' || (o_custkey % 9) || ':6379' || chr(34) || chr(10)
         || chr(10) || 'PAY_URL=https://api-' || (o_custkey % 7) || '.example.com/v1 # live' || chr(10)
         || 'BAD-KEY=svc-1' || chr(10)
         || 'BROKEN_URL=' || chr(39) || 'http://svc-1' || chr(10)
         || '  WEB_ADDR = svc-' || (o_custkey % 100) || ':8080' || chr(9) || '# note' || chr(10)
         || 'AUTH_URL=https://your-tenant.' || (o_custkey % 4) || 'auth.io/x' || chr(10)
         || 'API_TOKEN=https://tok.internal-' || (o_custkey % 5) || '/x' || chr(10)
         || CASE WHEN o_custkey % 2 = 0 THEN 'EMPTY=' ELSE 'TPL_HOST=<host-' || o_custkey || '>' END
       WHEN 1 THEN
         '# syntax=docker/dockerfile:1' || chr(10)
         || CASE WHEN o_custkey % 11 = 0 THEN '' ELSE
            'ARG VERSION=' || (1 + o_custkey % 20) || chr(10)
         || 'FROM --platform=linux/amd64 ' || CASE o_custkey % 4 WHEN 0 THEN 'golang:1.22'
              WHEN 1 THEN 'node:20-alpine' WHEN 2 THEN 'mcr.microsoft.com/dotnet/sdk:8.0'
              ELSE 'ghcr.io/acme/base:1' END || ' AS Build' || chr(10)
         || 'RUN apt-get update ' || chr(92) || chr(10)
         || '  # a comment inside' || chr(10)
         || '  && apt-get install -y curl' || chr(10)
         || CASE WHEN o_custkey % 5 = 0 THEN 'RUN <<EOF' || chr(10) || 'EXPOSE 1' || chr(10)
              || 'FROM nowhere' || chr(10) || 'EOF' || chr(10) ELSE '' END
         || CASE WHEN o_custkey % 3 = 0 THEN 'FROM build AS test' || chr(10) ELSE '' END
         || CASE WHEN o_custkey % 2 = 0 THEN 'FROM gcr.io/distroless/static' || chr(10)
              WHEN o_custkey % 7 = 0 THEN 'from postgres:16' || chr(10) ELSE '' END END
         || 'ENV PORT=' || (8000 + o_custkey % 100) || ' ADMIN=' || chr(34) || '9' || (o_custkey % 10) || '00' || chr(34) || chr(10)
         || 'ENV UPSTREAM_HOST svc-' || (o_custkey % 100) || ':9092' || chr(10)
         || 'ENV LATE_URL=http://' || chr(36) || 'PORT' || chr(10)
         || 'EXPOSE ' || chr(36) || 'PORT ' || chr(36) || '{ADMIN}/tcp ' || (3000 + o_custkey % 10) || '/udp '
         || chr(36) || '{UNKNOWN} 99999' || chr(10)
         || 'CMD run'
       WHEN 2 THEN
         'flask==2.' || (o_custkey % 9) || chr(10) || '# comment' || chr(10)
         || 'psycopg2-binary>=2.9 ; python_version > ' || chr(34) || '3.8' || chr(34) || chr(10)
         || 'uvicorn[standard]~=0.2' || chr(10) || '-r base.txt' || chr(10)
         || './local/pkg' || chr(10) || 'My_Pkg-' || (o_custkey % 50) || ' # pinned' || chr(10)
         || 'redis @ https://x.example.com/redis.whl' || chr(10)
         || CASE WHEN o_custkey % 4 = 0 THEN 'two words' ELSE 'celery!=5' END
       ELSE
         'module github.com/acme/mod-' || (o_custkey % 60) || chr(10) || chr(10)
         || 'go 1.' || (18 + o_custkey % 5) || chr(10) || chr(10)
         || 'require (' || chr(10)
         || chr(9) || 'github.com/jackc/pgx/v' || (4 + o_custkey % 2) || ' v5.1.0' || chr(10)
         || chr(9) || 'github.com/gin-gonic/gin v1.9.1' || chr(10)
         || chr(9) || 'golang.org/x/text v0.3.0 // indirect' || chr(10)
         || chr(9) || '// a note' || chr(10)
         || ')' || chr(10) || chr(10)
         || 'require github.com/acme/lib-' || (o_custkey % 30) || ' v0.1.0' || chr(10)
         || CASE WHEN o_custkey % 3 = 0 THEN 'replace github.com/acme/x => ../x' ELSE '' END
       END AS content
FROM {orders}
"""
VIEWS["fx_images"] = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'ghcr.io/acme/'
         WHEN 2 THEN 'localhost/' WHEN 3 THEN 'registry.local:5000/team/' WHEN 4 THEN 'bitnami/'
         ELSE 'mcr.microsoft.com/dotnet/' END
       || CASE p_partkey % 11 WHEN 0 THEN 'postgres' WHEN 1 THEN 'cp-kafka' WHEN 2 THEN 'app-' || p_partkey
         WHEN 3 THEN 'Redis-Alpine' WHEN 4 THEN 'node' WHEN 5 THEN 'sdk' WHEN 6 THEN 'debian'
         WHEN 7 THEN 'docker-nginx-slim' WHEN 8 THEN 'golang' WHEN 9 THEN 'distroless/base' ELSE 'rabbitmq' END
       || CASE p_partkey % 4 WHEN 0 THEN ':1.' || (p_partkey % 30) WHEN 1 THEN '@sha256:ab' || p_partkey
         WHEN 2 THEN '' ELSE ':2@sha256:cd' || p_partkey END AS ref
FROM {part}
"""
VIEWS["fx_deps"] = """
SELECT 'a' AS repo, 'container:services/svc-' || (p_partkey % 60) AS component,
       CASE p_partkey % 12 WHEN 0 THEN 'psycopg2-binary' WHEN 1 THEN 'github.com/jackc/pgx/v5'
         WHEN 2 THEN '@supabase/supabase-js' WHEN 3 THEN 'Flask' WHEN 4 THEN 'uvicorn[standard]'
         WHEN 5 THEN '@nestjs/core' WHEN 6 THEN 'google_cloud_storage' WHEN 7 THEN 'stripe'
         WHEN 8 THEN 'github.com/IBM/sarama' WHEN 9 THEN '@aws-sdk/client-s3' WHEN 10 THEN 'google-cloud-pubsub'
         ELSE 'lib-' || p_partkey END AS dependency,
       'services/svc-' || (p_partkey % 60) || '/package.json' AS path
FROM {part}
"""
VIEWS["fx_resources"] = """
SELECT 'a' AS repo, 'infra/m' || cast(floor(p_partkey / 40) as bigint) || '/main.tf' AS path,
       CASE p_partkey % 9 WHEN 0 THEN 'aws_lambda_function' WHEN 1 THEN 'aws_db_instance'
         WHEN 2 THEN 'aws_iam_role' WHEN 3 THEN 'aws_sqs_queue' WHEN 4 THEN 'aws_weird_thing'
         WHEN 5 THEN 'aws_vpc' WHEN 6 THEN 'random_id' WHEN 7 THEN 'aws_glue_job' ELSE 'aws_lb' END AS type,
       'r' || p_partkey AS name,
       CASE WHEN p_partkey % 13 = 0 THEN 'data' WHEN p_partkey % 29 = 0 THEN 'module' ELSE 'resource' END AS block,
       CASE WHEN p_partkey % 10 = 3 THEN 'var.endpoint_' || (p_partkey % 7)
            WHEN p_partkey >= 27 THEN CASE (p_partkey - 27) % 9
              WHEN 0 THEN 'aws_lambda_function' WHEN 1 THEN 'aws_db_instance' WHEN 2 THEN 'aws_iam_role'
              WHEN 3 THEN 'aws_sqs_queue' WHEN 4 THEN 'aws_weird_thing' WHEN 5 THEN 'aws_vpc'
              WHEN 6 THEN 'random_id' WHEN 7 THEN 'aws_glue_job' ELSE 'aws_lb' END
              || '.r' || (p_partkey - 27) END AS ref_address,
       CASE p_partkey % 3 WHEN 0 THEN 'queue_url' WHEN 1 THEN 'vpc_id' ELSE 'role' END AS ref_attr,
       CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS has_count,
       CASE WHEN p_partkey % 2 = 0 THEN './modules/x' ELSE 'terraform-aws-modules/vpc' END AS source,
       cast(1 + p_partkey % 40 as int) AS line
FROM {part}
"""
VIEWS["fx_versions"] = """
SELECT 'repo-' || c_custkey AS repo, CASE c_custkey % 8 WHEN 0 THEN '1.0.0' WHEN 1 THEN '1.0.9'
         WHEN 2 THEN '1.2.0' WHEN 3 THEN '0.1.0' WHEN 4 THEN '2.0.0-rc.1' WHEN 5 THEN '1.x'
         WHEN 6 THEN '1.0.0+b1' ELSE '1..0' END AS stored,
       cast(1700000000 + c_custkey * 60 as bigint) AS generated_at,
       CASE WHEN c_custkey % 3 = 0 THEN 'build-1' ELSE 'build-2' END AS producer
FROM {customer}
"""
VIEWS["fx_expected"] = """
SELECT 'a' AS repo, CASE WHEN s_suppkey % 10 = 0 THEN 'svc-' || s_suppkey
            WHEN s_suppkey % 17 = 3 THEN '*' ELSE 'svc-' || s_suppkey END AS src_name,
       CASE WHEN s_suppkey % 10 = 0 THEN '*' WHEN s_suppkey % 17 = 3 THEN 'db-' || (s_suppkey % 9)
            WHEN s_suppkey % 5 = 1 THEN 'svc-' || (s_suppkey + 1) ELSE 'svc-' || (2 * s_suppkey + 1) END AS dst_name,
       CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 17 = 3 THEN 'allowed' ELSE 'expected' END AS mode
FROM {supplier}
"""
VIEWS["fx_rules"] = """
SELECT 'a' AS repo, s_suppkey AS rule_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'same' END AS action,
       CASE s_suppkey % 8 WHEN 5 THEN 'container:@ns-' || (s_suppkey % 5) || '/svc-' || s_suppkey
            WHEN 6 THEN 'ghost-' || s_suppkey WHEN 7 THEN ' SVC-' || s_suppkey || '.NS-' || (s_suppkey % 5) || ' '
            WHEN 4 THEN '' ELSE 'svc-' || s_suppkey || '.ns-' || (s_suppkey % 5) END AS from_ref,
       CASE WHEN s_suppkey % 19 = 1 THEN 'db-1'
            WHEN s_suppkey % 23 = 2 THEN 'svc-' || s_suppkey || '.ns-' || (s_suppkey % 5)
            WHEN s_suppkey % 3 = 2 THEN 'container:services/svc-' || s_suppkey
            WHEN s_suppkey % 2 = 0 THEN 'svc-' || (2 * s_suppkey + 1) || '.ns-' || ((2 * s_suppkey + 1) % 5)
            ELSE 'db-' || (s_suppkey % 4) || '.ns-' || (s_suppkey % 5) END AS to_ref,
       CASE s_suppkey % 7 WHEN 0 THEN 'Calls ' WHEN 1 THEN 'persists_to' WHEN 2 THEN 'talks_to' ELSE '' END AS kind,
       CASE WHEN s_suppkey % 4 = 0 THEN 'note ' || s_suppkey ELSE '' END AS note
FROM {supplier}
"""
VIEWS["fx_changes"] = """
SELECT 'repo-' || (user_id % 3) AS repo, 'svc-' || user_id || '.yaml' AS path, ts, event_id,
       event_type = 'error' AS deleted, props AS content
FROM {events}
"""

# ------------------------------------------------- manifests as JSON documents
VIEWS["fx_manifests"] = (
    "SELECT repo, k, format, 'deploy/' || format || '/' || k || '.json' AS path, doc FROM (\n"
    "SELECT 'repo-' || (k % 2) AS repo, k, 'workload' AS format, CASE WHEN k % 13 = 12 THEN '{broken' ELSE "
    + _json('{"apiVersion":"v1","kind":"', "=CASE k % 4 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' WHEN 2 THEN 'CronJob' ELSE 'Deployment' END",
            '","metadata":{"name":"svc-', "=k", '"', "=CASE WHEN k % 3 = 0 THEN '' ELSE ',\"namespace\":\"ns-' || (k % 5) || '\"' END",
            '},"spec":{', "=CASE WHEN k % 4 = 1 THEN '\"serviceName\":\"svc-' || k || '-headless\",' ELSE '' END",
            "=CASE WHEN k % 4 = 2 THEN '\"schedule\":\"0 3 * * *\",' ELSE '' END",
            '"replicas":', "=1 + k % 4",
            "=CASE WHEN k % 4 = 2 THEN ',\"jobTemplate\":{\"spec\":{\"template\":' WHEN k % 11 = 7 THEN ',\"noTemplate\":' ELSE ',\"template\":' END",
            '{"metadata":{"labels":{"app":"svc-', "=k", '","tier":"', "=k % 3", '"}},"spec":{"serviceAccountName":"sa-', "=k % 7",
            '","initContainers":[{"name":"init","image":"', "=CASE WHEN k % 6 = 0 THEN 'redis:7' ELSE 'busybox:1' END",
            '"}],"containers":[{"name":"main","image":"', "=CASE k % 5 WHEN 0 THEN 'ghcr.io/acme/app-' || k || ':1' WHEN 1 THEN 'postgres:16' WHEN 2 THEN 'nginx:1.25' WHEN 3 THEN 'rabbitmq:3' ELSE 'acme/worker' END",
            '","ports":[{"containerPort":', "=8000 + k % 10", '},{"containerPort":', "=9000 + k % 3",
            '}],"env":[{"name":"DB_URL","value":"postgres://u:p', "=k", '@db-', "=k % 40", ':5432/x"},',
            '{"name":"SECRET_HOST","valueFrom":{"secretKeyRef":{"name":"s","key":"k"}}},',
            '{"name":"CFG_HOST","valueFrom":{"configMapKeyRef":{"name":"cfg-', "=k % 9", '","key":"HOST"}}}],',
            '"envFrom":[{"configMapRef":{"name":"cfg-', "=k % 7", '"}}]}],"volumes":[{"name":"v","configMap":{"name":"cfg-', "=k % 5", '"}}]}}',
            "=CASE WHEN k % 4 = 2 THEN '}}' ELSE '' END", '}}')
    + " END AS doc FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'service', "
    + _json('{"apiVersion":"v1","kind":"Service","metadata":{"name":"alias-', "=k", '","namespace":"ns-', "=k % 5", '"},"spec":{',
            "=CASE WHEN k % 10 = 9 THEN '\"type\":\"ExternalName\",\"externalName\":\"db-' || k || '.example.org\"' WHEN k % 10 = 8 THEN '\"ports\":[]' ELSE '\"selector\":{\"app\":\"svc-' || k || '\"},\"ports\":[{\"port\":80},{\"port\":' || (8000 + k % 10) || '}]' END",
            '}}')
    + " FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'configmap', "
    + _json('{"apiVersion":"v1","kind":"ConfigMap","metadata":{"name":"cfg-', "=k", '"', "=CASE WHEN k % 3 = 0 THEN '' ELSE ',\"namespace\":\"ns-' || (k % 5) || '\"' END",
            '},"data":{"HOST":"svc-', "=k % 50", '","PAY_URL":"https://api-', "=k % 4", '.example.com","API_TOKEN":"x"}}')
    + " FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'ingress', "
    + _json('{"apiVersion":"v1","kind":"Ingress","metadata":{"name":"ing-', "=k", '","namespace":"ns-', "=k % 5", '"},"spec":{"ingressClassName":"nginx",',
            "=CASE WHEN k % 2 = 0 THEN '\"defaultBackend\":{\"service\":{\"name\":\"svc-' || k || '\",\"port\":{\"number\":80}}},' ELSE '\"backend\":{\"serviceName\":\"svc-' || k || '\",\"servicePort\":\"8080\"},' END",
            '"tls":[{"hosts":["t', "=k", '.example.com","w', "=k % 3", '.example.com"]}],"rules":[{"host":"w', "=k % 3",
            '.example.com","http":{"paths":[{"path":"/a","backend":{"service":{"name":"svc-', "=k + 1", '","port":{"number":', "=8000 + k % 10",
            '}}}},{"backend":{"serviceName":"svc-', "=k + 2", '","servicePort":81}}]}}]}}')
    + " FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'compose', CASE WHEN k % 13 = 12 THEN '[]x' ELSE "
    + _json('{"name":"stack-', "=k", '","services":{"web-', "=k", '":{"build":"', "=CASE k % 4 WHEN 0 THEN './app/../web' WHEN 1 THEN '/abs' WHEN 2 THEN '../../../../out' ELSE 'web' END",
            '","ports":["80', "=k % 10", ':8080","9090"],"expose":["7070"],"depends_on":["db","ghost"],"restart":"always","profiles":["dev"],',
            '"volumes":["data', "=k % 3", ':/var","./src:/src"],"environment":{"DB_HOST":"db:5432","APP_TOKEN":"abc","MODE":"dev"},"deploy":{"replicas":', "=1 + k % 3",
            '}},"db":{"image":"', "=CASE k % 3 WHEN 0 THEN 'postgres:16' WHEN 1 THEN 'redis:7' ELSE 'acme/custom' END", '"}}}')
    + " END FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'package', CASE WHEN k % 13 = 12 THEN '{' ELSE "
    + _json('{', "=CASE WHEN k % 7 = 6 THEN '' ELSE '\"name\":\"@acme/pkg-' || k || '\",' END", '"version":"1.0.', "=k % 9",
            '","engines":{"node":">=', "=16 + k % 4", '"},"dependencies":{"', "=CASE k % 3 WHEN 0 THEN 'express' WHEN 1 THEN '@nestjs/core' ELSE 'left-pad' END",
            '":"^4","@supabase/supabase-js":"2","pg":"8"},"devDependencies":{"', "=CASE WHEN k % 2 = 0 THEN 'typescript' ELSE 'jest' END", '":"5"}}')
    + " END FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'pyproject', "
    + _json("=CASE WHEN k % 2 = 0 THEN '{\"project\":{\"name\":\"py-' || k || '\",\"version\":\"0.' || k || '\",\"requires-python\":\">=3.9\",\"dependencies\":[\"fastapi>=0.1\",\"psycopg[binary]\",\"x y\"]}}' ELSE '{\"tool\":{\"poetry\":{\"name\":\"po-' || k || '\",\"dependencies\":{\"python\":\"^3.10\",\"Django\":\"4\",\"redis\":\"5\"}}}}' END")
    + " FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'chart', "
    + _json('{"name":"chart-', "=k", '","version":"0.', "=k % 5", '.0","dependencies":[{"name":"postgresql","alias":"', "=CASE WHEN k % 2 = 0 THEN 'db' ELSE '' END",
            '","version":"12"},{"name":"web-', "=k % 9", '","repository":"https://charts.example.com"}]}')
    + " FROM (SELECT s_suppkey AS k FROM {supplier}) s\n"
    "UNION ALL SELECT 'repo-' || (k % 2), k, 'values', "
    + _json("=CASE WHEN k % 2 = 0 THEN '{\"image\":{\"repository\":\"acme/app-' || k || '\",\"tag\":\"1\"},\"service\":{\"port\":80},\"env\":{\"DB_HOST\":\"db-' || (k % 40) || ':5432\",\"list\":[{\"REDIS_URL\":\"redis://cache-' || k || '\"},\"plain\"]}}' ELSE '{\"global\":{\"x\":1},\"web\":{\"name\":\"web-' || k || '\",\"service\":{\"port\":8080},\"enabled\":true,\"image\":{\"repository\":\"acme/web-' || k || '\"},\"replicaCount\":2},\"worker\":{\"name\":\"redis\",\"create\":false,\"image\":\"acme/worker\",\"resources\":{}},\"storage\":{\"name\":\"disk\",\"enabled\":true,\"size\":\"1Gi\",\"storageClass\":\"x\"},\"API_URL\":\"http://svc-' || (k % 50) || ':80\"}' END")
    + " FROM (SELECT s_suppkey AS k FROM {supplier}) s\n) m"
)

# ------------------------------------------------------- whole file trees, for scans
# Four files of one directory at a time (settings, build file, two dependency lists).
VIEWS["fx_scan_tree"] = """
SELECT 'repo-' || (g % 3) AS repo, file_key, 'apps/a' || g AS dir, file_name, content
FROM (SELECT *, cast(floor(file_key / 4) as bigint) AS g FROM {fx_files}) f
"""
VIEWS["fx_scan_manifests"] = """
SELECT repo, k, format, CASE format WHEN 'workload' THEN 'deploy/svc-' || k || '/workload.yaml'
         WHEN 'service' THEN 'deploy/svc-' || k || '/service.yaml' WHEN 'configmap' THEN 'deploy/svc-' || k || '/config.yaml'
         WHEN 'ingress' THEN 'deploy/svc-' || k || '/ingress.yaml' WHEN 'compose' THEN 'stacks/s-' || k || '/docker-compose.yml'
         WHEN 'package' THEN 'services/svc-' || k || '/package.json' WHEN 'pyproject' THEN 'services/svc-' || k || '/pyproject.toml'
         WHEN 'chart' THEN 'charts/c-' || k || '/Chart.yaml' ELSE 'charts/c-' || k || '/values.yaml' END AS path, doc
FROM {fx_manifests}
"""
VIEWS["fx_scan_files"] = """
SELECT repo, dir || '/' || file_name AS path, cast(length(content) as bigint) AS size, cast(1700000000 as bigint) AS mtime, content
FROM {fx_scan_tree}
UNION ALL SELECT repo, path, cast(length(doc) as bigint), cast(1700000000 as bigint), doc FROM {fx_scan_manifests}
UNION ALL SELECT 'repo-' || (page_id % 3), 'apps/p' || page_id || CASE WHEN page_id % 4 = 0 THEN '/big/package.json' WHEN page_id % 4 = 1 THEN '/fly.toml'
           ELSE '/Procfile' END, cast(CASE WHEN page_id % 4 = 0 THEN 2000000 + page_id ELSE length(html) END as bigint), cast(1700000000 as bigint),
       'web: x' FROM {pages}
"""

_TOKEN = re.compile(r"\{(\w+)\}")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in _TOKEN.findall(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Evaluate one view (or base table) over the parquet files of ``sf_dir``."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def source(match: re.Match) -> str:
        table = match.group(1)
        if table in BASE_TABLES:
            return f"parquet.`{sf_dir}/{table}.parquet`"
        return table if table in VIEWS else match.group(0)

    names = _needed("{" + name + "}", [])
    ctes = ",\n".join(f"{n} AS ({_TOKEN.sub(source, VIEWS[n])})" for n in names)
    return spark.sql(f"WITH {ctes}\nSELECT * FROM {name}")


def duck_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it names. ``extra`` holds further named
    SQL pieces (written for DuckDB only) that ``body`` may use."""
    pieces = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _TOKEN.findall(sql):
            if name in pieces and name not in order:
                visit(pieces[name])
                order.append(name)

    visit(body)

    def plain(sql: str) -> str:
        return _TOKEN.sub(
            lambda m: m.group(1) if m.group(1) in pieces or m.group(1) in BASE_TABLES else m.group(0),
            sql)

    if not order:
        return plain(body)
    ctes = ",\n".join(f"{n} AS ({plain(pieces[n])})" for n in order)
    return f"WITH RECURSIVE {ctes}\nSELECT * FROM ({plain(body)}) q"
