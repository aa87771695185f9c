"""Cluster manifests as JSON documents (one object per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions import ids, images, net
from archgraph.functions.redact import redact_value
from archgraph.functions.text import array_first

WORKLOADS = "Deployment StatefulSet DaemonSet ReplicaSet ReplicationController Job CronJob Pod Rollout".split()
DEFAULT_NAMESPACE = "default"

_REF = "struct<name:string,key:string>"
_CONTAINER = (
    "struct<name:string,image:string,ports:array<struct<containerPort:int>>,"
    f"env:array<struct<name:string,value:string,valueFrom:struct<configMapKeyRef:{_REF},secretKeyRef:{_REF}>>>,"
    "envFrom:array<struct<configMapRef:struct<name:string>>>>")
_POD = (f"struct<containers:array<{_CONTAINER}>,initContainers:array<{_CONTAINER}>,serviceAccountName:string,"
        "volumes:array<struct<name:string,configMap:struct<name:string>>>>")
_TEMPLATE = f"struct<metadata:struct<labels:map<string,string>>,spec:{_POD}>"
_BACKEND = "struct<service:struct<name:string,port:struct<number:int>>,serviceName:string>"
OBJECT = (
    "apiVersion string, kind string, metadata struct<name:string,namespace:string,labels:map<string,string>>, "
    f"spec struct<replicas:int,template:{_TEMPLATE},jobTemplate:struct<spec:struct<template:{_TEMPLATE}>>,schedule:string,serviceName:string,"
    f"containers:array<{_CONTAINER}>,initContainers:array<{_CONTAINER}>,selector:map<string,string>,type:string,externalName:string,"
    f"ports:array<struct<port:int>>,ingressClassName:string,defaultBackend:{_BACKEND},"
    f"rules:array<struct<host:string,http:struct<paths:array<struct<path:string,backend:{_BACKEND}>>>>>,tls:array<struct<hosts:array<string>>>>, "
    "data map<string,string>")


def objects(docs: DataFrame) -> DataFrame:
    """Documents that are named cluster objects, typed. ``docs``: repo, path,
    doc. The layout is declared; what does not fit reads as NULL."""
    o = docs.withColumn("o", F.from_json("doc", OBJECT)).select("repo", "path", "o.*")
    named = (F.coalesce("kind", F.lit("")) != "") & (F.coalesce("apiVersion", F.lit("")) != "") & (F.coalesce("metadata.name", F.lit("")) != "")
    ns = F.col("metadata.namespace")
    return o.where(named).withColumn("name", F.col("metadata.name")).withColumn(
        "namespace", F.when(F.coalesce(ns, F.lit("")) != "", ns).otherwise(DEFAULT_NAMESPACE))


def scope_of(namespace: Column) -> Column:
    return F.when(namespace == DEFAULT_NAMESPACE, F.lit("")).otherwise(namespace)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with_pod(objs: DataFrame) -> DataFrame:
    """Workloads with ``pod`` (NULL for a patch fragment), its containers (init
    first) and their kind."""
    w = objs.where(F.col("kind").isin(*WORKLOADS))
    bare = F.struct(F.col("spec.containers").alias("containers"), F.col("spec.initContainers").alias("initContainers"),
                    F.lit(None).cast("string").alias("serviceAccountName"),
                    F.lit(None).cast("array<struct<name:string,configMap:struct<name:string>>>").alias("volumes"))
    own = (F.size(F.coalesce("spec.containers", _none(_CONTAINER))) + F.size(F.coalesce("spec.initContainers", _none(_CONTAINER)))) > 0
    w = w.withColumn("pod", F.coalesce(
        F.when(F.col("spec.template").isNotNull(), F.coalesce(F.col("spec.template.spec"), bare)),
        F.when(F.col("spec.jobTemplate.spec.template").isNotNull(), F.coalesce(F.col("spec.jobTemplate.spec.template.spec"), bare)),
        F.when(own, bare)))
    containers = F.concat(F.coalesce("pod.initContainers", _none(_CONTAINER)), F.coalesce("pod.containers", _none(_CONTAINER)))
    w = w.withColumn("containers", containers)
    kinds = F.filter(F.transform("containers", lambda c: images.image_kind(F.coalesce(c["image"], F.lit("")))), lambda k: k["recognised"])
    w = w.withColumn("kinds", kinds)
    best = F.coalesce(array_first(F.filter("kinds", lambda k: k["kind"].isin("datastore", "queue"))),
                      array_first(F.filter("kinds", lambda k: k["kind"] != "service")))
    return w.withColumn("best", best)


def selector_labels(selector: Column) -> Column:
    """What a selector asks for: its ``matchLabels`` where it has some, else its
    plain entries; nested values read as JSON text and are no labels."""
    nested = F.from_json(F.try_element_at(selector, F.lit("matchLabels")), "map<string,string>")
    plain = F.map_filter(selector, lambda k, v: ~k.isin("matchLabels", "matchExpressions") & (v != ""))
    return F.when(F.size(F.coalesce(nested, F.create_map().cast("map<string,string>"))) > 0, nested).otherwise(plain)


def workloads(objs: DataFrame) -> DataFrame:
    """Running components. A controller without a pod template is a patch and
    gives none."""
    w = _with_pod(objs).where(F.col("pod").isNotNull() | (F.col("kind") == "Pod"))
    kind = F.coalesce("best.kind", F.lit("service"))
    pics = F.array_sort(F.array_distinct(F.filter(F.transform("containers", lambda c: c["image"]), lambda i: F.coalesce(i, F.lit("")) != "")))
    ports = F.array_sort(F.array_distinct(F.filter(
        F.flatten(F.transform("containers", lambda c: F.coalesce(F.transform(c["ports"], lambda p: p["containerPort"]), _none("int")))),
        lambda p: p > 0)))
    some = lambda m: F.when(F.size(m) > 0, m)
    labels = F.coalesce(some(F.col("spec.template.metadata.labels")), some(F.col("spec.jobTemplate.spec.template.metadata.labels")),
                        some(selector_labels(F.col("spec.selector"))), F.col("metadata.labels"))
    return w.select(
        "repo", "path", ids.node_id(kind, scope_of(F.col("namespace")), F.col("name")).alias("id"), kind.alias("kind"), "name", "namespace",
        F.col("kind").alias("workload"), F.coalesce("best.tech", F.lit("")).alias("framework"), pics.alias("images"), ports.alias("ports"),
        F.col("spec.replicas").alias("replicas"), F.when(F.col("spec.schedule") != "", F.col("spec.schedule")).alias("schedule"),
        labels.alias("labels"), F.col("pod.serviceAccountName").alias("service_account"), F.lit(100).alias("conf_pct"))


def patch_fragments(objs: DataFrame) -> DataFrame:
    return _with_pod(objs).where(F.col("pod").isNull() & (F.col("kind") != "Pod")).select(
        "repo", "path", F.lit("info").alias("severity"), F.lit("k8s_patch_fragment").alias("code"),
        F.concat("kind", F.lit(' "'), "name", F.lit('"')).alias("subject"))


def namespace_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boundaries, contains edges) for components with a namespace."""
    boundary = ids.node_id(F.lit("boundary"), scope_of(F.col("namespace")), F.col("namespace"))
    m = members.select("repo", "path", "namespace", boundary.alias("src"), F.col("id").alias("dst")).where("src <> dst")
    nodes = m.select("repo", F.col("src").alias("id"), F.lit("boundary").alias("kind"), F.col("namespace").alias("name"), "namespace").distinct()
    edges = m.select("repo", "src", "dst", F.lit("contains").alias("kind"), F.lit(100).alias("conf_pct"),
                     F.lit("k8s_namespace_member").alias("rule"), "path").distinct()
    return nodes, edges


def service_aliases(objs: DataFrame) -> DataFrame:
    """Services as routed names, and the governing services stateful workloads
    name."""
    s = objs.where("kind = 'Service'")
    external = F.when((F.col("spec.type") == "ExternalName") & (F.col("spec.externalName") != ""), F.col("spec.externalName"))
    selector = selector_labels(F.col("spec.selector"))
    ports = F.array_sort(F.array_distinct(F.filter(F.transform("spec.ports", lambda p: p["port"]), lambda p: p > 0)))
    services = s.select(
        "repo", "path", "name", "namespace", net.dns_names(F.col("name"), F.col("namespace")).alias("dns"),
        F.coalesce(ports, _none("int")).alias("ports"), selector.alias("selector"), F.lit(None).cast("string").alias("target_name"),
        external.alias("external"))
    governing = objs.where(F.col("kind").isin(*WORKLOADS) & (F.col("spec.serviceName") != "")).select(
        "repo", "path", F.col("spec.serviceName").alias("name"), "namespace",
        net.dns_names(F.col("spec.serviceName"), F.col("namespace")).alias("dns"), _none("int").alias("ports"),
        F.create_map().cast("map<string,string>").alias("selector"), F.col("name").alias("target_name"), F.lit(None).cast("string").alias("external"))
    return services.unionByName(governing)


def services_without_selector(aliases: DataFrame) -> DataFrame:
    return aliases.where("target_name IS NULL AND external IS NULL").where(F.size(F.coalesce("selector", F.create_map().cast("map<string,string>"))) == 0).select(
        "repo", "path", F.lit("k8s_service_without_selector").alias("code"), "name")


def ingresses(objs: DataFrame) -> DataFrame:
    i = objs.where("kind = 'Ingress'")
    hosts = F.array_union(F.coalesce(F.transform("spec.rules", lambda r: r["host"]), _none("string")),
                          F.coalesce(F.flatten(F.transform("spec.tls", lambda t: t["hosts"])), _none("string")))
    return i.select(
        "repo", "path", ids.node_id(F.lit("cloud_resource"), scope_of(F.col("namespace")), F.col("name")).alias("id"), "name", "namespace",
        F.col("spec.ingressClassName").alias("ingress_class"),
        F.array_sort(F.filter(hosts, lambda h: F.coalesce(h, F.lit("")) != "")).alias("hosts"),
        F.coalesce(F.size("spec.tls") > 0, F.lit(False)).alias("tls"), "spec")


def ingress_routes(objs: DataFrame) -> DataFrame:
    """One 'exposes' reference per backend, in both spellings of the API."""
    i = ingresses(objs)
    shape = f"array<struct<backend:{_BACKEND},route:string>>"
    by_rule = F.flatten(F.transform("spec.rules", lambda r: F.transform(r["http"]["paths"], lambda p: F.struct(
        p["backend"].alias("backend"), F.concat(F.coalesce(r["host"], F.lit("")), F.coalesce(p["path"], F.lit(""))).alias("route")))))
    default = F.when(F.col("spec.defaultBackend").isNotNull(), F.array(F.struct(
        F.col("spec.defaultBackend").alias("backend"), F.lit("the default route").alias("route"))))
    every = F.concat(F.coalesce(default.cast(shape), F.array().cast(shape)), F.coalesce(by_rule.cast(shape), F.array().cast(shape)))
    b = i.select("repo", "path", "id", "namespace", F.explode(every).alias("b"))
    service = F.coalesce(F.when(F.col("b.backend.service.name") != "", F.col("b.backend.service.name")), F.col("b.backend.serviceName"), F.lit(""))
    return b.select(
        "repo", "path", F.col("id").alias("from_node"), F.lit("selector").alias("kind"), service.alias("raw"),
        net.dns_names(service, F.col("namespace")).alias("tokens"), F.coalesce("b.backend.service.port.number", F.lit(0)).alias("port"),
        F.lit("http").alias("protocol"), F.lit("exposes").alias("suggested_edge"),
        F.when(F.col("b.route") == "", F.lit("/")).otherwise(F.col("b.route")).alias("route")).where("raw <> ''")


def configmap_ref(namespace: Column, name: Column) -> Column:
    return F.concat(F.lit("configmap:"), namespace, F.lit("/"), name)


def configmap_values(objs: DataFrame) -> DataFrame:
    """References held by config maps, keyed by the map."""
    v = objs.where("kind = 'ConfigMap'").select("repo", "path", "name", "namespace", F.explode("data").alias("key", "value")).where("value IS NOT NULL")
    refs = net.parse_references(v, "key", "value")
    masked = redact_value(F.col("key"), F.col("value"))
    return refs.select(
        "repo", "path", configmap_ref(F.col("namespace"), F.col("name")).alias("ref"), "key", masked.alias("raw"),
        F.col("ref.tokens").alias("tokens"), F.col("ref.port").alias("port"), F.col("ref.protocol").alias("protocol"),
        F.col("ref.edge").alias("suggested_edge"),
        F.concat(F.lit('ConfigMap "'), "name", F.lit('" key '), "key", F.lit("="), masked).alias("detail"))


def _owned_containers(objs: DataFrame) -> DataFrame:
    w = _with_pod(objs).where(F.col("pod").isNotNull())
    kind = F.coalesce("best.kind", F.lit("service"))
    return w.select("repo", "path", "namespace", "pod", "containers",
                    ids.node_id(kind, scope_of(F.col("namespace")), F.col("name")).alias("from_node"))


def configmap_uses(objs: DataFrame) -> DataFrame:
    """Workloads that take values from a config map: a key, a whole
    environment, or a mounted volume."""
    w = _owned_containers(objs)
    c = w.select("repo", "path", "namespace", "from_node", F.explode("containers").alias("c"))
    env = c.select("*", F.explode("c.env").alias("e")).where("e.valueFrom.configMapKeyRef IS NOT NULL").select(
        "repo", "path", "namespace", "from_node", F.col("e.valueFrom.configMapKeyRef.name").alias("map"),
        F.concat(F.lit("env "), "e.name", F.lit(' comes from ConfigMap "'), "e.valueFrom.configMapKeyRef.name", F.lit('" key "'),
                 "e.valueFrom.configMapKeyRef.key", F.lit('"')).alias("detail"))
    whole = c.select("*", F.explode("c.envFrom").alias("e")).where("e.configMapRef IS NOT NULL").select(
        "repo", "path", "namespace", "from_node", F.col("e.configMapRef.name").alias("map"),
        F.concat(F.lit('container "'), "c.name", F.lit('" takes its environment from ConfigMap "'), "e.configMapRef.name", F.lit('"')).alias("detail"))
    vols = w.select("repo", "path", "namespace", "from_node", F.explode("pod.volumes").alias("v")).where("v.configMap IS NOT NULL").select(
        "repo", "path", "namespace", "from_node", F.col("v.configMap.name").alias("map"),
        F.concat(F.lit('volume "'), "v.name", F.lit('" mounts ConfigMap "'), "v.configMap.name", F.lit('"')).alias("detail"))
    return env.unionByName(whole).unionByName(vols).select(
        "repo", "path", "from_node", configmap_ref(F.col("namespace"), F.col("map")).alias("ref"), "detail")


def container_env(objs: DataFrame) -> DataFrame:
    """Literal environment values that locate something; values that come from
    elsewhere are not read."""
    e = _owned_containers(objs).select("repo", "path", "from_node", F.explode("containers").alias("c")).select(
        "repo", "path", "from_node", F.col("c.name").alias("container"), F.explode("c.env").alias("e")).where(
        "e.valueFrom IS NULL AND e.value IS NOT NULL").select("repo", "path", "from_node", "container", F.col("e.name").alias("key"), F.col("e.value").alias("value"))
    refs = net.parse_references(e, "key", "value")
    masked = redact_value(F.col("key"), F.col("value"))
    return refs.select(
        "repo", "path", "from_node", F.col("ref.kind").alias("kind"), masked.alias("raw"), F.col("ref.tokens").alias("tokens"),
        F.col("ref.port").alias("port"), F.col("ref.protocol").alias("protocol"), F.col("ref.edge").alias("suggested_edge"),
        F.concat(F.lit('container "'), "container", F.lit('" env '), "key", F.lit("="), masked).alias("detail"))
