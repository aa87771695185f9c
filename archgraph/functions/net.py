"""Hosts, ports and configuration values that locate another component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions.text import array_first, cut_suffix, let, lookup, strip

# scheme, user-info, host, port of a URL authority; the authority ends at the
# first of / ? # or at the end of the value
_URL = (r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)?"
        r"([A-Za-z0-9._\-]+)(?::([0-9]*))?(?:$|[/?#])")
_BAD_ESCAPE = r"%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))"
_HOST_PORT = r"^([A-Za-z0-9._\-]+?)\.?(?::([^:\[\]]*))?$"


def is_reference_key(key: Column) -> Column:
    suffix = "|".join(vocab.words(vocab.REFERENCE_KEY_SUFFIXES))
    upper = F.upper(key)
    return upper.isin(*vocab.words(vocab.REFERENCE_KEYS)) | upper.rlike(f"({suffix})$")


def valid_port(text: Column) -> Column:
    number = F.when(text.rlike(r"^\+?[0-9]{1,18}$"), text.try_cast("bigint"))
    return F.when(number.between(1, 65535), number.cast("int"))


def port_convention(port: Column) -> Column:
    """struct(protocol, edge) of a well-known port, else NULL."""
    entries = {p: {"protocol": proto, "edge": edge}
               for p, proto, edge in vocab.rows(vocab.PORT_CONVENTIONS)}
    return lookup(entries, port.cast("string"))


def plausible_host(host: Column) -> Column:
    return (
        host.rlike(r"^[A-Za-z0-9._\-]+$")
        & host.rlike("[A-Za-z]")
        & (F.octet_length(host) <= 253)
        & ~F.lower(host).isin(*vocab.words(vocab.NON_HOSTS))
    )


def is_public_suffix(label: Column) -> Column:
    return (F.octet_length(label) == 2) | label.isin(*vocab.words(vocab.PUBLIC_SUFFIXES))


def is_external_host(host: Column) -> Column:
    last = F.substring_index(host, ".", -1)
    return (F.contains(host, F.lit("."))
            & ~last.isin(*vocab.words(vocab.INTERNAL_SUFFIXES)) & is_public_suffix(last))


def host_tokens(host: Column) -> Column:
    """Names a host may be known by, most specific first; public domains are
    kept in one piece."""
    full = F.lower(cut_suffix(host, "."))
    inner = cut_suffix(cut_suffix(cut_suffix(full, ".svc.cluster.local"), ".cluster.local"), ".svc")

    def shorter(labels: Column) -> Column:
        divisible = (F.size(labels) > 1) & ~is_public_suffix(F.element_at(labels, -1))
        lengths = F.when(divisible, F.sequence(F.size(labels) - 1, F.lit(1), F.lit(-1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(lengths, lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))

    return F.array_distinct(F.filter(
        F.concat(F.array(full, inner), let(F.split(inner, r"\."), shorter)), lambda t: t != ""))


def dns_names(name: Column, namespace: Column) -> Column:
    ns = F.coalesce(F.when(namespace != "", namespace), F.lit("default"))
    dotted = F.concat_ws(".", name, ns)
    return F.when(name != "", F.array(
        F.concat(dotted, F.lit(".svc.cluster.local")), F.concat(dotted, F.lit(".svc")), dotted, name))


def _url_reference(value: Column) -> Column:
    schemes = {s: {"protocol": p, "edge": e, "port": int(n)}
               for s, p, e, n in vocab.rows(vocab.SCHEMES)}
    readable = (value.rlike(_URL) & ~value.rlike(r"[\x00-\x1f\x7f]")
                & ~F.regexp_replace(value, r"\?[^#]*", "").rlike(_BAD_ESCAPE))
    parts = F.when(readable, F.struct(
        lookup(schemes, F.lower(F.regexp_extract(value, _URL, 1))).alias("scheme"),
        F.regexp_extract(value, _URL, 2).alias("host"),
        F.regexp_extract(value, _URL, 3).alias("port")))
    return let(parts, lambda u: F.when(
        u["scheme"].isNotNull() & plausible_host(u["host"]),
        F.struct(
            F.when(u["scheme"]["edge"] == "calls", F.lit("env_url")).otherwise("conn_string").alias("kind"),
            host_tokens(u["host"]).alias("tokens"),
            F.coalesce(valid_port(u["port"]), u["scheme"]["port"]).alias("port"),
            u["scheme"]["protocol"].alias("protocol"),
            u["scheme"]["edge"].alias("edge"))))


def _host_reference(value: Column) -> Column:
    """host[:port], or the first usable member of a comma-separated list."""

    def address(part: Column) -> Column:
        return F.struct(F.regexp_extract(part, _HOST_PORT, 1).alias("host"),
                        F.coalesce(valid_port(F.regexp_extract(part, _HOST_PORT, 2)), F.lit(0)).alias("port"))

    members = F.transform(F.split(value, ","), lambda p: address(strip(p)))
    usable = array_first(F.filter(members, lambda a: plausible_host(a["host"])))
    return let(usable, lambda a: F.when(a.isNotNull(), let(
        port_convention(a["port"]),
        lambda c: F.struct(
            F.lit("env_host").alias("kind"),
            host_tokens(a["host"]).alias("tokens"),
            a["port"].alias("port"),
            F.coalesce(c["protocol"], F.lit("")).alias("protocol"),
            F.coalesce(c["edge"], F.lit("calls")).alias("edge")))))


def parse_value(key: Column, value: Column) -> Column:
    """struct(kind, tokens, port, protocol, edge) of a configuration value that
    locates something, else NULL. The key is consulted for bare hosts only."""
    text = strip(value)
    fillable = F.contains(text, F.lit("${")) | F.contains(text, F.lit("$("))
    return F.when(~fillable & (text != ""), F.coalesce(
        F.when(F.contains(text, F.lit("://")), _url_reference(text)),
        F.when(is_reference_key(key), _host_reference(text))))


def parse_references(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``df`` whose value is a reference, with it as ``ref``: one of a
    list of at most one, as a filter would parse every value a second time."""
    return df.withColumn("ref", F.explode(F.array_compact(F.array(parse_value(F.col(key), F.col(value))))))
