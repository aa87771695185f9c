"""Container image references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions.text import array_first, constants, let, lookup, strip


def parse_image(ref: Column) -> Column:
    """struct(registry, repository, name, tag, digest); absent parts are ''."""
    text = strip(ref)
    tagged = F.substring_index(text, "@", 1)
    # a leading segment is a registry if it has a dot, a port, or is localhost
    registry = r"^([^/]*[.:][^/]*|localhost)/"
    bare = F.regexp_replace(tagged, r":[^:/]*$", "")
    repository = F.regexp_replace(bare, registry, "")
    return F.struct(
        F.regexp_extract(bare, registry, 1).alias("registry"),
        repository.alias("repository"),
        F.substring_index(repository, "/", -1).alias("name"),
        F.regexp_extract(tagged, r":([^:/]*)$", 1).alias("tag"),
        F.regexp_extract(text, r"^[^@]*@(.*)$", 1).alias("digest"),
    )


def name_variants(name: Column) -> Column:
    """The name, the name without a publisher prefix, then without each
    distribution suffix, in that order."""
    prefix = "^(" + "|".join(vocab.words(vocab.IMAGE_PREFIXES)) + ")"
    suffixes = vocab.words(vocab.IMAGE_SUFFIXES)
    return let(F.lower(name), lambda base: let(
        F.regexp_replace(base, prefix, ""),
        lambda short: F.array_distinct(F.array(
            base, short, *[F.regexp_replace(short, s + "$", "") for s in suffixes]))))


def image_kind(ref: Column, extra: dict[str, tuple[str, str]] | None = None) -> Column:
    """struct(kind, tech, recognised); ``extra`` adds image names."""
    known = {n: (k, t) for n, k, t in vocab.rows(vocab.IMAGES)} | (extra or {})
    entries = {n: {"kind": k, "tech": t} for n, (k, t) in known.items()}
    hit = array_first(F.filter(
        F.transform(name_variants(parse_image(ref)["name"]), lambda v: lookup(entries, v)),
        lambda h: h.isNotNull()))
    return let(hit, lambda h: F.struct(
        F.coalesce(h["kind"], F.lit("service")).alias("kind"),
        F.coalesce(h["tech"], F.lit("")).alias("tech"),
        h.isNotNull().alias("recognised")))


def base_image_language(ref: Column) -> Column:
    """Implementation language a base image stands for, else NULL."""
    languages = dict(vocab.rows(vocab.BASE_IMAGE_LANGUAGES))
    dotnet = vocab.words(vocab.DOTNET_IMAGES)
    image = parse_image(ref)
    is_dotnet = F.contains(F.lower(image["repository"]), F.lit("dotnet"))
    return array_first(F.filter(
        F.transform(name_variants(image["name"]),
                    lambda v: F.coalesce(lookup(languages, v), F.when(v.isin(*dotnet) & is_dotnet, F.lit("csharp")))),
        lambda l: l.isNotNull()))


def base_image_is_os(ref: Column) -> Column:
    image = parse_image(ref)
    systems = vocab.words(vocab.OS_IMAGES)
    return (
        (F.lower(strip(ref)) == "scratch")
        | F.contains(F.lower(image["repository"]), F.lit("distroless"))
        | F.arrays_overlap(name_variants(image["name"]), constants(systems))
    )
