"""Package dependencies and what they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions.text import array_first, constants, let, lookup, strip


def normalize_dependency(dep: Column) -> Column:
    text = strip(dep)
    text = F.when(text.rlike(r"^[^\[]+\["), F.regexp_extract(text, r"^([^\[]+)\[", 1)).otherwise(text)
    text = F.regexp_replace(text, r"^(.+)/v[0-9]+$", "$1")
    go_path = F.contains(text, F.lit("/")) & ~F.startswith(text, F.lit("@"))
    return F.when(go_path, text).otherwise(F.lower(F.translate(text, "_", "-")))


def _exact_or_family(name: Column, exact: dict[str, object], families: list[str]) -> Column:
    """Exact entry, else the longest family that prefixes the name. Families
    are tried longest first, so the first hit is the longest."""
    ordered = sorted(families, key=lambda f: (-len(f), f))
    family = array_first(F.filter(constants(ordered), lambda f: F.startswith(name, f)))
    return F.coalesce(lookup(exact, name), lookup(exact, family))


def library_of(dep: Column, extra: dict[str, tuple[str, str, str]] | None = None) -> Column:
    """struct(tech, kind, edge) a dependency implies, else NULL."""
    known = {d: (t, k, e) for d, t, k, e in vocab.rows(vocab.LIBRARIES)} | (extra or {})
    exact = {d: {"tech": t, "kind": k, "edge": e} for d, (t, k, e) in known.items()}
    families = [d for d in known if "/" in d or d.endswith("-")]
    return let(normalize_dependency(dep), lambda n: _exact_or_family(n, exact, families))


def framework_of(dep: Column, extra: dict[str, str] | None = None) -> Column:
    known = dict(vocab.rows(vocab.FRAMEWORKS)) | (extra or {})
    families = [d for d in known if "/" in d]
    return let(normalize_dependency(dep), lambda n: _exact_or_family(n, known, families))


def is_vendor(tech: Column) -> Column:
    return tech.isin(*vocab.words(vocab.VENDOR_TECHNOLOGIES))


def requirement_name(line: Column) -> Column:
    """Package name of one requirement line; '' when the line names none."""
    text = strip(F.regexp_replace(line, r"#.*$", ""))
    text = strip(F.regexp_replace(text, r"[;@=<>!~].*$", ""))
    return F.when(text.rlike(r"^-") | text.rlike(r"[\s/\\]"), F.lit("")).otherwise(text)
