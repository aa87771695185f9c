"""Small building blocks shared by the column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def any_of(c: Column, words: list[str]) -> Column:
    """True where ``c`` contains one of ``words``; one alternation, one pass."""
    return c.rlike("|".join(re.escape(w) for w in words))


def cut_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, re.escape(suffix) + "$", "")


def array_first(c: Column) -> Column:
    """First element or NULL, also for an empty array."""
    return F.get(c, F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` with the value computed once per row. Without
    it, an expression that mentions a long sub-expression several times grows
    multiplicatively when projections are merged."""
    return array_first(F.transform(F.array(value), body))


def _spelled(value: object) -> str:
    """A constant as SQL: text, numbers, lists, and records (dict) as structs."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"{_spelled(k)}, {_spelled(v)}" for k, v in value.items()) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(map(_spelled, value)) + ")"
    return str(value)


def constants(words: list[str]) -> Column:
    """A constant list as an array."""
    return F.expr(_spelled(words))


def lookup(entries: dict[str, object], key: Column) -> Column:
    """A constant map probed by ``key``: text, number or record (dict) per word.
    The map is a literal, parsed at once, so there is no join and nothing to
    shuffle; use it for vocabulary-sized tables only."""
    return F.try_element_at(F.expr("map(" + ", ".join(f"{_spelled(k)}, {_spelled(v)}" for k, v in entries.items()) + ")"), key)


def estimate_tokens(c: Column) -> Column:
    """Token estimate of a text: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 4).cast("int")


def round_confidence(c: Column) -> Column:
    """Hundredths of a confidence: clamped to 0..100, halves away from zero."""
    return (
        F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(0))
        .when(F.abs(c) == float("inf"), F.lit(0))
        .when(c > 1, F.lit(100))
        .otherwise(F.floor(c * 100 + 0.5).cast("int"))
    )
