"""Credential masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archgraph import vocab
from archgraph.functions.text import let, strip

_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"


def is_secret_key(key: Column) -> Column:
    upper = F.regexp_replace(F.upper(strip(key)), r"[^\p{L}\p{Nd}]", "_")
    words = F.regexp_replace(upper, r"(\p{Nd})(\p{Lu})", "$1_$2")
    exceptions = "|".join(vocab.words(vocab.SECRET_KEY_EXCEPTIONS))
    substrings = "|".join(vocab.words(vocab.SECRET_KEY_SUBSTRINGS))
    segments = "|".join(vocab.words(vocab.SECRET_KEY_SEGMENTS))
    return (~upper.rlike(f"(^|_)({exceptions})$")
            & (upper.rlike(substrings) | words.rlike(f"(^|_)({segments})(_|$)")))


def _where_present(text: Column, hints: list[str], pattern: str, mask: str) -> Column:
    """Replace only in texts that hold one of the literal parts every match
    needs; most texts hold none, and a substring search is far cheaper than
    the expression."""
    def body(t: Column) -> Column:
        present = F.contains(t, F.lit(hints[0]))
        for h in hints[1:]:
            present = present | F.contains(t, F.lit(h))
        return F.when(present, F.regexp_replace(t, pattern, mask)).otherwise(t)

    return let(text, body)


def redact_string(text: Column) -> Column:
    out = _where_present(text, ["PRIVATE KEY-----"], vocab.PEM_PATTERN, vocab.PEM_MASK)
    out = _where_present(out, ["://"], vocab.URL_USERINFO_PATTERN, f"$1{vocab.MASK}:{vocab.MASK}@")
    out = _where_present(out, vocab.words(vocab.AWS_KEY_STARTS), _START + vocab.AWS_KEY_PATTERN + _END, vocab.MASK)
    out = _where_present(out, vocab.words(vocab.TOKEN_STARTS), _START + vocab.PREFIXED_TOKEN_PATTERN, vocab.MASK)
    return _where_present(out, ["eyJ"], _START + vocab.JWT_PATTERN, vocab.MASK)


def redact_value(key: Column, text: Column) -> Column:
    return (F.when(text == "", text).when(is_secret_key(key), F.lit(vocab.MASK))
            .otherwise(redact_string(text)))
