"""Personal data: base patterns, and bootstrapped contextual extraction.

DataFrame functions only. Base kinds are matched by fixed patterns. Beyond
them, seed entities (base matches) induce lexical patterns: the two words
before an identifier, and the words on either side of it. Patterns and
identifier-like words (with a digit or an at sign) form a graph whose edges are
distinct over the corpus; each round scores patterns by their scored share of
instances, and instances by the patterns they occur in, so that instances found
in one round support patterns of the next. Words that a high-confidence pattern
surrounds, and that no base span touches, are spans of kind ``found``.

Null texts count as empty. Spans are in code points, end exclusive. Rows of one
doc_id with different texts are kept apart; repeated rows get equal results.
Extra columns are ignored by ``find`` and kept by ``redact``. Without seeds no
pattern is learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import as_row, Scratch, join_hot

# Fixed patterns of the base kinds. Possessive repeats and look-behinds only keep searches linear in long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
#: Identifier-like words, as far as their letters and digits go.
_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*+"
#: Characters around a word in which its context is looked for.
AROUND = 64


def _spans(text: Column, pattern: str, there: Column) -> tuple[Column, Column]:
    """Matches of a pattern and the texts between them."""
    none = F.array().cast("array<string>")
    found = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return found, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none)


def _placed(found: str, between: str) -> str:
    """SQL for (m, s, e) of each match, from running lengths."""
    return f"""aggregate(sequence(0, size({found}) - 1), struct(0 AS at, cast(array() AS array<struct<m: string, s: int, e: int>>) AS got),
        (a, i) -> struct(a.at + length({between}[i]) + length({found}[i]) AS at,
            array_append(a.got, struct({found}[i] AS m, a.at + length({between}[i]) AS s,
                                       a.at + length({between}[i]) + length({found}[i]) AS e)) AS got), a -> a.got)"""


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), text, and ``base``: (kind, s, e) by kind, then start."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    key = F.concat_ws(":", F.xxhash64("doc_id", "text"), F.xxhash64("text", F.coalesce("doc_id", F.lit(-1))))
    rows = rows.withColumn("key", key)
    t = F.col("text")
    digit = t.rlike("[0-9]")
    patterns = {"email": (EMAIL, F.contains(t, F.lit("@"))), "ip": (IP, digit), "card": (CARD, digit),
                "phone": (PHONE, F.contains(t, F.lit("+"))), "word": (_WORD, digit | F.contains(t, F.lit("@")))}
    columns = []
    for kind, (pattern, there) in patterns.items():
        found, between = _spans(t, pattern, there)
        columns += [found.alias(f"{kind}_found"), between.alias(f"{kind}_between")]
    rows = rows.select("doc_id", "key", "text", *columns)
    rows = rows.select("doc_id", "key", "text", *(
        F.expr(f"CASE WHEN size({k}_found) > 0 THEN {_placed(f'{k}_found', f'{k}_between')} "
               "ELSE cast(array() AS array<struct<m: string, s: int, e: int>>) END").alias(k) for k in patterns))
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    valid = {
        "email": "true",
        "ip": "forall(split(x.m, '[.]'), p -> coalesce(try_cast(p AS int) <= 255, false))",
        "card": f"{digits} BETWEEN 13 AND 19 AND luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
        "phone": f"{digits} BETWEEN 9 AND 15",
    }
    parts = ", ".join(f"transform(filter({k}, x -> {ok}), x -> struct('{k}' AS kind, x.s AS s, x.e AS e))" for k, ok in valid.items())
    return rows.select("doc_id", "key", "text", F.expr(f"concat({parts})").alias("base"), F.col("word").alias("words"))


def _candidates(rows: DataFrame) -> DataFrame:
    """One row per identifier-like word: key, s, e, instance, seed (touches a base span), patterns."""
    one = rows.where("size(words) > 0").select("key", "text", "base", F.explode("words").alias("w"))
    near = one.select(
        "key", F.col("w.s").alias("s"), F.col("w.e").alias("e"), F.col("w.m").alias("m"),
        F.expr("exists(base, b -> b.s < w.e AND b.e > w.s)").alias("seed"),
        F.lower(F.expr(f"substring(text, greatest(w.s - {AROUND}, 0) + 1, least(w.s, {AROUND}))")).alias("before"),
        F.lower(F.expr(f"substring(text, w.e + 1, {AROUND})")).alias("after"))
    split = r"[\x20\x09-\x0D]+"
    near = near.withColumn("before", F.split(F.rtrim(F.regexp_replace("before", split, " ")), " "))
    near = near.withColumn("after", F.split(F.ltrim(F.regexp_replace("after", split, " ")), " "))
    left1, left2, right1 = "coalesce(try_element_at(before, -1), '')", "coalesce(try_element_at(before, -2), '')", "after[0]"
    patterns = F.expr(f"array(concat({left2}, ' ', {left1}, ' _'), concat({left1}, ' _ ', {right1}))")
    # Surrounding punctuation is no part of an identifier.
    lead = F.length("m") - F.length(F.regexp_replace("m", r"^[^\p{L}\p{N}@+]+", ""))
    tail = F.length("m") - F.length(F.regexp_replace("m", r"[^\p{L}\p{N}@]++$", ""))
    near = near.select("key", "seed", "m", (F.col("s") + lead).cast("int").alias("s"),
                       (F.col("e") - tail).cast("int").alias("e"), patterns.alias("patterns"), lead.alias("lead"))
    near = near.where("e > s")
    return near.select("key", "s", "e", "seed", F.expr("lower(substring(m, lead + 1, e - s))").alias("instance"), "patterns")


def confident_patterns(found: DataFrame, scratch: Scratch, rounds: int, confidence: float, support: int) -> DataFrame:
    """Patterns whose score reaches ``confidence`` after ``rounds`` over the pattern-instance graph."""
    each = found.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = scratch.save(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    # Only patterns that some seed occurs in can score in the first round, and only their neighbours later.
    by_instance = scratch.save(edges.groupBy("instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "instances")
    by_pattern = scratch.save(edges.groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    scores = by_instance.where("seed").select("instance", F.lit(1.0).alias("score"))
    kept: DataFrame | None = None
    for _ in range(rounds):
        scored = join_hot(edges.select("pattern", "instance"), scores, "instance", by_instance.select("instance", "n"))
        sums = scored.groupBy("pattern").agg(F.sum("score").alias("score"), F.count("*").alias("hits"))
        trust = sums.join(by_pattern, "pattern").where(F.col("hits") >= support)
        # The share of a pattern's instances that are entities, less where few instances support it.
        trust = trust.select("pattern", (F.col("score") / F.col("n") * F.col("hits") / (F.col("hits") + 1)).alias("trust"))
        kept = scratch.save(trust.where(F.col("trust") >= confidence), "trust")
        met = join_hot(edges.where("not seed").select("pattern", "instance"), kept, "pattern", by_pattern.select("pattern", "n"))
        # An instance is an entity unless all of its patterns err.
        new = met.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        new = new.where(F.col("score") >= confidence)
        seeds = by_instance.where("seed").select("instance", F.lit(1.0).alias("score"))
        scores = scratch.save(seeds.unionByName(new).groupBy("instance").agg(F.max("score").alias("score")), "scores")
    return kept


def find(docs: DataFrame, rounds: int = 3, confidence: float = 0.7, support: int = 3) -> DataFrame:
    """(doc_id, key, base, found): spans of the base kinds and those that patterns discover, one row per document."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = base_spans(docs)
    found = scratch.save(_candidates(rows), "candidates")
    trusted = confident_patterns(found, scratch, rounds, confidence, support)
    often = scratch.save(found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")), "often")
    open_ = found.where("not seed").select("key", "s", "e", F.explode("patterns").alias("pattern"))
    new = join_hot(open_, trusted.select("pattern"), "pattern", often)
    new = scratch.save(new.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("found")), "found")
    empty = F.expr("cast(array() AS array<struct<kind: string, s: int, e: int>>)")
    as_spans = F.expr("transform(found, x -> struct('found' AS kind, x.s AS s, x.e AS e))")
    plain = rows.select("doc_id", "key", "base").join(new, "key", "left")
    return plain.select("doc_id", "key", "base", F.coalesce(as_spans, empty).alias("found"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and spans."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.concat("base", "found")).alias("spans"))


def redact(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each span's text, overlapping ones together, replaced by its kind in brackets; n_chars follows."""
    spans = find(docs, **parameters).where("size(base) + size(found) > 0")
    spans = spans.groupBy("key").agg(F.first(F.sort_array(F.transform(
        F.concat("base", "found"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))).alias("_spans"))
    key = F.concat_ws(":", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))),
                      F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(-1))))
    hidden = F.expr("""aggregate(_spans, struct('' AS out, 0 AS at), (a, x) -> CASE
        WHEN x.s >= a.at THEN struct(concat(a.out, substring(text, a.at + 1, x.s - a.at), '[', upper(x.kind), ']') AS out, x.e AS at)
        ELSE struct(a.out AS out, greatest(a.at, x.e) AS at) END, a -> concat(a.out, substring(text, a.at + 1)))""")
    rows = docs.select(key.alias("_key"), "text", as_row(docs))
    out = rows.hint("merge").join(spans.withColumnRenamed("key", "_key"), "_key", "left")
    found = F.col("_spans").isNotNull()
    out = out.withColumn("_hidden", F.when(found, hidden).otherwise(F.col("text")))
    new = {"text": F.col("_hidden"), "n_chars": F.when(found, F.length("_hidden").cast("long"))}
    own = lambda c: F.col(f"row.`{c}`")
    return out.select(*(F.coalesce(new[c], own(c)).alias(c) if c in new else own(c).alias(c) for c in docs.columns))
