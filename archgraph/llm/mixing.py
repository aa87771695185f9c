"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

DataFrame functions only. Documents are summed to cells (source, language,
topic); each round rakes the cells' token weights to the targets of the three
marginals in turn until all agree. A document's weight is its cell's factor; its
probability is the factor times a common rate, at most 1, with the rate solved
so that the expected tokens are ``share`` of all. The draw is a digest of the
id, so it does not depend on partitioning.

Default targets are tempered: each value's share of tokens to the power
``alpha``, normalised. Null texts have no tokens; null sources and languages are
values of their own. Values without tokens keep factor 1. Repeated rows draw
alike; extra columns are ignored by ``weigh`` and kept by ``sample``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import Scratch, join_hot

MARGINALS = ["source", "lang", "topic"]
#: Topics by the first pattern that a text matches.
TOPICS = {
    "legal": "(?i)licen[sc]e|rights reserved|copyright",
    "contact": r"@[A-Za-z0-9-]+\.|\+[0-9]",
    "table": r" \| ",
    "figures": r"[0-9]{4}",
}


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(TOPICS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words) and the cell's key."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")
    rows = docs.select("doc_id", "source", "lang", topic_of(text).alias("topic"), n.alias("n_tokens"))
    return rows.withColumn("cell", F.to_json(F.struct(*MARGINALS)))


def tempered(cells: DataFrame, column: str, alpha: float) -> DataFrame:
    """(value, target): shares of tokens to the power alpha, which add to 1."""
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    power = sums.select(F.col(column).alias("value"), F.pow(F.col("tokens").cast("double"), F.lit(alpha)).alias("p"))
    return power.crossJoin(F.broadcast(power.agg(F.sum("p").alias("_all")))).select("value", (F.col("p") / F.col("_all")).alias("target"))


def rake(cells: DataFrame, scratch: Scratch, targets: dict[str, DataFrame] | None, alpha: float,
         tolerance: float, patience: int, rounds: int | None) -> DataFrame:
    """``cells`` with the factor that brings all marginals to their targets, however many rounds that takes.

    Raises ValueError where ``patience`` rounds bring them no nearer: targets
    that contradict each other, or that the cells cannot meet. With ``rounds``
    such targets are only approached: the factors are those of that round, at
    which the last marginal is met, and a warning says how far others stay off.
    """
    columns = cells.columns
    for c in MARGINALS:
        target = (targets or {}).get(c) or tempered(cells, c, alpha)
        target = target.select(F.col("value").alias("_v"), F.col("target").alias(f"t_{c}"))
        cells = cells.join(target, F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    total = cells.agg(F.sum("tokens").alias("total"))
    now = scratch.save(cells.crossJoin(F.broadcast(total)).withColumn("factor", F.lit(1.0)), "cells")
    nearest, stalled, done = float("inf"), 0, 0
    while True:
        after = now
        for c in MARGINALS:
            sums = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(c))
            wanted = F.col(f"t_{c}") * F.col("total") / sums
            after = after.withColumn("step", F.when(sums > 0, wanted)).withColumn(
                "factor", F.col("factor") * F.coalesce("step", F.lit(1.0))).withColumn(f"off_{c}", F.abs(F.coalesce("step", F.lit(1.0)) - 1))
        after = after.withColumn("off", F.greatest(*(f"off_{c}" for c in MARGINALS))).select(*now.columns, "off")
        after = scratch.save(after, "cells")
        off = after.agg(F.max("off")).first()[0]
        scratch.drop(now)
        now = after.drop("off")
        now.scratch_path = after.scratch_path
        if off is None or off <= tolerance:
            break
        done += 1
        if done == rounds:
            warnings.warn(f"after {rounds} rounds a marginal is {off:.3g} off its target", stacklevel=2)
            break
        nearest, stalled = (off, 0) if off < 0.99 * nearest else (nearest, stalled + 1)
        if rounds is None and stalled >= patience:
            raise ValueError(f"the targets cannot be met together: a marginal stays {off:.3g} off its own")
    return now.select(*columns, "factor")


def rate(cells: DataFrame, share: float) -> float:
    """The rate at which min(1, rate * factor) samples ``share`` of the tokens: each step caps more cells, up to a fixpoint."""
    now = share
    while True:
        capped = F.col("factor") * now >= 1
        row = cells.agg(F.sum("tokens"), F.sum(F.when(capped, F.col("tokens"))),
                        F.sum(F.when(~capped, F.col("tokens") * F.col("factor")))).first()
        if not row[0] or not row[2]:
            return now
        after = (share * row[0] - (row[1] or 0)) / row[2]
        if after <= now * (1 + 1e-12):
            return now
        now = after


def calibrate(rows: DataFrame, scratch: Scratch, share: float = 0.8, alpha: float = 0.7,
              targets: dict[str, DataFrame] | None = None, tolerance: float = 1e-12, patience: int = 50,
              rounds: int | None = None) -> DataFrame:
    """(cell, n, factor, chance) from the rows of ``measured``."""
    cells = scratch.save(rows.groupBy(*MARGINALS, "cell").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "sums")
    cells = scratch.save(rake(cells, scratch, targets, alpha, tolerance, patience, rounds), "raked")
    chance = F.least(F.lit(1.0), F.col("factor") * rate(cells, share))
    return scratch.save(cells.select("cell", "n", "factor", chance.alias("chance")), "calibrated")


def weigh(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(measured(docs), "rows")
    cells = calibrate(rows, scratch, **parameters)
    joined = join_hot(rows, cells.select("cell", "factor", "chance"), "cell", cells.select("cell", "n"))
    return joined.select("doc_id", *MARGINALS, "n_tokens", F.round("factor", 6).alias("weight"),
                         F.round("chance", 6).alias("probability"), (draw(F.col("doc_id")) < F.col("chance")).alias("sampled"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's digest."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(2.0 ** 32)


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    scratch = Scratch(docs.sparkSession, "mixing")
    cells = calibrate(scratch.save(measured(docs), "rows"), scratch, **parameters)
    # Columns of docs may have any name, so the whole row travels as one.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    cell = F.to_json(F.struct("source", "lang", topic_of(F.coalesce("text", F.lit(""))).alias("topic"))).alias("cell")
    joined = join_hot(docs.select(cell, row), cells.select("cell", "chance"), "cell", cells.select("cell", "n"))
    return joined.where(draw(F.col("row.doc_id")) < F.col("chance")).select("row.*")


SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, lang,
    CASE WHEN regexp_matches(coalesce(text, ''), '(?i)licen[sc]e|rights reserved|copyright') THEN 'legal'
         WHEN regexp_matches(coalesce(text, ''), '@[A-Za-z0-9-]+\.|\+[0-9]') THEN 'contact'
         WHEN regexp_matches(coalesce(text, ''), ' \| ') THEN 'table'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]{4}') THEN 'figures' ELSE 'general' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL),
t_source AS (SELECT source AS v, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER () AS t FROM cells GROUP BY 1 HAVING sum(tokens) > 0),
t_lang AS (SELECT lang AS v, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER () AS t FROM cells GROUP BY 1 HAVING sum(tokens) > 0),
t_topic AS (SELECT topic AS v, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER () AS t FROM cells GROUP BY 1 HAVING sum(tokens) > 0),
start_ AS (SELECT c.*, sum(tokens) OVER () AS total, a.t AS ts, b.t AS tl, d.t AS tt FROM cells c
  LEFT JOIN t_source a ON a.v IS NOT DISTINCT FROM c.source LEFT JOIN t_lang b ON b.v IS NOT DISTINCT FROM c.lang
  LEFT JOIN t_topic d ON d.v IS NOT DISTINCT FROM c.topic),
raked AS (
  SELECT 0 AS round, *, 1.0::DOUBLE AS f FROM start_
  UNION ALL
  SELECT round + 1, source, lang, topic, tokens, total, ts, tl, tt,
         f * coalesce(CASE WHEN sum(tokens * f) OVER (PARTITION BY topic) > 0 THEN tt * total / sum(tokens * f) OVER (PARTITION BY topic) END, 1)
  FROM (SELECT round, source, lang, topic, tokens, total, ts, tl, tt,
          f * coalesce(CASE WHEN sum(tokens * f) OVER (PARTITION BY lang) > 0 THEN tl * total / sum(tokens * f) OVER (PARTITION BY lang) END, 1) AS f
        FROM (SELECT round, source, lang, topic, tokens, total, ts, tl, tt,
                f * coalesce(CASE WHEN sum(tokens * f) OVER (PARTITION BY source) > 0 THEN ts * total / sum(tokens * f) OVER (PARTITION BY source) END, 1) AS f
              FROM raked WHERE round < 60))),
final AS (SELECT source, lang, topic, tokens, total, f FROM raked WHERE round = 60),
ordered AS (SELECT *, coalesce(sum(tokens) OVER w, 0) AS capped, total - coalesce(sum(tokens * f) OVER w, 0) AS open_
  FROM final WHERE tokens > 0 WINDOW w AS (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- Capping the cells before a cell gives a rate at which that cell is not capped: the first such cell's rate.
rate AS (SELECT (0.8 * total - capped) / open_ AS r FROM ordered WHERE (0.8 * total - capped) / open_ * f <= 1 ORDER BY f DESC, source, lang, topic LIMIT 1)
SELECT doc_id, source, lang, topic, n_tokens, round(f, 6) AS weight, round(least(1.0, f * r), 6) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / pow(2.0, 32) < least(1.0, f * r) AS sampled
FROM rows_ JOIN (SELECT source AS s, lang AS l, topic AS t, f FROM final)
  ON s IS NOT DISTINCT FROM source AND l IS NOT DISTINCT FROM lang AND t = topic, rate
"""
