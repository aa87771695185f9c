"""Quality rules: base counts per text, and robust multivariate outliers per language and source.

DataFrame functions only. Each (lang, source) gets a minimum-covariance-
determinant estimate of its transformed statistics: from medians and median
deviations, concentration steps keep the closest three quarters of the rows and
re-estimate mean and covariance from them; a reweighting step follows. A
document is rejected where its squared Mahalanobis distance, by the covariance's
Cholesky factor, exceeds the cutoff.

Statistics are small rows per document, written once; every step reads them,
joins the parameters of its group and sums. Groups with 1/HOT of all rows are at
most HOT, and only their parameters are broadcast. Order statistics come from
counts of buckets, so results do not depend on partitioning.

Null texts have no words; null languages and sources are groups of their own.
Rows that fail the base rules do not enter an estimate. Groups with fewer than
``min_rows`` rows share an estimate per language, and languages with fewer such
rows share one. A floor on each variance keeps constant statistics from
rejecting small deviations. Repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import HOT, Scratch

#: Transformed statistics with the floors of their standard deviations.
VECTOR = {
    "ln(n_words)": 0.25,
    "ln((word_chars + 250D) / (n_words + 50D))": 0.06,
    "sqrt(n_symbols / word_chars)": 0.04,
    "sqrt(n_dup_lines / (n_lines + 10D))": 0.08,
    "sqrt(n_repeat_words / (n_words + 50D))": 0.08,
}
_P = len(VECTOR)
# Fixed values for five dimensions: the chi-square quantiles at 0.75 and 0.975, and what brings covariances of the
# rows within them to those of normal data (probability / chi-square distribution with seven degrees there).
_CONCENTRATED = 1.412
_REWEIGHTED_WITHIN, _REWEIGHTED = 12.8325, 1.055


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    space = " \t\n\x0b\x0c\r"
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(space))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(*keep, F.when(trimmed == "", F.array().cast("array<string>"))
                      .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"),
                      F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    two = one.select(
        *keep, "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(words) < 6 THEN cast(array() AS array<bigint>)
                  ELSE transform(sequence(0, size(words) - 5), i -> xxhash64(
                      words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) END""").alias("windows"))
    three = two.withColumn("again", F.expr("""
        CASE WHEN size(array_distinct(windows)) < size(windows)
             THEN sort_array(transform(windows, (w, i) -> struct(w, i))) END"""))
    # Places of windows that occur again, then the words that they cover.
    four = three.drop("windows").withColumn("places", F.expr("""
        CASE WHEN again IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(again) - 1), i ->
            (i > 0 AND again[i].w = again[i - 1].w) OR (i < size(again) - 1 AND again[i].w = again[i + 1].w)),
            i -> again[i].i)) END"""))
    n_repeat = F.expr("""coalesce(aggregate(places, struct(0L AS n, -5 AS last),
        (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last), a -> a.n), 0L)""")
    out = four.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", n_repeat.alias("n_repeat_words"))
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _bucket_quantile(rows: DataFrame, keys: list[str], bucket: str, share: float) -> DataFrame:
    """Per key the least bucket that reaches ``share`` of its rows."""
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(bucket)
    total = Window.partitionBy(*keys)
    reached = counts.select(*keys, bucket, F.sum("n").over(upto).alias("upto"), F.sum("n").over(total).alias("total"))
    return reached.where(F.col("upto") >= share * F.col("total")).groupBy(*keys).agg(F.min(bucket).alias(bucket))


def _with(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """Rows with the parameters of their group; both carry ``hot``, which at most HOT groups have."""
    near = rows.where("hot").join(F.broadcast(parameters.where("hot").drop("hot")), "grp")
    return near.unionByName(rows.where("not hot").join(parameters.where("not hot").drop("hot"), "grp"))


def _distance(scale: float) -> Column:
    """Squared Mahalanobis distance by forward substitution with the factor f (rows of a triangle) and the mean m."""
    solved: list[str] = []
    for i in range(_P):
        known = "".join(f" - f[{i * (i + 1) // 2 + j}] * {solved[j]}" for j in range(i))
        solved.append(f"((x{i} - m[{i}]{known}) / f[{i * (i + 1) // 2 + i}])")
    return F.expr(" + ".join(f"{y} * {y}" for y in solved)) / F.lit(scale)


def _estimate(rows: DataFrame) -> DataFrame:
    """(grp, hot, m, f): mean and Cholesky factor of the floored covariance, from one sum per group."""
    sums = rows.groupBy("grp", "hot").agg(
        F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(_P) for j in range(i + 1)))
    out = sums
    for i, floor in enumerate(VECTOR.values()):
        for j in range(i + 1):
            cov = f"(q{i}{j} / n - (s{i} / n) * (s{j} / n))"
            cov = f"greatest({cov}, 0D) + {floor ** 2}D" if i == j else cov
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(greatest({cov}{inner}, {floor ** 2 / 4}D))" if i == j else f"({cov}{inner}) / l{j}{j}"
            out = out.withColumn(f"l{i}{j}", F.expr(value))
    return out.select("grp", "hot", F.array(*(F.col(f"s{i}") / F.col("n") for i in range(_P))).alias("m"),
                      F.array(*(f"l{i}{j}" for i in range(_P) for j in range(i + 1))).alias("f"))


def reject_outliers(counted: DataFrame, cutoff: float = 40.0, steps: int = 4, min_rows: int = 50) -> DataFrame:
    """``counted`` (base counts with lang and source) with ``distance`` (null where the base rules failed) and ``kept``."""
    scratch = Scratch(counted.sparkSession, "outliers")
    vectors = [F.expr(x).alias(f"x{i}") for i, x in enumerate(VECTOR)]
    rows = scratch.save(counted.withColumn("own", F.to_json(F.struct("lang", "source")))
                        .withColumn("wide", F.to_json(F.struct("lang"))), "rows")
    used = rows.where("not base_failed")
    sizes = used.groupBy("own", "wide").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_rows).groupBy("wide").agg(F.sum("n").alias("together"))
    groups = sizes.join(small, "wide", "left").select("own", "n", F.expr(
        f"CASE WHEN n >= {min_rows} THEN own WHEN together >= {min_rows} THEN concat('lang ', wide) ELSE 'all' END").alias("grp"))
    total = groups.agg(F.sum("n").alias("total"))
    merged = groups.groupBy("grp").agg(F.sum("n").alias("rows")).crossJoin(F.broadcast(total))
    merged = merged.select("grp", (F.col("rows") * HOT >= F.col("total")).alias("hot"))
    # Groups of one language and source with 1/HOT of the rows are at most HOT; the others join by a shuffle.
    groups = scratch.save(groups.join(merged, "grp").join(F.broadcast(total)).select(
        "own", "grp", "hot", (F.col("n") * HOT >= F.col("total")).alias("often")), "groups")
    often = F.broadcast(groups.where("often").drop("often"))
    marked = used.join(often, "own", "left")
    near = marked.where("grp is not null")
    far = marked.where("grp is null").drop("grp", "hot").join(groups.where("not often").drop("often"), "own")
    data = scratch.save(near.unionByName(far).select(*counted.columns, "grp", "hot", *vectors), "data")
    points = data.select("grp", "hot", *(f"x{i}" for i in range(_P)))

    # Medians, then median deviations from them, in buckets of 1/256.
    long = points.select("grp", "hot", F.posexplode(F.array(*(f"x{i}" for i in range(_P)))).alias("i", "x"))
    middle = _bucket_quantile(long.select("grp", "hot", "i", F.floor(F.col("x") * 256).alias("b")), ["grp", "hot", "i"], "b", 0.5)
    middle = middle.groupBy("grp", "hot").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("s"))
    middle = scratch.save(middle.select("grp", "hot", F.expr("transform(s, v -> (v.b + 0.5D) / 256)").alias("m")), "medians")
    away = _with(points, middle).select("grp", "hot", F.posexplode(F.array(
        *(F.abs(F.col(f"x{i}") - F.col("m")[i]) for i in range(_P)))).alias("i", "x"))
    spread = _bucket_quantile(away.select("grp", "hot", "i", F.floor(F.col("x") * 256).alias("b")), ["grp", "hot", "i"], "b", 0.5)
    spread = spread.groupBy("grp", "hot").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("s"))
    floors = list(VECTOR.values())
    diagonal = [F.greatest((F.col("s")[i]["b"] + 0.5) / 256 * 1.4826, F.lit(floors[i])) if i == j else F.lit(0.0)
                for i in range(_P) for j in range(i + 1)]
    now = scratch.save(middle.join(spread, ["grp", "hot"]).select("grp", "hot", "m", F.array(*diagonal).alias("f")), "start")

    for _ in range(steps):
        near = _with(points, now).withColumn("b", F.floor(64 * F.log2(1 + _distance(1.0))))
        within = _bucket_quantile(near.select("grp", "hot", "b"), ["grp", "hot"], "b", 0.75)
        within = now.join(within.withColumnRenamed("b", "upto"), ["grp", "hot"])
        closest = _with(points, within).withColumn("b", F.floor(64 * F.log2(1 + _distance(1.0)))).where("b <= upto")
        after = scratch.save(_estimate(closest), "step")
        scratch.drop(now)
        now = after
    closest = _with(points, now).where(_distance(_CONCENTRATED) <= _REWEIGHTED_WITHIN)
    now = scratch.save(_estimate(closest), "final")
    judged = _with(data, now).select(*counted.columns, _distance(_REWEIGHTED).alias("distance"))
    judged = judged.withColumn("kept", F.col("distance") <= cutoff)
    failed = rows.where("base_failed").select(*counted.columns)
    return judged.unionByName(failed.withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)}))
