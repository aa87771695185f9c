"""Change feed of files: latest state, affected repositories, drift.

The state is a keyed table in buckets by repository, each cut into slices by
path. A micro-batch reads the buckets and slices it touches, merges its newest
rows and writes new versions of just those; a commit names them. Readers take
the newest committed version of each, so they never aggregate history, a batch
that is retried after a failure writes the same versions again, and ``vacuum``
deletes what no reader needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from archgraph.session import durable

FEED = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("content", T.StringType())])


def read_feed(spark: SparkSession, location: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(location)


def _newest(df: DataFrame) -> DataFrame:
    """Newest version per file; deletions are versions too."""
    return df.groupBy("repo", "path").agg(F.max_by(
        F.struct("ts", "event_id", "deleted", "content"), F.struct("ts", "event_id")).alias("v")).select("repo", "path", "v.*")


def _log(df: DataFrame, location: str, batch: int) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "batch").parquet(location)


#: Buckets by repository, and slices of each by path: a repository of any share of the files is as many slices.
BUCKETS, SLICES = 64, 8
_STATE = T.StructType([*FEED.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()),
                       T.StructField("slice", T.IntegerType())])
_COMMIT = "bucket int, slice int, batch long"


def bucket_of(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(BUCKETS)).cast("int")


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"bucket": bucket_of(F.col("repo")), "slice": F.pmod(F.xxhash64("path"), F.lit(SLICES)).cast("int")})


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, location: str, before: int | None = None) -> dict[tuple[int, int], int]:
    """Newest committed batch per (bucket, slice); at most BUCKETS x SLICES entries."""
    if not _exists(spark, f"{location}/commits"):
        return {}
    commits = spark.read.schema(_COMMIT).parquet(f"{location}/commits")
    if before is not None:
        commits = commits.where(F.col("batch") < before)
    return {(r.bucket, r.slice): r.batch for r in commits.groupBy("bucket", "slice").agg(F.max("batch").alias("batch")).collect()}


def read_state(spark: SparkSession, location: str, known: dict[tuple[int, int], int]) -> DataFrame:
    """The rows of the given versions, and of no other files."""
    root = f"{location}/state"
    places = [f"{root}/batch={batch}/bucket={b}/slice={s}" for (b, s), batch in sorted(known.items())]
    if not places:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).option("basePath", root).parquet(*places)


def merge_batch(batch: DataFrame, number: int, location: str) -> None:
    """Fold a batch into the state: only what it touches is read and written again."""
    spark = batch.sparkSession
    fresh = durable(_placed(_newest(batch)), "batch")
    touched = {(r.bucket, r.slice) for r in fresh.select("bucket", "slice").distinct().collect()}
    if not touched:
        return
    known = {k: v for k, v in versions(spark, location, before=number).items() if k in touched}
    old = read_state(spark, location, known).drop("batch")
    merged = _placed(_newest(old.unionByName(fresh).select(*[f.name for f in FEED.fields])))
    merged.write.mode("overwrite").partitionBy("bucket", "slice").parquet(f"{location}/state/batch={number}")
    commit = spark.createDataFrame([(b, s) for b, s in sorted(touched)], "bucket int, slice int").coalesce(1)
    _log(commit, f"{location}/commits", number)


def start_latest_file_state(feed: DataFrame, location: str, checkpoint: str,
                            after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the newest version of every file; ``after`` sees each batch too."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            merge_batch(batch, number, location)
            if after is not None:
                after(batch, number)
        finally:
            batch.unpersist()

    return (feed.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_file_state(spark: SparkSession, location: str, with_deleted: bool = False, repos: DataFrame | None = None,
                      before: int | None = None) -> DataFrame:
    """Newest version per file, of all repositories or of those named: then only
    their buckets are read. ``before``: as it was before that batch."""
    known = versions(spark, location, before)
    if repos is not None:
        wanted = {r.bucket for r in repos.select(bucket_of(F.col("repo")).alias("bucket")).distinct().collect()}
        known = {k: v for k, v in known.items() if k[0] in wanted}
    state = read_state(spark, location, known).select(*[f.name for f in FEED.fields])
    if repos is not None:
        state = state.join(repos.select("repo").distinct(), "repo", "left_semi")
    return state if with_deleted else state.where("NOT deleted")


def vacuum(spark: SparkSession, location: str) -> int:
    """Delete versions that a newer commit replaces; returns how many. Not to be run beside a reader of an older version."""
    known = versions(spark, location)
    written = spark.read.schema(_COMMIT).parquet(f"{location}/commits").distinct().toLocalIterator()
    gone = 0
    for r in written:
        if known[r.bucket, r.slice] != r.batch:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/state/batch={r.batch}/bucket={r.bucket}/slice={r.slice}")
            gone += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone


def refresh_affected(changed: DataFrame, state: DataFrame, resolve: Callable[[DataFrame], DataFrame], target: str, number: int = 0) -> None:
    """Recompute the repositories a batch touched, all others stay as they are.
    ``resolve`` turns the touched repositories' files into a table with
    ``repo``; ``read_refreshed`` reads what is kept."""
    repos = changed.select("repo").distinct()
    store_affected(resolve(state.join(repos, "repo", "left_semi")), repos, target, number)


def store_affected(fresh: DataFrame, repos: DataFrame, target: str, number: int) -> None:
    """Put new rows in the place of all rows of ``repos``: as new versions of
    the buckets those are in, beside the rows of the buckets' other
    repositories. A repository that has nothing left has no rows."""
    spark = repos.sparkSession
    repos = durable(repos.select("repo", bucket_of(F.col("repo")).alias("bucket")).distinct(), "repos")
    touched = [r.bucket for r in repos.select("bucket").distinct().collect()]
    if not touched:
        return
    fresh = fresh.withColumn("bucket", bucket_of(F.col("repo")))
    known = {b: v for (b, _), v in versions(spark, target, before=number).items() if b in touched}
    if known:
        others = _refreshed(spark, target, known, fresh.schema).join(repos.select("repo"), "repo", "left_anti")
        fresh = fresh.unionByName(others)
    fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/state/batch={number}")
    _log(spark.createDataFrame([(b, 0) for b in sorted(touched)], "bucket int, slice int").coalesce(1), f"{target}/commits", number)


def _refreshed(spark: SparkSession, target: str, known: dict[int, int], schema: T.StructType) -> DataFrame:
    places = [f"{target}/state/batch={v}/bucket={b}" for b, v in sorted(known.items()) if _exists(spark, f"{target}/state/batch={v}/bucket={b}")]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{target}/state").parquet(*places).select(*[f.name for f in schema.fields])


def read_refreshed(spark: SparkSession, target: str, layout: str) -> DataFrame:
    """What ``refresh_affected`` keeps; ``layout`` names the columns of the resolved table."""
    schema = T.StructType.fromDDL(layout + ", bucket int")
    return _refreshed(spark, target, {b: v for (b, _), v in versions(spark, target).items()}, schema).drop("bucket")


def drift_counts(changes: DataFrame, width: str = "1 day") -> DataFrame:
    """Changes per repo and tumbling window."""
    return (changes.groupBy(F.window("ts", width), "repo")
            .agg(F.count("*").alias("changes"), F.sum(F.col("deleted").cast("int")).alias("deletions"))
            .select(F.col("window.start").alias("window_start"), "repo", "changes", "deletions"))


def start_count_stream(feed: DataFrame, location: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Log each batch's counts under the batch's number. Counts add up, so no
    state is kept between batches, a change counts however late it comes, and a
    batch that is retried replaces its own counts."""

    def log(batch: DataFrame, number: int) -> None:
        _log(drift_counts(batch, width), location, number)

    return (feed.writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def change_counts(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location).groupBy("window_start", "repo").agg(
        F.sum("changes").alias("changes"), F.sum("deletions").alias("deletions"))


# ------------------------------------------------------------------------ drift
#: A closed window's newest version of a file.
_WINDOWED = [f.name for f in FEED.fields]


def closed_windows(feed: DataFrame, width: str, lateness: str) -> DataFrame:
    """The newest version per file and window, once the watermark has passed the window: redelivered and repeated
    events fold into it, later ones are too late. The state holds open windows only."""
    unique = unique_deliveries(feed, lateness)
    newest = F.max_by(F.struct("ts", "event_id", "deleted", "content"), F.struct("ts", "event_id")).alias("v")
    return unique.groupBy(F.window("ts", width).alias("w"), "repo", "path").agg(newest).select(
        F.col("w.start").alias("window_start"), "repo", "path", "v.*")


def window_drift(rows: DataFrame, base: DataFrame, before: DataFrame, resolve: Callable[[DataFrame], DataFrame], key: list[str],
                 columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counts, edges): what each closed window did to the edges of the repositories it touched, and their edges at the end.

    ``rows``: newest file versions per window; ``base`` and ``before``: files and
    edges as they were. Every (repository, window) is resolved as if it were a
    repository of its own, all in one pass, and held against the one before it.
    """
    from archgraph.operators.overrides import snapshot_diff

    w = Window.partitionBy("repo").orderBy("window_start")  # a row per window of a trigger
    steps = durable(rows.select("repo", "window_start").distinct().withColumn("step", F.row_number().over(w)), "steps")
    known = rows.withColumn("since", F.col("window_start")).drop("window_start").unionByName(
        base.withColumn("since", F.lit(None).cast("timestamp")))
    seen = steps.join(known, "repo").where("since IS NULL OR since <= window_start")
    tag = F.concat_ws("\x00", "repo", F.col("step").cast("string"))
    files = _newest(seen.withColumn("repo", tag))
    parts = F.split("repo", "\x00")
    edges = resolve(files.where("NOT deleted").select(*_WINDOWED)).withColumns({
        "step": F.get(parts, F.lit(1)).cast("int"), "repo": F.get(parts, F.lit(0))})
    edges = durable(edges, "edges")
    previous = before.withColumn("step", F.lit(0)).unionByName(edges).withColumn("step", F.col("step") + 1)
    diff = snapshot_diff(previous.join(steps.select("repo", "step"), ["repo", "step"], "left_semi"), edges, ["repo", "step", *key], columns)
    count = lambda what: F.count_if(F.col("change") == what).alias(what)
    counts = diff.join(steps, ["repo", "step"]).groupBy("window_start", "repo").agg(count("added"), count("removed"), count("changed"))
    last = steps.groupBy("repo").agg(F.max("step").alias("step"))
    return counts, edges.join(last, ["repo", "step"], "left_semi").drop("step")


def start_drift_stream(feed: DataFrame, location: str, checkpoint: str, resolve: Callable[[DataFrame], DataFrame], key: list[str],
                       columns: list[str], width: str = "1 day", lateness: str = "1 day") -> StreamingQuery:
    """Compare what each closed window made of the graph with the graph before it.

    ``resolve`` turns files into edges. Per trigger, the windows that closed are
    worked out together (``window_drift``) and counted; then their newest file
    versions go into the keyed state, and the last edges of the repositories
    touched become the previous ones. A trigger that is retried reads the
    versions before it, so it counts the same again. ``drift`` reads the counts.
    """

    def compare(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = durable(batch, "windows")
        if rows.isEmpty():
            return
        repos = durable(rows.select("repo").distinct(), "repos")
        base = latest_file_state(spark, f"{location}/files", with_deleted=True, repos=repos, before=number)
        before = _edges_before(spark, f"{location}/edges", repos, resolve, number)
        counts, edges = window_drift(rows, base, before, resolve, key, columns)
        _log(counts, f"{location}/drift", number)
        store_affected(edges, repos, f"{location}/edges", number)
        merge_batch(rows.select(*_WINDOWED), number, f"{location}/files")

    return (closed_windows(feed, width, lateness).writeStream.outputMode("append").foreachBatch(compare)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _edges_before(spark: SparkSession, target: str, repos: DataFrame, resolve: Callable[[DataFrame], DataFrame], number: int) -> DataFrame:
    schema = T.StructType([*resolve(spark.createDataFrame([], FEED)).schema.fields, T.StructField("bucket", T.IntegerType())])
    wanted = {r.bucket for r in repos.select(bucket_of(F.col("repo")).alias("bucket")).distinct().collect()}
    known = {b: v for (b, _), v in versions(spark, target, before=number).items() if b in wanted}
    return _refreshed(spark, target, known, schema).drop("bucket").join(repos, "repo", "left_semi")


def drift(spark: SparkSession, location: str) -> DataFrame:
    """(window_start, repo, added, removed, changed) of the windows closed so far; repositories without a change have no row."""
    return spark.read.parquet(f"{location}/drift").drop("batch")


def unique_deliveries(feed: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Drop redelivered events within the watermark. ``latest_file_state`` is
    idempotent and does not need it."""
    return feed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
