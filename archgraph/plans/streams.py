"""Registered queries: streaming jobs run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from archgraph.plans.registry import query
from archgraph.session import shared_dir
from archgraph.sources import snapshot as sn
from archgraph.streaming import feed as fd


def _place(t, name):
    return f"{shared_dir(t.spark)}/archgraph/{name}-{uuid.uuid4().hex}"


def _feed(t, parts: int = 4):
    """The change feed as several files, read back as a stream."""
    src = _place(t, "feed")
    changes = t.fx_changes.withColumn("ts", F.col("ts").cast("timestamp")).select(*[f.name for f in fd.FEED.fields])
    changes.repartition(parts, "repo", "path").write.parquet(src)
    return fd.read_feed(t.spark, src, files_per_batch=2)


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def state(t):
    def run():
        where = _place(t, "state")
        _finish(fd.start_latest_file_state(_feed(t), where, _place(t, "ckpt")))
        return fd.latest_file_state(t.spark, where, with_deleted=True)

    return t.table("file_state", run)


_LATEST = """
    SELECT repo, path, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(deleted, (ts, event_id)) AS deleted, arg_max(content, (ts, event_id)) AS content
    FROM {fx_changes} GROUP BY repo, path"""


@query("latest_file_state", f"SELECT repo, path, event_id, content FROM ({_LATEST}) WHERE NOT deleted")
def latest_file_state(t):
    return state(t).where("NOT deleted").select("repo", "path", "event_id", "content")


@query("refresh_affected", f"SELECT repo, count(*) AS n_files, sum(length(content))::BIGINT AS n_chars FROM ({_LATEST}) WHERE NOT deleted GROUP BY repo")
def refresh_affected(t):
    where, target = _place(t, "state"), _place(t, "refreshed")

    def summary(files):
        return files.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))

    def refresh(batch, number):
        spark = batch.sparkSession
        fd.refresh_affected(batch, fd.latest_file_state(spark, where, repos=batch), summary, target, number)

    _finish(fd.start_latest_file_state(_feed(t), where, _place(t, "ckpt"), after=refresh))
    return fd.read_refreshed(t.spark, target, "repo string, n_files long, n_chars long")


@query("change_counts", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, repo, count(*) AS changes, count(*) FILTER (deleted) AS deletions FROM {fx_changes} GROUP BY ALL""")
def change_counts(t):
    where = _place(t, "counts")
    _finish(fd.start_count_stream(_feed(t), where, _place(t, "ckpt")))
    return fd.change_counts(t.spark, where).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "repo", "changes", "deletions")


def _file_edges(files):
    """What a file of the feed says: its service calls one of five stores, more or less surely."""
    k = F.get_json_object("content", "$.k").cast("int")
    return files.where("NOT deleted").select(
        "repo", F.concat(F.lit("container:"), F.regexp_replace("path", "[.]yaml$", "")).alias("src"), F.concat(F.lit("container:db-"), (k % 5).cast("string")).alias("dst"),
        k.alias("conf_pct"))


@query("drift_stream", """
    WITH days AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM {fx_changes}),
    newest AS (SELECT d.day, c.repo, c.path, arg_max(c.deleted, (c.ts, c.event_id)) AS deleted, arg_max(c.content, (c.ts, c.event_id)) AS content
               FROM days d JOIN {fx_changes} c ON date_trunc('day', c.ts) <= d.day GROUP BY ALL),
    edges AS (SELECT day, repo, path, json_extract_string(content, '$.k')::INTEGER % 5 AS dst, json_extract_string(content, '$.k')::INTEGER AS pct FROM newest WHERE NOT deleted),
    next AS (SELECT day, lead(day) OVER (ORDER BY day) AS after FROM days),
    seen AS (SELECT day, repo, path, dst, pct, NULL::INTEGER AS was FROM edges
             UNION ALL SELECT n.after, repo, path, dst, NULL, pct FROM edges JOIN next n USING (day) WHERE n.after IS NOT NULL),
    diff AS (SELECT day, repo, max(pct) AS pct, max(was) AS was FROM seen GROUP BY day, repo, path, dst)
    SELECT strftime(day, '%Y-%m-%d') AS day, repo, count(*) FILTER (was IS NULL) AS added, count(*) FILTER (pct IS NULL) AS removed, count(*) FILTER (pct <> was) AS changed
    FROM diff GROUP BY day, repo HAVING count(*) FILTER (was IS NULL OR pct IS NULL OR pct <> was) > 0""")
def drift_stream(t):
    where = _place(t, "drift")
    _finish(fd.start_drift_stream(_days(t), where, _place(t, "ckpt"), _file_edges, ["src", "dst"], ["conf_pct"]))
    return fd.drift(t.spark, where).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "repo", "added", "removed", "changed")


def _days(t):
    """The feed in three files, one after the other in event time, ended by one
    event of a month later that closes all windows before it."""
    src = _place(t, "feed")
    changes = t.fx_changes.withColumn("ts", F.col("ts").cast("timestamp")).select(*[f.name for f in fd.FEED.fields])
    third = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    last = changes.agg(F.max("ts").alias("ts")).select(
        F.lit("end").alias("repo"), F.lit("end").alias("path"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("long").alias("event_id"),
        F.lit(True).alias("deleted"), F.lit("").alias("content"))
    for part in [*(changes.where(third == i) for i in range(3)), last]:
        part.coalesce(1).write.mode("append").parquet(src)
    return fd.read_feed(t.spark, src, files_per_batch=1)


@query("staleness", """
    WITH i AS (SELECT 'repo-' || user_id AS repo, 1699990000 + max(event_id) * 10 AS newest, count(*) FILTER (event_type = 'error' AND event_id % 7 = 0) AS n_deleted FROM events GROUP BY user_id),
    r AS (SELECT v.*, CASE WHEN NOT regexp_full_match(stored, '[0-9]+\\.[0-9]+\\.[0-9]+([-+].*)?') OR stored[1] <> '1' THEN 'incompatible' WHEN stored[3] = '0' THEN 'same' ELSE 'newer' END AS relation FROM {fx_versions} v)
    SELECT r.repo, relation, CASE WHEN relation = 'newer' THEN false ELSE relation <> 'same' OR producer <> 'build-1' OR coalesce(newest, 0) > generated_at OR coalesce(n_deleted, 0) > 0 END AS stale,
           relation <> 'incompatible' AS readable, relation <> 'newer' AS replaceable FROM r LEFT JOIN i USING (repo)""".replace("\\\\", "\\"))
def staleness(t):
    newest = t.events.groupBy(F.concat(F.lit("repo-"), "user_id").alias("repo")).agg(
        (F.lit(1699990000) + F.max("event_id") * 10).alias("newest"),
        F.sum(((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).cast("int")).alias("n_deleted"))
    return sn.staleness(t.fx_versions, newest, "build-1")
