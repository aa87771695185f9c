"""The keyed state of the change feed, and drift between windows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from archgraph.session import shared_dir
from archgraph.streaming import feed as fd


@pytest.fixture
def place(spark):
    return lambda name: f"{shared_dir(spark)}/archgraph/{name}-{uuid.uuid4().hex}"


def rows(spark, *changes):
    """(repo, path, day, event_id, deleted, content)."""
    return spark.createDataFrame([(r, p, dt.datetime(2024, 1, d), e, x, c) for r, p, d, e, x, c in changes], fd.FEED)


def state_of(spark, location, **more):
    return {(r.repo, r.path): r.content for r in fd.latest_file_state(spark, location, **more).collect()}


def test_a_batch_reads_and_writes_only_what_it_touches(spark, place):
    where = place("state")
    many = [(f"repo{r}", f"f{p}", 1, r * 100 + p, False, "old") for r in range(40) for p in range(30)]
    fd.merge_batch(rows(spark, *many), 0, where)
    known = fd.versions(spark, where)
    assert len(known) > 100 and set(known.values()) == {0}
    fd.merge_batch(rows(spark, ("repo7", "f3", 2, 9000, False, "new")), 1, where)
    after = fd.versions(spark, where)
    touched = [k for k, v in after.items() if v == 1]
    assert len(touched) == 1
    read = fd.read_state(spark, where, {k: v for k, v in known.items() if k in touched}).count()
    assert 0 < read < 40 * 30 / 20
    files = {f for f in fd.latest_file_state(spark, where).inputFiles() if "batch=1" in f}
    assert len(files) == 1 and len(state_of(spark, where)) == 40 * 30
    assert state_of(spark, where)["repo7", "f3"] == "new" and state_of(spark, where)["repo7", "f4"] == "old"
    # one repository is read from its own buckets
    one = spark.createDataFrame([("repo7",)], "repo string")
    some = fd.latest_file_state(spark, where, repos=one)
    assert some.count() == 30 and len(some.inputFiles()) <= fd.SLICES


def test_retries_late_rows_deletions_and_vacuum(spark, place):
    where = place("state")
    fd.merge_batch(rows(spark, ("r", "a", 5, 1, False, "a5"), ("r", "b", 5, 2, False, "b5")), 0, where)
    second = rows(spark, ("r", "a", 3, 3, False, "late"), ("r", "b", 6, 4, True, ""), ("s", "c", 6, 5, False, "c6"), ("s", "c", 6, 4, False, "c5"))
    for _ in range(2):  # a batch that is retried writes the same again
        fd.merge_batch(second, 1, where)
        assert state_of(spark, where) == {("r", "a"): "a5", ("s", "c"): "c6"}
        assert set(state_of(spark, where, with_deleted=True)) == {("r", "a"), ("r", "b"), ("s", "c")}
    before = len(fd.read_state(spark, where, fd.versions(spark, where)).inputFiles())
    assert fd.vacuum(spark, where) > 0 and fd.vacuum(spark, where) == 0
    assert len(fd.read_state(spark, where, fd.versions(spark, where)).inputFiles()) == before
    assert state_of(spark, where) == {("r", "a"): "a5", ("s", "c"): "c6"}
    # an empty batch changes nothing
    fd.merge_batch(second.where("false"), 2, where)
    assert set(fd.versions(spark, where).values()) <= {0, 1}


def test_a_repository_left_without_files_has_no_rows(spark, place):
    target, where = place("refreshed"), place("state")
    summary = lambda files: files.groupBy("repo").agg(F.count("*").alias("n"))
    steps = [[("r", "a", 1, 1, False, "x"), ("s", "a", 1, 2, False, "x"), ("t", "a", 1, 3, False, "x")],
             [("r", "a", 2, 4, True, ""), ("s", "b", 2, 5, False, "x")], [("t", "a", 3, 6, True, "")]]
    want = [{"r": 1, "s": 1, "t": 1}, {"s": 2, "t": 1}, {"s": 2}]
    for i, (step, left) in enumerate(zip(steps, want)):
        batch = rows(spark, *step)
        fd.merge_batch(batch, i, where)
        for _ in range(2):
            fd.refresh_affected(batch, fd.latest_file_state(spark, where, repos=batch), summary, target, i)
            got = fd.read_refreshed(spark, target, "repo string, n long").collect()
            assert {r.repo: r.n for r in got} == left


def test_drift_counts_edges_not_events(spark, place):
    """Per closed window: edges that came, went and changed; redelivered events and rewrites without effect count nothing."""
    src, where = place("feed"), place("drift")
    steps = [
        [("r", "a", 1, 1, False, "x:5"), ("r", "b", 1, 2, False, "y:5"), ("s", "a", 1, 3, False, "x:1")],
        [("r", "a", 2, 4, False, "x:9"), ("r", "b", 2, 5, True, ""), ("r", "b", 2, 5, True, ""), ("s", "a", 2, 6, False, "x:1")],
        [("r", "a", 3, 7, False, "z:9"), ("r", "a", 3, 8, False, "x:9")],
        [("r", "a", 4, 9, False, "z:9"), ("end", "end", 28, 10, True, "")]]
    for step in steps:
        rows(spark, *step).coalesce(1).write.mode("append").parquet(src)

    def edges(files):
        part = F.split("content", ":")
        return files.where("NOT deleted").select("repo", F.col("path").alias("src"), F.get(part, F.lit(0)).alias("dst"), F.get(part, F.lit(1)).cast("int").alias("conf_pct"))

    q = fd.start_drift_stream(fd.read_feed(spark, src, 1), where, place("ckpt"), edges, ["src", "dst"], ["conf_pct"])
    q.awaitTermination()
    assert q.exception() is None
    got = {(r.window_start.day, r.repo): (r.added, r.removed, r.changed) for r in fd.drift(spark, where).collect()}
    assert got == {(1, "r"): (2, 0, 0), (1, "s"): (1, 0, 0), (2, "r"): (0, 1, 1), (4, "r"): (1, 1, 0)}
