"""WARC archives and near-duplicate vectors."""

import base64
import gzip
import hashlib
import io

import brute
import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from archgraph.llm import common, embedding_dedup, warc

PAGES = "page_id long, url string, html string, payload int"
VECTORS = "vec_id long, embedding array<float>, label int, unit string"


def pages_of(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7} é</p>") for i in range(40)]
    rows += [(50, None, None), (51, "http://a b\r\nX: y", ""), (52, "u", "z" * 300_000 + "\r\n\r\n"), (53, "u", "same"), (53, "u", "same"),
             (None, "u", "same"), (None, "u", "alone"), (None, "u", "alone")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], PAGES)


def test_round_trip(spark):
    rows, pages = pages_of(spark)
    scratch = common.Scratch(spark, "test")
    files = warc.write_archives(pages, scratch)
    got = warc.read_archives(files, with_payload=True).collect()
    assert len(got) == len(rows) == files.agg(F.sum("records")).first()[0]
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        raw, to = (html or "").encode(), last[html or ""]
        response = (i if i is not None else -1) == to
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), sha, "response" if response else "revisit", None if response else to, raw if response else None))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted([tuple(r[:5]) + (None if r.payload is None else bytes(r.payload),) for r in got], key=order) == sorted(want, key=order)
    # each record is a gzip member of its own, and any WARC reader's framing holds
    path = files.first().path
    store, place = fs.FileSystem.from_uri(path)
    whole = gzip.decompress(store.open_input_stream(place, compression=None).read())
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    assert warc.round_trip(pages.where("false")).count() == 0


def test_the_reader_refuses_what_is_broken():
    good = warc.record(1, "u", b"abc", warc.digest(hashlib.sha1(b"abc").digest()), None)
    assert [r[:4] for r in warc.read_records(io.BytesIO(good * 3))] == [(1, 3, warc.digest(hashlib.sha1(b"abc").digest()), "response")] * 3
    for bad in (good[:-9], good + good[:20], gzip.compress(b"x" * 50),
                warc.record(1, "u", b"abc", warc.digest(hashlib.sha1(b"abd").digest()), None),
                gzip.compress(gzip.decompress(good).replace(b"Content-Length: 3", b"Content-Length: 4")),
                gzip.compress(gzip.decompress(good).replace(b"abc", b"abd"))):
        with pytest.raises((ValueError, KeyError)):
            list(warc.read_records(io.BytesIO(bad)))


def test_vectors_against_all_pairs(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=24)
            for s in rng.choice([0.05, 0.2, 0.4], rng.integers(1, 9)):
                rows.append((len(rows), (centre + rng.normal(size=24) * s).astype(np.float32).tolist(), label))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] + [1.0] * 23, 1), (n + 3, [None] + [1.0] * 23, 1), (n + 4, [1.0], 1),
             (n + 5, [2.0], 1), (n + 6, [3.0e38, 3.0e38], 0), (n + 7, [1.0, 1.0], 0), (n + 8, [], 1), (None, rows[0][1], 0)]
    rows += [rows[0], rows[0], (n + 9, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n_links = [], [0] * len(good)
    for a in range(len(good)):
        for b in range(len(good)):
            x, y = good[a], good[b]
            if a != b and x[2] == y[2] and len(x[1]) == len(y[1]):
                if x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93:
                    links.append((x[0], y[0]))
                    n_links[a] += 1
    component = brute.groups([r[0] for r in rows if r[0] is not None], links)
    want = {r[0]: (0, r[0], True) for r in rows}
    want |= {g[0]: (k, component[g[0]], component[g[0]] == g[0]) for g, k in zip(good, n_links)}
    out = embedding_dedup.near_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in got) and found >= 0.97 * there
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_links_of_a_group_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.Generator(np.random.PCG64(1))
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), 1, "x") for i in range(80)]
    out = embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(79, 0)}


def test_rotation_keeps_lengths():
    x = np.random.Generator(np.random.PCG64(2)).normal(size=(5, 24))
    y = embedding_dedup.rotate(x, 3)
    assert y.shape == (5, 32) and np.allclose((x @ x.T), y @ y.T)


def test_components_of_a_chain_a_hub_and_a_ring(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 150)]
    ring = [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame(chain + hub + ring + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges, common.Scratch(spark, "test")).collect()}
    assert got == brute.groups(got, chain + hub + ring) and len(got) == 61 + 150 + 9


def test_hot_keys_join_like_others(spark):
    left = spark.createDataFrame([(1, i) for i in range(900)] + [(k, 0) for k in range(2, 60)] + [(None, 5)], "k int, v int")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 40)], "k int, w int")
    counts = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_hot(left, right, "k", counts, how).select("k", "v", "w").collect())) == sorted(
            map(str, left.join(right, "k", how).select("k", "v", "w").collect()))
