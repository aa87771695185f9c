"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors of a label are one class with a multiplicity. A class hashes into
``tables`` buckets, each named by ``hashes`` cross-polytope vertices (the
largest coordinate, with its sign, after a pseudo-random rotation), and probes
further buckets by the next-best vertex where the runner-up is closest. Buckets
with several members are split into blocks; each pair of blocks is one group of
rows, compared by a matrix product in double precision. A pair that meets in
several buckets counts in the first of them alone, decided from both rows'
bucket names, so no pair leaves a task: tasks emit sums of links and a spanning
forest.

Vectors that are null, zero, hold null or non-finite components, or have a null
label or id, link with nothing (n_links 0, component_id their own id). Vectors
of different dimensions never link. Repeated rows link with each other; of different
vectors under one id the links add up. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import Scratch, components, fixed, join_hot, mix, sorted_groups, spanning

#: Rows of a block.
BLOCK = 1024


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Walsh-Hadamard transform, on rows padded to a power of two."""
    n, d = x.shape
    size = 1 << max(1, d - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :d] = x
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        y = y * rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            y = y.reshape(n, -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


def bucket_names(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket names; the first is the row's own."""
    n = len(x)
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for k in range(hashes):
            y = rotate(x, 1000 * t + k)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            vertex = 2 * top + (y[rows[:, None], top] < 0)
            best.append(vertex[:, 0])
            second.append(vertex[:, 1])
            gap.append(size[rows, top[:, 0]] - size[rows, top[:, 1]])
        # Which vertices a probe replaces: all subsets but the empty one, cheapest first.
        masks = sorted(range(1, 1 << hashes), key=lambda m: (m.bit_count(), m))
        cost = np.stack([sum((gap[k] ** 2 for k in range(hashes) if m >> k & 1), np.zeros(n)) for m in masks], 1)
        chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        for p in range(1 + probes):
            mask = np.zeros(n, np.int64) if p == 0 else np.array(masks)[chosen[:, p - 1]]
            name = np.full(n, t + 1, np.uint64)
            for k in range(hashes):
                vertex = np.where(mask >> k & 1, second[k], best[k]).astype(np.uint64)
                name = mix(name * np.uint64(0xD6E8FEB86659FD93) + vertex)
            out[:, t, p] = name
    return out


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class (null: links with nothing), and classes (k, cid, copies, space, embedding)."""
    good = ("embedding is not null and label is not null and vec_id is not null"
            " and not exists(embedding, e -> e is null or isnan(e) or abs(e) = double('infinity'))"
            " and exists(embedding, e -> e <> 0)")
    k = F.concat_ws(":", F.xxhash64(F.lit(1), "label", "embedding"), F.xxhash64("embedding", F.lit(2)))
    rows = vectors.select("vec_id", "label", "embedding", F.when(F.expr(good), k).alias("k"))
    return rows, rows.where("k is not null").groupBy("k").agg(
        F.min("vec_id").alias("cid"), F.count("*").alias("copies"),
        F.xxhash64(F.first("label"), F.size(F.first("embedding"))).alias("space"),
        F.first("embedding").alias("embedding"))


def _signed(classes_: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = np.asarray(batch.column(3)).astype(np.uint64)
            column = batch.column(4)
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values).astype(float)
            width = np.diff(offsets)
            names: list = [None] * batch.num_rows
            units: list = [None] * batch.num_rows
            for w in np.unique(width):
                here = np.flatnonzero(width == w)
                x = flat[offsets[here][:, None] + np.arange(w)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = mix(bucket_names(x, tables, hashes, probes) + space[here, None, None])
                for i, row, unit in zip(here.tolist(), found, x):
                    names[i], units[i] = row.ravel().astype(np.int64), unit.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.list_(pa.int64())),
                 pa.array([b"" if x is None else x.tobytes() for x in names], pa.binary()), pa.array(units, pa.binary())],
                ["k", "cid", "copies", "names", "packed", "unit"])

    return classes_.mapInArrow(
        sign, "k string, cid long, copies long, names array<bigint>, packed binary, unit binary")


def link_sums(signed: DataFrame, scratch: Scratch, tables: int, probes: int, cosine: float) -> DataFrame:
    """Rows (a, b, n): with b null, n further links of class a; else an edge of the spanning forest."""
    each = signed.select("k", F.posexplode("names").alias("place", "bucket"))
    each = scratch.save(each.select("k", "bucket", (F.col("place") % (1 + probes) == 0).alias("own")), "buckets")
    counts = each.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any_own"))
    counts = scratch.save(counts.where("n > 1 and any_own").select("bucket", "n"), "counts")
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    members = join_hot(each, counts, "bucket", counts)
    block = F.pmod(F.xxhash64("k"), many).cast("int")
    members = members.select("k", "bucket", block.alias("block"), F.explode(F.sequence(F.lit(0), many - 1)).alias("other"))
    members = members.select("k", "bucket", "block", F.least("block", "other").alias("left"),
                             F.greatest("block", "other").alias("right"))
    rows = members.join(signed.select("k", "cid", "copies", "packed", "unit"), "k").drop("k")
    width = 1 + probes

    def first_meeting(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
        """Whether ``bucket`` is the first one that the pairs (rows of a and b, by names) meet in."""
        a, b = a.reshape(-1, tables, width), b.reshape(-1, tables, width)
        # The least bucket per table in which one of the two is at home and the other comes by.
        far = np.int64(np.iinfo(np.int64).max)
        in_a = np.where((b == a[:, :, :1]).any(2), a[:, :, 0], far)
        in_b = np.where((a == b[:, :, :1]).any(2), b[:, :, 0], far)
        met = np.minimum(in_a, in_b)
        t = (met != far).argmax(1)
        return met[np.arange(len(met)), t] == bucket

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = {"packed": lambda c: fixed(c, "<i8"), "unit": lambda c: _ragged(c)}
        out: list[list] = [[], [], []]
        for g in sorted_groups(batches, ["bucket", "left", "right"], decode):
            bucket, same = int(g["bucket"][0]), g["left"][0] == g["right"][0]
            x, names, cid, copies = np.stack(g["unit"]), g["packed"], g["cid"], g["copies"]
            one = np.flatnonzero(g["block"] == g["left"][0])
            two = one if same else np.flatnonzero(g["block"] == g["right"][0])
            if not len(one) or not len(two):
                continue
            home = (names.reshape(len(cid), tables, width)[:, :, 0] == bucket).any(1)
            total = np.zeros(len(cid), np.int64)
            near = np.zeros((len(one), len(two)), bool)
            for lo in range(0, len(one), 64):
                part = one[lo:lo + 64]
                hit = x[part] @ x[two].T >= cosine
                hit &= home[part][:, None] | home[two][None, :]
                if same:
                    hit &= part[:, None] != two[None, :]
                near[lo:lo + 64] = hit
                i, j = np.nonzero(hit)
                i, j = part[i], two[j]
                if len(i):
                    ok = first_meeting(names[i], names[j], bucket)
                    np.add.at(total, i[ok], copies[j[ok]])
                    if not same:
                        np.add.at(total, j[ok], copies[i[ok]])
            for i in np.flatnonzero(total).tolist():
                out[0].append(int(cid[i])), out[1].append(None), out[2].append(int(total[i]))
            if near.any():
                rows_, linked = one, near
                if not same:
                    n, rows_ = len(one), np.concatenate([one, two])
                    linked = np.zeros((len(rows_), len(rows_)), bool)
                    linked[:n, n:], linked[n:, :n] = near, near.T
                forest = [(rows_[a], rows_[b]) for a, b in spanning(len(rows_), lambda i, rest: linked[i, rest])]
                for a, b in forest:
                    out[0].append(int(cid[a])), out[1].append(int(cid[b])), out[2].append(0)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])

    keys = ["bucket", "left", "right"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(compare, "a long, b long, n long")


def _ragged(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    for i in range(len(column)):
        out[i] = np.frombuffer(column[i].as_buffer(), float)
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 6, hashes: int = 2, probes: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows, groups = classes(vectors)
    groups = scratch.save(groups, "classes")
    signed = scratch.save(_signed(groups, tables, hashes, probes), "signed")
    found = scratch.save(link_sums(signed, scratch, tables, probes, cosine), "links")
    labels = components(found.where("b is not null").select("a", "b"), scratch)
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    known = (groups.select("k", "cid", "copies").join(sums.withColumnRenamed("a", "cid"), "cid", "left")
             .join(labels.withColumnRenamed("node", "cid"), "cid", "left")
             .select("k", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "cid").alias("component_id")))
    out = join_hot(rows.select("vec_id", "k"), known, "k", groups.select("k", F.col("copies").alias("n")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
