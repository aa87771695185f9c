"""Helpers shared by the operators: tables in the shared folder, hot-key joins,
connected components, and vectorised word hashing inside Arrow tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.session import shared_dir

#: A key with at least 1/HOT of all rows is hot, so that there are at most HOT hot keys, whatever the input.
HOT = 1000


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where only the driver's path names it."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = root + (os.pathsep + known if known else "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one call, written to the shared folder of the cluster.

    A written table cuts the lineage and survives lost executors. ``drop``
    removes those that no later table or result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/archgraph/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{label}-{self.n}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with ``right`` (one row per key) where single keys may hold any share of ``left``.

    ``counts`` (key, n), a written table, counts the rows of ``left``. Keys with
    1/HOT of all rows or more are at most HOT many, so their rows of ``right``
    are broadcast; all others join by a shuffle in which no key is large. Null
    keys match nothing; a left join keeps their rows beside the shuffle.
    """
    # Two numbers settle here whether a key is hot, so that plans carry no sum over all counts, nor a broadcast without need.
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if total is None or most * HOT < total:
        return left.join(right, key, how)
    hot = counts.where(F.col("n") * HOT >= F.lit(total)).select(key)
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot_right), key, how)
    far = marked.where(f"_hot is null and {key} is not null").drop("_hot").join(right, key, how)
    out = near.unionByName(far)
    if how == "left":
        more = {f.name: F.lit(None).cast(f.dataType) for f in right.schema if f.name != key}
        out = out.unionByName(left.where(f"{key} is null").withColumns(more))
    return out


def as_row(docs: DataFrame) -> Column:
    """All columns of a table as one, so that they may have any names beside those an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges."""
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable over undirected ``edges``; only nodes that have an edge.

    Alternating large-star and small-star steps. Each is a minimum per node,
    combined before the shuffle, and a join on the node whose few hot keys are
    split by ``join_hot``; every round is written to the shared folder.
    """
    now = scratch.save(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                       .where("u < v").distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = scratch.save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        least = near.select("u", F.least("u", "m").alias("m"))
        large = (join_hot(both, least, "u", near.select("u", "n")).where("v > u")
                 .select(F.col("m").alias("u"), "v").where("u < v").distinct())
        large = scratch.save(large, "large")
        flipped = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = flipped.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = scratch.save(low, "low")
        small = (join_hot(flipped, low.select("u", "m"), "u", low.select("u", "n"))
                 .select(F.col("m").alias("u"), "v").where("u < v")
                 .unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        small = scratch.save(small, "small")
        before, mark = mark, _mark(small)
        scratch.drop(near, low, large, now)
        now = small
        if mark == before:
            roots = now.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


# --- words of whole texts, inside Arrow tasks -------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at a time; a longer word makes its piece longer.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the bounds of its rows; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(raw: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE,
          heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between the bytes that ``space`` marks, of every row; A-Z read as a-z.

    Returns 64-bit hashes, byte lengths, and for each row the index of its
    first word (one entry more than rows). With ``heads`` the hashes have one
    more row for each, of the words' first so many bytes.
    """
    n = len(raw)
    if n == 0:
        none = np.zeros((1 + len(heads), 0), np.uint64)
        return none if heads else none[0], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    space = space[raw]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], first[1:] = True, space[:-1]
    last[-1], last[:-1] = True, space[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = True
    last[inner - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    del first, last, space
    hashes = np.empty((1 + len(heads), len(starts)), np.uint64)
    longest = int((ends - starts).max(initial=0))
    up, down = _powers(_P, min(n, PIECE + longest)), _powers(_PINV, min(n, PIECE + longest))
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = ends[j - 1]
        values = _BYTE[LOWER[raw[lo:hi]]] * up[:hi - lo]
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(values, dtype=np.uint64, out=total[1:])
        at = starts[i:j] - lo
        hashes[0, i:j] = (total[ends[i:j] - lo] - total[at]) * down[at] + (ends[i:j] - starts[i:j]).astype(np.uint64)
        for k, head in enumerate(heads):
            upto = np.minimum(at + head, ends[i:j] - lo)
            hashes[k + 1, i:j] = (total[upto] - total[at]) * down[at] + np.uint64((head << 32) + k)
        i = j
    hashes = mix(hashes)
    return hashes if heads else hashes[0], ends - starts, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows of one text; the whole sequence where it has fewer words."""
    width = min(k, len(hashes))
    if not width:
        return hashes
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i:len(hashes) - width + 1 + i])
    return out


def row_groups(bounds: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``size`` bytes, so that temporaries stay small."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def fixed(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), kind)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(kind).reshape(n, -1)


def lists(column: pa.Array) -> np.ndarray:
    """The rows of a list column of numbers as an array of arrays."""
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    out = np.empty(len(column), object)
    for i in range(len(column)):
        out[i] = values[offsets[i]:offsets[i + 1]]
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str],
                  decode: dict) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal ``keys`` in a sorted stream of batches, as columns read by ``decode`` (numbers otherwise)."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: decode.get(c, np.asarray)(batch.column(i)) for i, c in enumerate(batch.schema.names)}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        n = len(now[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:-1]):
            yield {c: v[lo:hi] for c, v in now.items()}
        held = {c: v[cuts[-2]:].copy() for c, v in now.items()}
    if held is not None:
        yield held


def spanning(n: int, linked) -> list[tuple[int, int]]:
    """A spanning forest of ``n`` rows: ``linked(i, rest)`` says which of ``rest`` row ``i`` links to.

    A row is compared only with rows that no tree has reached yet.
    """
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            edges += [(i, j) for j in rest[hit].tolist()]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return edges


#: A CTE ``crc(t)``: the table of the reflected checksum polynomial, as SQL.
CRC_TABLE_SQL = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """The unsigned crc32 of an SQL text beside the table ``crc``."""
    octet = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: {octet})"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")
