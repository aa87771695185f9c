"""Prefix trie of conversations: shards of sorted paths, and a skeleton of the nodes that cross their borders.

A conversation is the path of its turns from the root, written as 16 bytes a
turn (a digest of role and text). Paths sort so that the members of a node are
neighbours. Sampled splitters cut that order into shards; a node whose members
lie in several shards is a prefix of a splitter, and the trie of the splitters'
prefixes is the skeleton. It is broadcast, each shard builds its part of the
trie in one pass over its sorted paths, with a stack as deep as the trie, and
finishes every node outside the skeleton. For nodes of the skeleton shards emit
partial aggregates, one row per shard and node, which are reduced by key and
then summed up the skeleton.

Splitters end one turn beyond what they share with their neighbours in the
sample, as far as they must to part them, so the skeleton holds no more than the
depths that neighbours share; it is limited to ``SKELETON`` bytes, and where the
sample has more, fewer splitters are used, all conversations still being read.
Copies of one conversation are split by conv_id. The ids of those that end in a
skeleton node come out in chunks of text, in order, and are digested as a stream.

Null roles and texts read as empty; rows without conv_id belong to no
conversation and have no part. Turns are ordered null first, equal turns by
their digests; equal rows are all kept, one after the other. Texts of any length
are digested whole. A path is one row of 32 bytes a turn. Extra columns, of any
name, are ignored; an empty table has no member, thus no root: the result is empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import CRC_TABLE_SQL, Scratch, crc_sql

#: Turns of a shard to aim at, and the most shards.
SHARD, SHARDS = 20_000, 16_384
#: Bytes of splitter paths, on the driver and in the broadcast skeleton; sampled paths per shard.
SKELETON, SAMPLED = 4 << 20, 8
#: Ids of one chunk of text.
CHUNK = 8_192
_SIZE = 16
_WORD = r"[^\x20\x09-\x0D]+"
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")


def paths(rows: DataFrame, scratch: Scratch, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, path, words): the rebuilt conversations, a digest of 16 bytes and a number of words for each turn.

    Of h = crc32(conv_id) % ``heads`` opening turns, each conversation takes those
    of the first conversation of its ``group``, in place of its own; a negative
    id's remainder is negative, as in SQL.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).alias("words"))
    turns = rows.where("conv_id is not null").select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"))
    turns = scratch.save(turns, "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    opening = turns.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), F.slice("turns", 1, max(1, heads - 1)).alias("_opening"))
    joined = turns.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group).join(opening, "_first", "left")
    # At most `group` conversations share an opening, so the join has no large key.
    none = F.slice("turns", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("_opening", none), 1, h), F.slice("turns", h + 1, F.size("turns")))
    return joined.select("conv_id", rebuilt.alias("_turns")).select(
        "conv_id", F.unhex(F.array_join(F.col("_turns.digest"), "")).alias("path"),
        F.col("_turns.words").cast("array<int>").alias("words"))


class Skeleton:
    """The trie of the prefixes of all splitters; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), _SIZE):
                key = (node, path[at:at + _SIZE])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(at // _SIZE + 1)
                node = self.child[key]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def shared(a: bytes, b: bytes) -> int:
    """How many opening turns two paths share."""
    if a[:_SIZE] != b[:_SIZE]:
        return 0
    n = min(len(a), len(b)) // _SIZE
    if a[:n * _SIZE] == b[:n * _SIZE]:
        return n
    x, y = (np.frombuffer(v[:n * _SIZE], "<u8").reshape(n, 2) for v in (a, b))
    return int((x != y).any(1).argmax())


def splitters(sample: list[tuple[bytes, int]], shards: int, most: int = SKELETON) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 borders, evenly through the sorted sample, of at most ``most`` bytes together."""
    sample = sorted(sample)
    while True:
        at = sorted({len(sample) * k // shards for k in range(1, shards)} - {0}) if len(sample) > 1 else []
        out = []
        for k in at:
            (path, conv), before = sample[k], sample[k - 1][0]
            if path != before:
                # Less than any id: the border stands before all conversations with this opening.
                path, conv = path[:(shared(before, path) + 1) * _SIZE], -(1 << 63)
            out.append((path, conv))
        out = sorted(set(out))
        if sum(len(p) for p, _ in out) <= most:
            return out
        shards //= 2


class _Node:
    __slots__ = ("least", "n", "children", "leaves", "saved", "words", "skeleton", "ends", "held", "pending")

    def __init__(self, words: int, skeleton: int):
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.words, self.skeleton, self.ends = words, skeleton, None
        self.held: list[int] = []
        self.pending: list[tuple] = []


class Shard:
    """One pass over the sorted paths of a shard. ``nodes`` and ``partial`` collect finished rows until they are taken.

    Rows of ``nodes``: those of the result, with the skeleton node of the parent (or null) in place of an unknown
    parent_conv_id. Rows of ``partial``: (skeleton node, least conv_id, n, children outside the skeleton, their leaves,
    their saved tokens, words, chunk number, chunk of ids).
    """

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.nodes, self.partial = skeleton, [], []
        self.stack: list[_Node] = []
        self.path = b""
        self.chunk = 0

    def add(self, conv: int, path: bytes, words: np.ndarray) -> None:
        if not self.stack:
            self.stack.append(_Node(0, 0))
        keep = shared(self.path, path)
        while len(self.stack) > keep + 1:
            self._close()
        for d in range(len(self.stack) - 1, len(path) // _SIZE):
            above = self.stack[-1].skeleton
            here = self.skeleton.child.get((above, path[d * _SIZE:(d + 1) * _SIZE]), -1) if above >= 0 else -1
            self.stack.append(_Node(int(words[d]), here))
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.held.append(conv)
        if len(top.held) == CHUNK:
            self._flush(top)
        self.path = path

    def _flush(self, node: _Node) -> None:
        """Pass the held ids on: into the node's digest, or as a chunk where other shards have ids of the node too."""
        if not node.held:
            return
        text = ",".join(map(str, node.held))
        node.held = []
        if node.skeleton >= 0:
            self.chunk += 1
            self.partial.append((node.skeleton, None, 0, 0, 0, 0, None, self.chunk, text))
        else:
            if node.ends is None:
                node.ends = hashlib.sha256(text.encode())
            else:
                node.ends.update(b"," + text.encode())

    def _close(self) -> None:
        node = self.stack.pop()
        self._flush(node)
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.skeleton >= 0:
            self.partial.append((node.skeleton, node.least, node.n, node.children, node.leaves, node.saved, node.words, None, None))
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            sha = (node.ends or hashlib.sha256()).hexdigest()
            row = (node.least, len(self.stack), node.n, node.children, node.leaves, node.saved, sha)
            if above.skeleton >= 0:
                self.nodes.append((*row, None, above.skeleton))
            else:
                above.pending.append(row)
        # The least conv_id of a node is known when it closes, and so are its children's parents.
        self.nodes += [(*row, node.least, None) for row in node.pending]

    def finish(self) -> None:
        while self.stack:
            self._close()
        self.path = b""


_SHARD_SCHEMA = ("conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
                 "ends_sha256 string, parent_conv_id long, above long, node long, shard long, words long, chunk long, ids string")
_KINDS = [pa.int64()] * 6 + [pa.string()] + [pa.int64()] * 6 + [pa.string()]
_NAMES = [c.split()[0] for c in _SHARD_SCHEMA.split(", ")]


def _rows(work: Shard, shard: int) -> pa.RecordBatch:
    found = [(conv, depth, n, children, leaves, saved, sha, parent, above, None, None, None, None, None)
             for conv, depth, n, children, leaves, saved, sha, parent, above in work.nodes]
    found += [(least, None, n, children, leaves, saved, None, None, None, node, shard, words, chunk, ids)
              for node, least, n, children, leaves, saved, words, chunk, ids in work.partial]
    work.nodes, work.partial = [], []
    columns = list(zip(*found)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """One row per node of the rebuilt conversations' trie."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    at = scratch.save(paths(conversations, scratch, group, heads), "paths")
    total = at.agg(F.count("*").alias("convs"), F.sum(F.size("words") + 1).alias("turns")).first()
    if not total.convs:
        return spark.createDataFrame([], NODES)
    shards = min(SHARDS, -(-total.turns // SHARD))
    # Paths that would fill the sample by themselves are no splitters; the rest are taken by a hash of their ids.
    short = at.where(F.length("path") <= SKELETON // 16).select("path", "conv_id", F.xxhash64("conv_id").alias("_h"))
    wanted = short.orderBy("_h", "conv_id").limit(shards * SAMPLED)
    size = wanted.agg(F.sum(F.length("path")).alias("n")).first().n or 0
    if size > 2 * SKELETON:
        wanted = wanted.limit(max(1, shards * SAMPLED * SKELETON // size))
    sample = [(bytes(r.path), r.conv_id) for r in wanted.select("path", "conv_id").collect()] if shards > 1 else []
    skeleton = Skeleton(splitters(sample, shards))
    known = spark.sparkContext.broadcast(skeleton)  # at most SKELETON bytes of paths

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = known.value
        for batch in batches:
            shard = [s.shard(p, c) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, now = Shard(known.value), -1
        for batch in batches:
            conv, shard, words = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2)
            offsets, flat = np.asarray(words.offsets), np.asarray(words.values)
            for i in range(batch.num_rows):
                if shard[i] != now:
                    work.finish()
                    if work.nodes or work.partial:
                        yield _rows(work, now)
                    now, work.chunk = shard[i], 0
                work.add(conv[i], batch.column(1)[i].as_py(), flat[offsets[i]:offsets[i + 1]])
                if len(work.nodes) + len(work.partial) >= CHUNK:
                    yield _rows(work, now)
        work.finish()
        yield _rows(work, now)

    dealt = at.mapInArrow(assign, "conv_id long, path binary, words array<int>, shard int")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    built = scratch.save(dealt.mapInArrow(build, _SHARD_SCHEMA), "nodes")

    partial = built.where("node is not null")
    reduced = partial.where("chunk is null").groupBy("node").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"))
    ends = _digests(partial.where("chunk is not null").select("node", "shard", "chunk", "ids"), shards)
    # One row for each node of the skeleton comes to the driver.
    crossing = spark.createDataFrame(_summed(skeleton, reduced.join(ends, "node", "left").collect()), "node long, " + NODES)
    top = crossing.select(F.col("node").alias("above"), F.col("conv_id").alias("_parent"))
    rest = built.where("node is null").join(F.broadcast(top), "above", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    names = [c.split()[0] for c in NODES.split(", ")]
    return rest.select(names).unionByName(crossing.select(names))


def _digests(chunks: DataFrame, parts: int) -> DataFrame:
    """(node, sha): of each node's chunks, joined by commas in the order of shards and chunks, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(3)):
                if here == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256()
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()),
                                              pa.array([r[1] for r in out], pa.string())], ["node", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], ["node", "sha"])

    ordered = chunks.repartition(parts, "node").sortWithinPartitions("node", "shard", "chunk")
    return ordered.mapInArrow(run, "node long, sha string")


def _summed(skeleton: Skeleton, reduced: list) -> list[tuple]:
    """Rows of the skeleton's nodes: children come after their parents, so sums run from the last node up."""
    none = hashlib.sha256().hexdigest()
    found = {r.node: [r.least, r.n, r.children, r.leaves, r.saved, r.words, r.sha or none] for r in reduced}
    for node in sorted(found, reverse=True):
        row = found[node]
        row[3] = row[3] or 1
        row[4] += (row[1] - 1) * row[5]
        if node:
            above = found[skeleton.parent[node]]
            above[2] += 1
            above[3] += row[3]
            above[4] += row[4]
    return [(node, row[0], skeleton.depth[node], found[skeleton.parent[node]][0] if node else None, *row[1:5], row[6])
            for node, row in found.items()]


SQL = f"""
WITH {CRC_TABLE_SQL},
turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'digest': digest, 'words': words}} ORDER BY turn NULLS FIRST, digest) AS turns
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, coalesce(f.turns, o.turns[1:0])[1:h] || o.turns[h + 1:] AS path
  FROM (SELECT own.*, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM own, crc) o
  LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
member AS (
  SELECT conv_id, d, path[1:d] AS node, d = len(path) AS ends
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * node[d].words END AS saved
  FROM member GROUP BY node, d),
children AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN children USING (node)),
below AS (
  SELECT top AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT node[1:k] AS top, saved, n_children FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_node))
  GROUP BY top)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_node n JOIN below b ON b.node = n.node
LEFT JOIN node p ON n.d > 0 AND p.node = n.node[1:n.d - 1]
"""
