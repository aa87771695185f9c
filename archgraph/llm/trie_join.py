"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

Exact: every pair of documents whose sets reach the similarity is linked.

1. Shingles get a global order, rarest first: by the size of the bucket they
   fall into, counted over the whole corpus in a table of fixed size, then by
   hash. Any fixed order keeps results exact; this one keeps common shingles
   out of prefixes.
2. Documents with equal sets are one class. Sets that reach the similarity share
   a shingle within a prefix of each, so classes meet by prefix shingle. Rows are
   first dealt by ranges of (shingle, size), where only those stay that stand
   beside a row of the same shingle and a size that the similarity allows; then
   large meetings are split into blocks. Rows there hold a parity of the set, a few
   bits per allowed difference, whose differing bits bound the overlap from
   above; what survives is reduced to a spanning forest per meeting, never to
   pairs.
3. Each connected group of candidates gets its sets once, in blocks of bounded
   size. A block pair's sets are stored in a trie (commonest first, shared
   beginnings once); every set walks down it level by level with running
   overlaps, leaving subtrees whose remaining length cannot make up the overlap.
   Verified links, again as a forest, make the components.

Null texts and texts without words have no set and link with nothing; texts
shorter than a shingle have one, of all their words. Rows of a null doc_id link
with nothing and have a null component. Rows of one doc_id count as one node;
extra columns are ignored by ``cluster`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import (as_row, Scratch, components, join_hot, lists, mix, row_groups, shingles, sorted_groups,
                                  spanning, text_bytes, words)

#: Classes of a block where classes meet by shingle, and shingles of a block of sets.
MEETING, WEIGHT = 2048, 1 << 20
#: Buckets of the table of shingle counts, as a power of two.
BUCKET_BITS = 18


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    raw, bounds = text_bytes(column)
    for i, j in row_groups(bounds):
        hashes, _, first = words(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
        for r in range(j - i):
            yield np.unique(shingles(hashes[first[r]:first[r + 1]], k))


def bucket_ranks(docs: DataFrame, k: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """How much fuller than the mean each bucket of shingles is, in powers of two; 2**bits small numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            raw, bounds = text_bytes(batch.column(0))
            for i, j in row_groups(bounds):
                hashes, _, first = words(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                if len(hashes) >= k:
                    found = shingles(hashes, k)  # windows over the ends of texts add noise to other buckets only
                    total += np.bincount((found & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        there = np.flatnonzero(total)
        for at in range(0, len(there), 1 << 16):
            part = there[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most 2**bits rows
    total = np.zeros(1 << bits)
    total[np.asarray(found.column(0).combine_chunks())] = np.asarray(found.column(1).combine_chunks())
    return np.floor(np.log2(np.maximum(total / max(total.mean(), 1.0), 1))).astype(np.uint8)


def _ranks(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return ranks[(found & np.uint64(len(ranks) - 1)).astype(np.int64)]


def signatures(docs: DataFrame, ranks: np.ndarray, k: int, part: int, of: int) -> DataFrame:
    """doc_id, n_shingles, digest (null without a set), prefix, parity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, prefixes, parities = [], [], [], []
            for s in _sets(batch.column(1), k):
                n = len(s)
                sizes.append(n)
                if not n:
                    digests.append(None), prefixes.append(None), parities.append(None)
                    continue
                order = np.argsort(_ranks(s, ranks), kind="stable")
                prefixes.append(s[order[:n - -(-part * n // of) + 1]].view(np.int64))
                with np.errstate(over="ignore"):
                    digests.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()]).tobytes())
                parities.append(parity(s, part, of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.binary())],
                ["doc_id", "n_shingles", "digest", "prefix", "parity"])

    schema = "doc_id long, n_shingles long, digest binary, prefix array<bigint>, parity binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def parity(s: np.ndarray, part: int, of: int) -> bytes:
    """Whether each of 2**m classes of hashes holds an odd number of the set: enough that unlike sets differ in more
    bits than sets at the similarity have different members."""
    differ = 2 * len(s) * (of - part) / (of + part)
    bits = 1 << max(9, int(np.ceil(np.log2(max(2.7 * differ, 1)))))
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _folded(rows: np.ndarray, words_: int) -> np.ndarray:
    """Parities of fewer classes from those of more."""
    while rows.shape[1] > words_:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


class Parities:
    """The rows of a meeting, compared by parity: which of them may link."""

    def __init__(self, sizes: np.ndarray, parities: np.ndarray, part: int, of: int):
        self.sizes, self.part, self.of = sizes, part, of
        self.words = np.array([len(p) for p in parities])
        self.place = np.empty(len(parities), np.int64)  # within the rows of equal width
        self.tables: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            here = np.flatnonzero(self.words == w)
            self.place[here] = np.arange(len(here))
            self.tables[w] = np.stack(parities[here])
        self.narrow: dict[tuple[int, int], np.ndarray] = {}

    def may_link(self, i: int, rest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rest), bool)
        size, mine = self.sizes[rest], int(self.sizes[i])
        near = np.flatnonzero((self.of * np.minimum(size, mine) >= self.part * np.maximum(size, mine)))
        own = int(self.words[i])
        for w in np.unique(self.words[rest[near]]).tolist():
            at = near[self.words[rest[near]] == w]
            to = min(own, w)
            if (w, to) not in self.narrow:
                self.narrow[w, to] = _folded(self.tables[w], to)
            probe = _folded(self.tables[own][self.place[i]][None], to)
            differ = np.bitwise_count(self.narrow[w, to][self.place[rest[at]]] ^ probe).sum(1, dtype=np.int64)
            both = mine + size[at]
            most = np.minimum((both - differ) // 2, np.minimum(mine, size[at]))
            out[at] = self.of * most >= self.part * (both - most)
        return out


def _in_blocks(rows: DataFrame, key: str, blocks, *keep: str) -> DataFrame:
    """Rows of a group in ``blocks`` parts, once per pair of parts that theirs belongs to."""
    block = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    out = rows.withColumn("_blocks", blocks).withColumn("_block", block)
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.select(key, F.least("_block", "_other").alias("left"), F.greatest("_block", "_other").alias("right"), *keep)


def candidates(classes: DataFrame, scratch: Scratch, part: int, of: int) -> DataFrame:
    """Edges (a, b) that connect all classes of one meeting whose parities allow the similarity."""
    def accompanied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a neighbour that they may link to; sizes ascend, so the nearest size is beside a row. The first
        and last row of a range stay: their neighbours may be in another range."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(i)) for i in range(3)]
            now = [np.concatenate([h, c]) for h, c in zip(held, now)] if held is not None else now
            shingle, size, cid = now
            beside = (shingle[1:] == shingle[:-1]) & (of * size[:-1] >= part * size[1:])
            keep = np.zeros(len(shingle), bool)
            keep[1:] |= beside
            keep[:-1] |= beside
            # Of the two rows carried over the first is settled, the second is not yet; one alone is the range's first.
            lo = 1 if held is not None and len(held[0]) > 1 else 0
            keep[0] |= lo == 0
            out = keep[lo:-1]
            yield pa.RecordBatch.from_arrays([pa.array(shingle[lo:-1][out]), pa.array(cid[lo:-1][out])], ["shingle", "cid"])
            held = [c[-2:] for c in now]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0][-1:]), pa.array(held[2][-1:])], ["shingle", "cid"])

    order = ["shingle", "n_shingles", "cid"]
    each = classes.select(F.explode("prefix").alias("shingle"), "n_shingles", "cid")
    each = each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(accompanied, "shingle long, cid long")
    each = scratch.save(each, "accompanied")
    counts = scratch.save(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingles")
    met = join_hot(each, counts, "shingle", counts)
    met = met.join(classes.select("cid", "n_shingles", "parity"), "cid")
    rows = _in_blocks(met, "shingle", F.ceil(F.col("n") / MEETING).cast("int"), "cid", "n_shingles", "parity")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], []]
        for g in sorted_groups(batches, ["shingle", "left", "right"], {"parity": _words}):
            cid = g["cid"]
            for a, b in spanning(len(cid), Parities(g["n_shingles"], g["parity"], part, of).may_link):
                out[0].append(int(cid[a])), out[1].append(int(cid[b]))
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])
                out = [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    keys = ["shingle", "left", "right"]
    edges = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(forest, "a long, b long")
    return scratch.save(edges.distinct(), "candidates")


def _words(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    for i in range(len(column)):
        out[i] = np.frombuffer(column[i].as_buffer(), np.uint64)
    return out


class Trie:
    """Sets as ascending number sequences, shared beginnings stored once, nodes level by level."""

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: distinct, sorted lexicographically."""
        n = len(sets)
        lengths = np.array([len(s) for s in sets])
        shared = np.zeros(n + 1, np.int64)  # with the set before
        for i in range(1, n):
            m = min(lengths[i - 1], lengths[i])
            differ = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
            shared[i] = differ[0] if len(differ) else m
        segments, first, last, child, ends, least, most, depth, self.parent = [], [], [], [], [], [], [], [], []
        queue = [(0, n, 0, -1)]
        while queue:
            after = []
            for lo, hi, at, up in queue:
                if up >= 0 and child[up][0] < 0:
                    child[up] = (len(first), 0)
                if up >= 0:
                    child[up] = (child[up][0], len(first) + 1)
                end = int(lengths[lo]) if hi - lo == 1 else int(min(lengths[lo], shared[lo + 1:hi].min()))
                if up < 0:
                    end = 0
                me = len(first)
                segments.append(sets[lo][at:end])
                first.append(lo), last.append(hi), child.append((-1, -1)), depth.append(end), self.parent.append(up)
                least.append(lengths[lo:hi].min()), most.append(lengths[lo:hi].max())
                own = int(lengths[lo]) == end
                ends.append(lo if own else -1)
                start = lo + own
                cuts = [start, *(i for i in range(start + 1, hi) if shared[i] <= end), hi] if start < hi else []
                after += [(a, b, end, me) for a, b in zip(cuts, cuts[1:])]
            queue = after
        self.flat = np.concatenate(segments) if segments else np.zeros(0, np.int64)
        self.size = np.array([len(s) for s in segments])
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.child, self.ends = np.array(child), np.array(ends)
        self.least, self.most, self.depth = np.array(least), np.array(most), np.array(depth)
        self.final = np.array([s[-1] if len(s) else -1 for s in segments])
        self.alive = np.array(last) - np.array(first)
        self.lengths, self.node_of = lengths, np.empty(n, np.int64)
        self.node_of[self.ends[self.ends >= 0]] = np.flatnonzero(self.ends >= 0)

    def drop(self, i: int) -> None:
        """Set i is found no more, and subtrees without sets are not entered."""
        node = int(self.node_of[i])
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]
        self.ends[self.node_of[i]] = -1

    def linked(self, probe: np.ndarray, flag: np.ndarray, part: int, of: int) -> np.ndarray:
        """Sets that reach part / of with ``probe``; ``flag`` marks its numbers."""
        size, found = len(probe), []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            ends = self.ends[nodes]
            done = ends >= 0
            here, got = ends[done], overlap[done]
            found.append(here[of * got >= part * (size + self.lengths[here] - got)])
            lo, hi = self.child[nodes, 0], self.child[nodes, 1]
            inner = lo >= 0
            width = (hi - lo)[inner]
            if not width.sum():
                break
            below = np.repeat(lo[inner] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            overlap = np.repeat(overlap[inner], width)
            keep = (self.alive[below] > 0) & (of * self.most[below] >= part * size) & (part * self.least[below] <= of * size)
            below, overlap = below[keep], overlap[keep]
            if not len(below):
                break
            n = self.size[below]
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            hits = flag[self.flat[np.repeat(self.at[below] - start, n) + np.arange(n.sum())]]
            overlap = overlap + np.add.reduceat(hits, start, dtype=np.int64)
            # What may still come: the longest rest below, and what of the probe is not passed yet.
            rest = np.minimum(self.most[below] - self.depth[below], size - np.searchsorted(probe, self.final[below], "right"))
            need = -(-part * (size + self.least[below]) // (part + of))
            keep = overlap + rest >= need
            nodes, overlap = below[keep], overlap[keep]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def forest_of_links(sets: list[np.ndarray], part: int, of: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of sets of numbers, each ascending in one order."""
    sequences = [s.astype(">u4").tobytes() for s in sets]
    order = sorted(range(len(sets)), key=sequences.__getitem__)
    edges, distinct = [], []
    for i in order:
        if distinct and sequences[distinct[-1]] == sequences[i]:
            edges.append((distinct[-1], i))
        else:
            distinct.append(i)
    trie = Trie([sets[i] for i in distinct])
    flag = np.zeros(max((int(s[-1]) for s in sets), default=0) + 1, np.int64)
    rest = set(range(len(distinct)))
    while rest:
        queue = [rest.pop()]
        trie.drop(queue[0])
        while queue and rest:
            i = queue.pop()
            probe = sets[distinct[i]]
            flag[probe] = 1
            for j in trie.linked(probe, flag, part, of).tolist():
                edges.append((distinct[i], distinct[j]))
                trie.drop(j)
                rest.discard(j)
                queue.append(j)
            flag[probe] = 0
    return edges


def verified(docs: DataFrame, grouped: DataFrame, ranks: np.ndarray, scratch: Scratch, k: int, part: int, of: int) -> DataFrame:
    """Edges (a, b) of verified links, from groups (cid, grp, blocks) of candidates."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in _sets(batch.column(3), k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.int64()))],
                                             ["cid", "grp", "blocks", "set"])

    # Texts meet their groups by a sort-merge join at every size, so that cost follows the input.
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("cid"), "text").hint("merge")
    rows = texts.join(grouped, "cid").select("cid", "grp", "blocks", "text")
    rows = rows.mapInArrow(expand, "cid long, grp long, blocks int, set array<bigint>")
    rows = _in_blocks(rows, "grp", F.col("blocks"), "cid", "set")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["grp", "left", "right"], {"set": lists}):
            cid, sets = g["cid"], [s.view(np.uint64) for s in g["set"]]
            known = np.unique(np.concatenate(sets))
            place = np.empty(len(known), np.int64)  # commonest first
            place[np.lexsort((known, -_ranks(known, ranks).astype(np.int64)))] = np.arange(len(known))
            numbered = [np.sort(place[np.searchsorted(known, s)]) for s in sets]
            edges = forest_of_links(numbered, part, of)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b])], ["a", "b"])

    keys = ["grp", "left", "right"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


def cluster(docs: DataFrame, k: int = 5, part: int = 80, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id; sets of ``k``-word shingles link at a similarity of part / of or more."""
    scratch = Scratch(docs.sparkSession, "trie")
    ranks = bucket_ranks(docs, k)
    signed = scratch.save(signatures(docs, ranks, k, part, of), "signed")
    classes = scratch.save(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("prefix").alias("prefix"), F.first("parity").alias("parity")), "classes")
    edges = candidates(classes, scratch, part, of)
    groups = scratch.save(components(edges, scratch).withColumnRenamed("node", "cid"), "groups")
    weights = groups.join(classes.select("cid", "n_shingles"), "cid").groupBy("component").agg(
        F.sum("n_shingles").alias("weight"), F.count("*").alias("n"))
    weights = scratch.save(weights.select("component", "n", F.ceil(F.col("weight") / WEIGHT).cast("int").alias("blocks")), "weights")
    grouped = join_hot(groups, weights.select("component", "blocks"), "component", weights.select("component", "n"))
    grouped = scratch.save(grouped.select("cid", F.col("component").alias("grp"), "blocks"), "grouped")
    scratch.drop(edges, weights)
    links = scratch.save(verified(docs, grouped, ranks, scratch, k, part, of), "links")
    found = components(links, scratch).withColumnRenamed("node", "cid")
    known = classes.select("digest", "cid", "copies").join(found, "cid", "left")
    known = scratch.save(known.select("digest", "copies", F.coalesce("component", "cid").alias("component")), "known")
    out = join_hot(signed.select("doc_id", "n_shingles", "digest"), known.select("digest", "component"), "digest",
                   known.select("digest", F.col("copies").alias("n")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, part: int = 80, of: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that link, at any remove, to a smaller doc_id; rows of a null id stay."""
    gone = cluster(docs, k, part, of).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.col("doc_id").alias("_id"), as_row(docs))
    return rows.hint("merge").join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
