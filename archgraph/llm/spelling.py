"""Grouping of spelling variants: words one inserted, deleted or replaced code point apart, by dense tiles.

Words and their counts come from whole texts. Two words of lengths m <= n are
one edit apart if and only if they differ and their common prefix and common
suffix together reach n - 1 code points. Tiles test that: the words of a tile
are rows of padded code-point matrices, two such blocks are compared cell by
cell, and only what each word gains from the tile leaves it (how many near
words, and the best of them), never a pair.

Which blocks can hold near words follows from halving the shorter word at m // 2:
one edit leaves either the first part or the rest intact. So each word is
placed four times, as the shorter (or equal) and as the longer one, by its
first part and by its rest. Words that meet under both keys count under the
first part alone. A key's words are cut into blocks by a hash, and
each pair of blocks is a tile of its own, so that no task holds a key whole.

Null texts have no words. Null ids are written as empty text in the hashed
names. Rows that repeat an id and a text count as often as they stand there.
Ties for the best near word go to the smallest in code-point order. Texts of any
length are read whole, words of any length are compared whole. Extra columns,
of any name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import CRC_TABLE_SQL, Scratch, crc_sql, ready

#: Code points of a block, and its most words; two blocks make a tile.
BLOCK_POINTS, BLOCK = 1 << 15, 1024
#: Distinct words counted in a task before their counts are passed on.
HELD = 300_000
#: Pairs compared at a time, and the most code points of a padded matrix.
PAIRS, POINTS = 1 << 18, 1 << 24
#: Keys of so few words are compared side by side, many at a time.
FEW = 64
_LETTERS = "[a-zÀ-ÿ]"


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, slip: int = 97) -> DataFrame:
    """(word, n) of lower-cased (A-Z) runs of letters with at least so many code points and occurrences.

    Where ``slip`` divides the crc32 h of ``<doc_id>:<run>``, the run loses its
    code point h % length; 0 leaves all runs as they are.
    """
    ready(docs.sparkSession)
    find = re.compile(_LETTERS + f"{{{max(min_length, 1)},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # Bytes lower A-Z alone.
                found = find(text.encode().lower().decode())
                if not slip:
                    counts.update(found)
                    continue
                name = zlib.crc32(b":" if doc is None else b"%s:" % str(doc).encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), name)
                    if not h % slip:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield out()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def placed(words: DataFrame) -> DataFrame:
    """(key, long, word, n): the four places of each word; ``long`` tells the longer words of a key from the shorter."""
    size = F.length("word")

    def keys(shorter, long: bool):
        cut = F.floor(shorter / 2).cast("int")
        head = F.concat(F.lit("<"), shorter.cast("string"), F.lit(" "), F.substring("word", 1, cut))
        rest = F.concat(F.lit(">"), shorter.cast("string"), F.lit(" "), F.substring("word", size - (shorter - cut) + 1, shorter))
        return [F.struct(k.alias("key"), F.lit(long).alias("long")) for k in (head, rest)]

    # A word of one code point, taken as the longer one, has an empty shorter partner, which is no word.
    every = F.array(*keys(size, False), *keys(size - 1, True))
    return words.select("word", "n", F.explode(every).alias("_at")).select("_at.*", "word", "n")


def tiles(places: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, a, b, side, long, word, n): each word in every pair of blocks of its key that it belongs to.

    Keys without two words, or with longer words only, hold no pair and go.
    ``side`` is 0 in block ``a`` and 1 in block ``b``; within one block all are 0.
    """
    places = scratch.save(places, "places")
    sizes = places.groupBy("key").agg(F.count("*").alias("_n"), F.count_if(~F.col("long")).alias("_short"),
                                      F.max(F.length("word")).alias("_size"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_POINTS) / F.col("_size"))))
    sizes = sizes.where("_n > 1 and _short > 0").select("key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    cut = places.join(sizes, "key").withColumn("_own", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    dealt = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select("key", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"),
                        (F.col("_own") > F.col("_other")).cast("int").alias("side"), "long", "word", "n")


class Block:
    """Padded code-point matrices of words, one column per word: from the first code point on, and from the last on."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.size = np.fromiter(map(len, words), np.int32, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if not flat.size or flat.max() < 256:
            flat = flat.astype(np.uint8)
        column = np.repeat(np.arange(len(words)), self.size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.ahead = np.zeros((int(self.size.max(initial=0)), len(words)), flat.dtype)
        self.ahead[at, column] = flat
        self.back = np.zeros_like(self.ahead)
        self.back[self.size[column] - 1 - at, column] = flat
        # The greatest rank is the best form: largest n, then the smallest word.
        self.by_rank = sorted(sorted(range(len(words)), key=lambda i: words[i], reverse=True), key=lambda i: n[i])
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.by_rank] = np.arange(len(words))
        self.count, self.best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)

    def run(self, way: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many leading rows of ``way`` agree between columns ``i`` and ``j``, which broadcast."""
        agree = np.ones(np.broadcast_shapes(i.shape, j.shape), bool)
        out = np.zeros(agree.shape, np.int16 if len(way) < 1 << 15 else np.int32)
        for line in way:
            agree &= line[i] == line[j]
            out += agree
            if len(way) > 64 and not agree.any():
                break
        return out

    def compare(self, i: np.ndarray, j: np.ndarray, rest: bool | np.ndarray, once: bool = False) -> None:
        """Add what words ``i`` and ``j`` gain from each other. ``rest``: whether they met by their rest, so that those
        whose first parts agree too count elsewhere; ``once``: each pair stands here in both orders."""
        short, long = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        head, tail = np.minimum(self.run(self.ahead, i, j), short), np.minimum(self.run(self.back, i, j), short)
        hit = (head + tail >= long - 1) & ~(rest & (head >= short // 2))
        if once:
            hit &= i < j
        at = np.nonzero(hit)
        u, v = np.broadcast_to(i, hit.shape)[at], np.broadcast_to(j, hit.shape)[at]
        for x, y in ((u, v), (v, u)):
            self.count += np.bincount(x, minlength=len(self.count))
            np.maximum.at(self.best, x, self.rank[y])

    def gains(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.count)
        best = [self.by_rank[r] for r in self.best[at]]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.words[i] for i in at], pa.string()), pa.array(self.count[at]),
             pa.array(self.n[best], pa.int64()), pa.array([self.words[i] for i in best], pa.string())],
            ["word", "n_near", "form_n", "form"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What words gain from the tiles of a stream sorted by (key, a, b): (word, n_near, form_n, form)."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        starts = _starts(now)
        # The last tile may go on in the next batch.
        yield from _compared(now.slice(0, starts[-1]), starts)
        held = now.slice(starts[-1])
    if held is not None:
        yield from _compared(held, [0, held.num_rows])


def _starts(rows: pa.Table) -> list[int]:
    new = np.ones(rows.num_rows, bool)
    for c in ("key", "a", "b"):
        v = rows.column(c).combine_chunks()
        v = np.asarray(v.dictionary_encode().indices if c == "key" else v)
        new[1:] = (v[1:] != v[:-1]) | (new[1:] if c != "key" else False)
    return np.flatnonzero(new).tolist()


def _compared(rows: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
    """Tiles from ``starts`` on, as many of one kind at a time as fit a matrix."""
    i = 0
    while i < len(starts) - 1:
        kind = rows.column("key")[starts[i]].as_py().partition(" ")[0]
        j, width = i + 1, int(kind[1:]) + 1
        while (j < len(starts) - 1 and (starts[j + 1] - starts[i]) * width <= POINTS
               and rows.column("key")[starts[j]].as_py().partition(" ")[0] == kind):
            j += 1
        lo = starts[i]
        yield _tiles(rows.slice(lo, starts[j] - lo), [s - lo for s in starts[i:j + 1]], kind[0] == ">")
        i = j


def _tiles(rows: pa.Table, bounds: list[int], rest: bool) -> pa.RecordBatch:
    column = {c: np.asarray(rows.column(c)) for c in ("n", "a", "b", "side", "long")}
    block, long, side = Block(rows.column("word").to_pylist(), column["n"]), column["long"].astype(bool), column["side"]
    inside = column["a"] == column["b"]
    left, right, held = [], [], 0
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo <= FEW and inside[lo]:
            u, v = np.triu_indices(hi - lo, 1)
            keep = ~(long[lo + u] & long[lo + v])
            left.append(lo + u[keep])
            right.append(lo + v[keep])
            held += len(left[-1])
            if held >= PAIRS:
                block.compare(np.concatenate(left), np.concatenate(right), rest)
                left, right, held = [], [], 0
            continue
        here = np.arange(lo, hi)
        one = here[side[lo:hi] == 0]
        two = one if inside[lo] else here[side[lo:hi] == 1]
        # Two longer words meet where they are the shorter ones.
        meetings = [(one[~long[one]], two[~long[two]], bool(inside[lo])), (one[~long[one]], two[long[two]], False)]
        if not inside[lo]:
            meetings.append((one[long[one]], two[~long[two]], False))
        for p, q, once in meetings:
            step = max(1, PAIRS // max(1, len(q)))
            for k in range(0, len(p), step):
                block.compare(p[k:k + step, None], q[None, :], rest, once)
    if held:
        block.compare(np.concatenate(left), np.concatenate(right), rest)
    return block.gains()


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, n_near, form, form_n) of (word, n): near words counted; the near word of largest n, if 2n or more."""
    tiled = tiles(placed(words), scratch)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    gains = dealt.mapInArrow(compare, "word string, n_near long, form_n long, form string")
    # The best of the best: largest n, then the smallest word.
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w")))
    gains = gains.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    out = words.join(gains, "word", "left")
    form = F.when(-F.col("_best.n") >= 2 * F.col("n"), F.col("_best"))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                      form["w"].alias("form"), (-form["n"]).alias("form_n"))


def roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``found`` with ``root``: forms followed to the last, twice as far with each round.

    A form has at least twice its word's n, so chains end. Words that have
    arrived are not joined any more.
    """
    forms = found.where("form is not null").select("word", F.col("form").alias("root"))
    on = forms.select(F.col("word").alias("root"), F.lit(True).alias("_on"))
    now = forms.join(on, "root", "left").select("word", "root", F.col("_on").isNotNull().alias("on"))
    now = scratch.save(now, "steps")
    while not now.where("on").isEmpty():
        after = now.select(F.col("word").alias("root"), F.col("root").alias("_root"), F.col("on").alias("_on"))
        moved = now.where("on").join(after, "root").select("word", F.col("_root").alias("root"), F.col("_on").alias("on"))
        before, now = now, scratch.save(now.where("not on").unionByName(moved), "steps")
        scratch.drop(before)
    return found.join(now.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, slip: int = 97) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(word_counts(docs, min_length, min_count, slip), "words")
    return roots(scratch.save(near_words(words, scratch), "near"), scratch)


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]+')) AS w
  FROM documents),
counted AS (
  SELECT w, n, {crc_sql("name")} AS h
  FROM (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS name, count(*) AS n FROM run WHERE length(w) >= 5
        GROUP BY doc_id, w), crc),
words AS (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n
        FROM counted)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
cut AS (
  SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest
  FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (
  SELECT a.w, b.w AS v, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cut a JOIN words b ON a.rest = b.w
  UNION SELECT b.w, a.w, a.n FROM cut a JOIN words b ON a.rest = b.w),
best AS (
  SELECT w, count(*) AS n_near, first(v ORDER BY n DESC, v) AS form, first(n ORDER BY n DESC, v) AS form_n
  FROM near GROUP BY w),
form AS (
  SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form,
         CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (w)),
follow(w, reached) AS (
  SELECT w, w FROM form
  UNION ALL SELECT follow.w, form.form FROM follow JOIN form ON form.w = follow.reached WHERE form.form IS NOT NULL)
SELECT f.w AS word, f.n, f.n_near, f.form, f.form_n, follow.reached AS root
FROM form f JOIN follow ON follow.w = f.w JOIN form ended ON ended.w = follow.reached AND ended.form IS NULL
"""
