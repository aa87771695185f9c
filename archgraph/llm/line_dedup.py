"""Substring dedup by hashing of lines: repeated units go, the earliest ranked occurrence stays.

Units are paragraphs (runs of lines between blank lines), whole lines, and the
sentences of lines that have several, each with ``min_words`` words or more;
and runs of k = 2 * ``min_words`` words, wherever lines and sentences end, taken
where their hash is the least of k neighbouring runs. So any 2k - 1 words that
two texts share have a run in common, and of longer passages all but fewer than
k words at either end is covered. A unit is normalised (lower case, single
spaces, no punctuation at its ends, in runs at those of each word) and hashed to
128 bits; digests are counted over the whole corpus with their earliest
occurrence by (doc_id, offset). All other occurrences, also within one document
but where they overlap the earliest, are removed; results name them by their
offsets in the original text, in code points.

Null and empty texts have no units. Rows of a null doc_id rank last. Different
texts of one doc_id, or of none, rank by a hash of the text. Rows with equal
doc_id and text are one occurrence, so repeated rows lose the same spans.
Extra columns are kept by ``clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import Scratch, as_row, join_hot, row_groups, shingles, text_bytes

_SENTENCE = re.compile(r"[^.!?]*[.!?]*")
#: Words remembered per task.
REMEMBERED = 300_000
_ENDS = " .,;:!?'\"()[]-*#|"


#: What ``str.split`` splits at.
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)] + [False])
# Two polynomials over word hashes make a digest of 128 bits; the inverses shift a stretch of words to the front.
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_INVERSES = [np.uint64(pow(int(p), -1, 1 << 64)) for p in _BASES]


class Words:
    """Distinct words of a task with the hashes of their forms: as they stand (lower case), without punctuation at the
    left, at the right, and at both ends. Forms are hashed to 128 bits, of which the first half of the last one also
    decides which runs are chosen. Emptied by its owner."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[bytes] = []

    def number(self, words: list[str]) -> np.ndarray:
        index = self.index
        for w in set(words).difference(index):
            index[w] = len(self.rows)
            low = w.lower()
            left, right = low.lstrip(_ENDS), low.rstrip(_ENDS)
            one = _word_digest(low)
            if left is low and right is low:
                self.rows.append(one * 4 + bytes(8))
                continue
            two = one if left == low else _word_digest(left)
            three = one if right == low else _word_digest(right)
            four = two if right == low else three if left == low else _word_digest(left.rstrip(_ENDS))
            self.rows.append(one + two + three + four + bytes([not left]) + bytes(7))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def forms(self, words: list[str]) -> np.ndarray:
        """(words, 9): two halves of each of the four forms, and whether nothing but punctuation is there."""
        ids = self.number(words)
        if len(ids) < 1000:
            return np.frombuffer(b"".join(map(self.rows.__getitem__, ids.tolist())), "<u8").reshape(-1, 9)
        some, place = np.unique(ids, return_inverse=True)
        return np.frombuffer(b"".join(map(self.rows.__getitem__, some.tolist())), "<u8").reshape(-1, 9)[place]


def _word_digest(word: str) -> bytes:
    raw = word.encode("utf-8", "surrogatepass")
    # the first half as it has always been, so that the same runs are chosen
    return blake2b(raw, digest_size=8).digest() + blake2b(raw, digest_size=8, salt=b"2").digest()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Sums:
    """Polynomial sums of stretches of a row of word hashes."""

    def __init__(self, hashes: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        self.powers, self.inverse = powers, inverse
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers[:len(hashes)], dtype=np.uint64, out=self.total[1:])

    def stretch(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.total[hi] - self.total[lo]) * self.inverse[lo]


def chosen(hashes: np.ndarray, width: int) -> list[int]:
    """Of each ``width`` neighbours one with the least hash: the last one, but no other while the one before still is."""
    if len(hashes) < width:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], width)[::-1]
    last = np.arange(len(windows)) + width - 1 - windows.argmin(1)
    out: list[int] = []
    for i in np.flatnonzero(np.diff(last, prepend=-1)).tolist():
        at = int(last[i])
        if out and out[-1] >= i and hashes[out[-1]] == hashes[at]:
            # Equal hashes: the next is due when the one before leaves the window.
            at = int(last[out[-1] + 1]) if out[-1] + 1 < len(last) and hashes[last[out[-1] + 1]] == hashes[at] else out[-1]
        if not out or at > out[-1]:
            out.append(at)
    return out


def _split_sentences(codes: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places after each run of closing marks, whether a word goes on there)."""
    mark = (codes == 46) | (codes == 33) | (codes == 63)
    after = np.flatnonzero(mark[:-1] & ~mark[1:]) + 1
    return after, ~space[after]


def units(text: str, min_words: int, known: Words | None = None) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a whole text, by their start."""
    start, end, one, two, _ = batch_units([text], min_words, known or Words())
    both = np.stack([one, two], 1).astype("<u8")
    return [(int(a), int(b), both[i].tobytes()) for i, (a, b) in enumerate(zip(start, end))]


def batch_units(texts: list[str], min_words: int, known: Words) -> tuple[np.ndarray, ...]:
    """Units of several texts, by text and start: start, end, the two halves of the digest, number of the text.

    All texts are one row of words; stretches of it are paragraphs, lines,
    sentences and runs, and no stretch leaves its text.
    """
    joined = "\n\n".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 2) - sizes - 2
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    space = _SPACE[np.minimum(codes, 0x3001)]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    w_start, w_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    forms = known.forms(joined.split())
    n = len(forms)
    powers, inverses = [_powers(p, n) for p in _BASES], [_powers(p, n) for p in _INVERSES]
    sums = [[_Sums(forms[:, 2 * form + half], powers[half], inverses[half]) for half in (0, 1)] for form in (0, 3)]

    # Lines that hold words, as stretches of words; blank lines part paragraphs, and texts are parted by blank lines.
    breaks = np.flatnonzero(codes == 10)
    l_start, l_end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    lo, hi = np.searchsorted(w_start, l_start), np.searchsorted(w_start, l_end)
    full = hi > lo
    new = np.concatenate([[True], ~full[:-1]]) & full
    group = np.cumsum(new)[full]
    l_lo, l_hi = lo[full], hi[full]
    p_at = np.flatnonzero(np.diff(group, prepend=-1))
    p_n = np.diff(np.append(p_at, len(group)))
    several = p_n > 1
    p_lo, p_hi = l_lo[p_at[several]], l_hi[(p_at + p_n - 1)[several]]

    # Sentences, where a line has more than one; where a mark stands inside a word the line is cut by hand below.
    after, inside = _split_sentences(codes, space) if len(codes) > 1 else (none, none.astype(bool))
    line_of = np.searchsorted(l_start, after, "right") - 1
    within = after < l_end[line_of]
    after, inside, line_of = after[within], inside[within], line_of[within]
    odd_lines = np.unique(line_of[inside])
    plain = ~np.isin(line_of, odd_lines)
    cut_lines = np.unique(line_of[plain])
    s_at = np.sort(np.concatenate([l_start[cut_lines], after[plain]]))
    s_line = np.searchsorted(l_start, s_at, "right") - 1
    s_end = np.append(s_at[1:], len(codes))
    s_end = np.minimum(s_end, l_end[s_line])
    s_lo, s_hi = np.searchsorted(w_start, s_at), np.searchsorted(w_start, s_end)

    # A sentence's words must end inside it: marks are followed by white space in plain lines, so they do.
    u_lo, u_hi = (np.concatenate(x) for x in ((p_lo, l_lo, s_lo), (p_hi, l_hi, s_hi)))
    long = u_hi - u_lo >= min_words
    u_lo, u_hi = u_lo[long], u_hi[long]
    # Words of punctuation alone at the ends go with the punctuation.
    bare = forms[:, 8] != 0
    left, right = u_lo.copy(), u_hi - 1
    while (more := (left < u_hi - 1) & bare[left]).any():
        left[more] += 1
    while (more := (right > left) & bare[right]).any():
        right[more] -= 1
    halves = []
    for half in (0, 1):
        inner = sums[0][half].stretch(np.minimum(left + 1, right), right) * _BASES[half]
        ends = forms[left, 2 + half] + inner + forms[right, 4 + half] * powers[half][right - left]
        halves.append(np.where(left == right, forms[left, 6 + half], ends))
    start, end = w_start[u_lo], w_end[u_hi - 1]

    # Runs of k words of one text, chosen by their own hashes.
    k = 2 * min_words
    bounds = np.searchsorted(w_start, np.append(first, len(codes)))
    picked = _chosen_runs(forms[:, 6], bounds, k)
    start, end = np.concatenate([start, w_start[picked]]), np.concatenate([end, w_end[picked + k - 1]])
    for half in (0, 1):
        halves[half] = np.concatenate([halves[half], sums[1][half].stretch(picked, picked + k)])

    by_hand = [(int(l_start[i]), u) for i in odd_lines.tolist() for u in _odd_sentences(joined[l_start[i]:l_end[i]], min_words, known)]
    if by_hand:
        start = np.concatenate([start, [at + u[0] for at, u in by_hand]])
        end = np.concatenate([end, [at + u[1] for at, u in by_hand]])
        for half in (0, 1):
            halves[half] = np.concatenate([halves[half], np.array([u[2 + half] for _, u in by_hand], np.uint64)])
    text = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((end, start))
    return (start - first[text])[order], (end - first[text])[order], halves[0][order], halves[1][order], text[order]


def _odd_sentences(line: str, min_words: int, known: Words) -> list[tuple[int, int, int, int]]:
    """Sentences of a line in which closing marks stand inside words: (start, end, digest halves)."""
    out = []
    cuts = [m.span() for m in _SENTENCE.finditer(line) if m.end() > m.start()]
    for a, b in cuts if len(cuts) > 1 else ():
        words = line[a:b].split()
        if len(words) < min_words:
            continue
        inner = line[a:b].strip()
        at = a + line[a:b].index(inner)
        forms = known.forms(words)
        left, right = 0, len(words) - 1
        while left < right and forms[left, 8]:
            left += 1
        while right > left and forms[right, 8]:
            right -= 1
        both = []
        for half in (0, 1):
            if left == right:
                both.append(int(forms[left, 6 + half]))
                continue
            total, power, base = int(forms[left, 2 + half]), 1, int(_BASES[half])
            for i in range(left + 1, right + 1):
                power = power * base % (1 << 64)
                total += int(forms[i, (4 if i == right else 0) + half]) * power
            both.append(total % (1 << 64))
        out.append((at, at + len(inner), *both))
    return out


def _chosen_runs(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """First words of the chosen runs of ``k`` words of every text; texts with equal runs nearby are chosen one by one."""
    if len(hashes) < 2 * k - 1:
        return np.zeros(0, np.int64)
    run = shingles(hashes, k)
    m = len(run)
    text = np.searchsorted(bounds, np.arange(m), "right") - 1
    whole = np.arange(m) + k <= bounds[np.minimum(text + 1, len(bounds) - 1)]
    twice = np.zeros(m, bool)
    for step in range(1, k):
        twice[:-step] |= (run[:-step] == run[step:]) & whole[:-step] & whole[step:] & (text[:-step] == text[step:])
    slow = np.unique(text[twice])
    windows = np.lib.stride_tricks.sliding_window_view(run[::-1], k)[::-1]
    last = np.arange(len(windows)) + k - 1 - windows.argmin(1)
    end = np.arange(len(windows)) + k - 1
    good = whole[end] & (text[:len(windows)] == text[end]) & ~np.isin(text[:len(windows)], slow)
    out = [np.unique(last[good])]
    for t in slow.tolist():
        lo, hi = int(bounds[t]), int(bounds[t + 1]) - k + 1
        out.append(lo + np.array(chosen(run[lo:hi], k), np.int64))
    return np.sort(np.concatenate(out))


def row_key() -> Column:
    """With the doc_id, the key of a row: rows of one id with different texts stay apart."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, row, place (of the unit in its text), start, end, digest."""
    names = ["doc_id", "row", "place", "start", "end", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            doc, row, text = (batch.column(i) for i in range(3))
            for lo, hi in row_groups(text_bytes(text)[1], 1 << 20):
                if len(known.rows) > REMEMBERED:
                    known = Words()
                start, end, one, two, at = batch_units(text[lo:hi].to_pylist(), min_words, known)
                digest = pa.Array.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(np.stack([one, two], 1).astype("<u8").tobytes())])
                place = np.arange(len(at)) - np.searchsorted(at, at)
                take = pa.array(at + lo)
                columns = [doc.take(take), row.take(take), *(pa.array(c.astype(np.int32)) for c in (place, start, end)), digest.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.where("text is not null").select("doc_id", row_key().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, place int, start int, end int, digest binary")


def removed_spans(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """doc_id, row, n_units, removed (spans without overlap, in order); rows of documents that have units.

    Only occurrences of repeated digests travel on; units are counted where a text's rows lie together.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = scratch.save(occurrences(docs, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start", "end")
    again = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = scratch.save(again, "repeated")
    met = join_hot(found.drop("place"), again.select("digest", "first"), "digest", again.select("digest", "n"))
    # Where a text repeats itself, what overlaps the earliest occurrence stays with it.
    gone = met.where((F.col("start") >= F.col("first.end")) | (F.col("row") != F.col("first.row"))
                     | ~F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
    spans = gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"))
    # What an earlier span covers is dropped; a span that starts within an earlier one extends it.
    merged = F.expr("""aggregate(all, struct(-1 AS upto, cast(array() AS array<struct<start: int, end: int>>) AS kept),
        (a, x) -> CASE WHEN x.end <= a.upto THEN a WHEN x.start < a.upto
                  THEN struct(x.end AS upto, array_append(slice(a.kept, 1, size(a.kept) - 1),
                      struct(try_element_at(a.kept, -1).start AS start, x.end AS end)) AS kept)
                  ELSE struct(x.end AS upto, array_append(a.kept, x) AS kept) END, a -> a.kept)""")
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), merged.alias("removed"))
    counts = found.groupBy("doc_id", "row").agg((F.max("place") + 1).alias("n_units"))
    out = counts.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    return out.select("doc_id", "row", "n_units", "removed")


def removals(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars, removed (start:end, comma-joined), one row per document."""
    spans = removed_spans(docs, min_words).withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))
    out = docs.select("doc_id", row_key().alias("row")).join(spans, same, "left")
    none = F.expr("cast(array() AS array<struct<start: int, end: int>>)")
    out = out.withColumn("removed", F.coalesce("removed", none))
    return out.select(
        "doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.size("removed").cast("long").alias("n_removed"),
        F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)").alias("removed_chars"),
        F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed"))


def clean(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """``docs`` without the removed spans; a line that is left empty goes with its line break."""
    spans = removed_spans(docs, min_words).where("size(removed) > 0").select(
        F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("removed").alias("_removed"))
    rest = F.expr("""aggregate(_removed, struct('' AS out, 0 AS at), (a, x) ->
        struct(concat(a.out, substring(text, a.at + 1, x.start - a.at)) AS out, x.end AS at),
        a -> concat(a.out, substring(text, a.at + 1)))""")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\n[\x20\x09]*(?=\n)", ""), r"^\n|\n$", "")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r"))
    out = docs.select("doc_id", "text", row_key().alias("_row"), as_row(docs)).hint("merge").join(spans, same, "left")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(rest)
    return out.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
