"""Best-fit packing: best-fit decreasing over token counts, with a segment tree over remaining capacities.

Documents of equal length are interchangeable, so the best-fit search runs over
the histogram of lengths (at most ``capacity`` rows, whatever the corpus) and
places whole runs of equal pieces into whole runs of equally filled sequences:
exactly the sequences that best-fit decreasing would make one document at a
time. The plan's runs are then looked up by each piece's rank within its
length. Tokenising, ranking and placing are distributed.

Null texts count as empty (one token: the closing id 0), texts of any length
are cut, repeated rows are packed once each, extra columns are ignored, and an
empty table gives an empty result. Null ids stay null.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.llm.common import Scratch

#: Words remembered per Python worker; the memory is emptied when full.
REMEMBERED = 400_000
# What the tokenizer splits lower-case Latin-1 words into: contractions, runs of letters, single digits, other runs.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9a-z²³¹¼½¾ªµºß-öø-ÿ]+")
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0]|<\\|")
_CODERS: dict[str, "Coder"] = {}


class Coder:
    """Token ids of a text as little-endian 32-bit bytes, for a byte-level BPE file with word ends.

    No token spans white space, so ids are remembered by word. New words are
    merged by rank with the file's own merges; the end of a word is a byte that
    UTF-8 never holds, joined to the last byte before anything else. Texts
    outside Latin-1, with control characters or with a special token's opening
    go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        end = model["end_of_word_suffix"]
        # Bytes and their printable stand-ins in the file, both in the same order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain}
        shown |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        assert set(shown) == set(ByteLevel.alphabet())

        def raw(token: str) -> bytes:
            stem = token.removesuffix(end)
            return bytes(shown[c] for c in stem) + (b"\xff" if token != stem else b"")

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(256)] + [raw(a + b) for a, b in merges]
        ranks = {token: i for i, token in enumerate(dict.fromkeys(order))}
        ids = {raw(token): i for token, i in model["vocab"].items() if set(token.removesuffix(end)) <= set(shown)}
        self.ids_of = np.array([ids.get(token, 0) for token in ranks], "<u4")
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = [i for part in _SPLIT.findall(word) for i in self.merge(part.encode() + b"\xff")]
        return self.ids_of[found].tobytes() if found else b""

    def ids(self, text: str) -> bytes:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(text)
        if _ODD.search(text):
            return self.whole(text)
        found, known = text.lower().split(), self.known
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = self.word(w)
        return b"".join(map(known.__getitem__, found))


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]) of every document's ids and the closing 0."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = coder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc, text = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in range(8)]
            for i in range(batch.num_rows):
                raw = code.ids(text[i].as_py() or "") + bytes(4)
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    n = len(part) // 4
                    for column, value in zip(out, (doc[i], p, at // 4, n, zlib.crc32(part), task, int(seen[n]))):
                        column.append(value)
                    if with_ids:
                        out[7].append(np.frombuffer(part, "<u4").astype(np.int32))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            if with_ids:
                columns, names = [*columns, pa.array(out[7], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Segment tree over remaining capacities: which of them some open sequence has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, count: int) -> None:
        if count and left:
            self.runs[left].append((first, count))
            self._mark(left, True)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        if not self.runs[left]:
            self._mark(left, False)
        return run

    def _mark(self, left: int, there: bool) -> None:
        i = left + self.size
        self.tree[i] = there
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need``: up to the first right sibling that has one, then down."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1 and (i % 2 or not self.tree[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces per sequence, first place), and the number of sequences.

    Pieces ``rank``, ``rank`` + 1, … of a length fill the row's sequences one
    after the other.
    """
    bins, rows, made = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            left = bins.tightest(length)
            if left is None:
                left = capacity
                first, count = made, -(-rest // (capacity // length))
                made += count
            else:
                first, count = bins.take(left)
            each = left // length
            used = min(count, -(-rest // each))
            placed = min(rest, used * each)
            rows.append((length, rank, first, each, capacity - left))
            full, part = divmod(placed, each)
            bins.put(left - each * length, first, full)
            if part:
                bins.put(left - part * length, first + full, 1)
            bins.put(left, first + used, count - used)
            rank, rest = rank + placed, rest - placed
    return np.array(rows, np.int64).reshape(-1, 5), made


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and place; ``with_ids`` adds the token ids themselves."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer_path, capacity, with_ids), "pieces")
    counts = scratch.save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    # At most ``capacity`` rows come to the driver, and the plan's size depends on them alone.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit(histogram, capacity)
    # Lengths and ranks in one ascending key for a binary search.
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for batch in batches:
            names = batch.schema.names
            length = np.asarray(batch.column(names.index("length")))
            rank = np.asarray(batch.column(names.index("rank"))) + np.asarray(batch.column(names.index("before")))
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = first_of[n], first_of[n + 1]
                here = length == n
                row[here] = lo + np.searchsorted(plan[lo:hi, 1], rank[here], "right") - 1
            run = plan[row]
            within = rank - run[:, 1]
            keep = [i for i, c in enumerate(names) if c not in ("rank", "task", "before")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(run[:, 2] + within // run[:, 3]),
                 pa.array(run[:, 4] + within % run[:, 3] * length)],
                [*(names[i] for i in keep), "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    ranked = cut.join(offsets, ["length", "task"]).select(*cut.columns, "before")
    return ranked.mapInArrow(place, schema)
