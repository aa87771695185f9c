"""Byte-pair encoding by a tokenization automaton, and decoding by the labels of its arcs.

The automaton reads tokens. It starts as one state with an arc for every base
symbol, and each merge (a, b) -> c, in rank order, adds one gadget: the state
that ``a`` leads to gives way to a copy without its arc ``b``, and every state
that has an arc ``a`` gets an arc ``c`` to the state that ``b`` leads to at that
moment. All arcs of one label lead to one state, so a state is named by the
token that enters it, and two tables hold the whole automaton: ``lost[a][b]``,
the gadget that took arc ``b`` from the state of ``a``; and for a merged token
its gadget and its two parts, of which the right one's state, as it then stood,
is where the token leads. It accepts exactly the sequences that merging by rank
makes, so a word has one accepted path, found along the
vocabulary's trie. That takes time in proportion to the word's length,
whatever the word; a word of a million letters needs no quadratic merging.

Words are split off as the tokenizer's file says. White space never stands
inside a word, so texts are taken apart at spaces and line feeds and results
are remembered per piece, in a memory of bounded size.

Null texts read as empty and give no ids; ids of null stay null. Texts of any
length are encoded whole. Repeated rows give repeated results and no order
matters, so there are no ties. Extra columns, of any name, are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import row_groups, text_bytes

#: Pieces of text and words remembered per Python worker, twice over at most; arcs four times that.
REMEMBERED = 250_000
_NEVER = 1 << 62
# What the file's pattern splits printable lower-case Latin-1 text without white space into.
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^0-9a-z²³¹¼½¾ªµºß-öø-ÿ]+")
_LATIN = re.compile("[!-~¡-¬®-ÿ]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Automaton:
    """The deterministic automaton of a list of merges over numbered tokens."""

    def __init__(self, base: Iterable[int], merges: list[tuple[int, int, int]]):
        """``base`` symbols and (left, right, made) in rank order, all as small numbers."""
        known = set(base)
        n = 1 + max([*known, *(c for _, _, c in merges)])
        self.size, self.left, self.right, self.gadget = n, [-1] * n, [-1] * n, [-1] * n
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        self.never: set[int] = set()
        self._arcs: dict[int, bool] = {}
        for rank, (a, b, c) in enumerate(merges):
            if a not in known or b not in known:
                raise ValueError(f"merge {rank} uses a token before it is made")
            if c in known:
                raise ValueError(f"token {c} is made twice")
            known.add(c)
            self._gadget(rank, a, b, c)

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        # Earlier merges may leave no path of the two arcs; then nothing makes the token.
        if a in self.never or not self._find_arc(a, b):
            self.never.add(c)
        self.lost[a][b] = rank
        self.gadget[c], self.left[c], self.right[c] = rank, a, b

    def accepts(self, tokens: Sequence[int]) -> bool:
        return not any(t in self.never for t in tokens[:1]) and all(map(self.has_arc, tokens, tokens[1:]))

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state that token ``state`` leads to has an arc ``token``."""
        key = state * self.size + token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= 4 * REMEMBERED:
                self._arcs.clear()
            known = self._arcs[key] = self._find_arc(state, token)
        return known

    def _find_arc(self, state: int, token: int) -> bool:
        # The state is that of its right part as it stood before gadget ``until``; a merged arc is there if that of its
        # left part was there at the merged arc's own gadget ``made``.
        if token in self.never:
            return False
        until = _NEVER
        while state >= 0:
            lost, arc, made = self.lost[state], token, _NEVER
            if lost:
                while arc >= 0:
                    gone = lost.get(arc)
                    if gone is not None and gone < until and gone <= made:
                        return False
                    made, arc = self.gadget[arc], self.left[arc]
            until, state = min(until, self.gadget[state]), self.right[state]
        return True


class Memory(dict):
    """A dictionary of what was met lately: when full, what was not asked for since it was last full is forgotten."""

    def __init__(self) -> None:
        super().__init__()
        self.before: dict = {}

    def __missing__(self, key):
        value = self[key] = self.before[key]
        return value

    def room(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class Tokenizer:
    """Encodes and decodes by the automaton of a tokenizer's file (byte-level BPE whose words end in a suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, library = file["model"], Library.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback")
                     or model.get("ignore_merges") or file.get("decoder"))
        added = file.get("added_tokens") or []
        plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        vocab: dict[str, int] = model["vocab"]
        alphabet = ByteLevel.alphabet()
        plain &= bool(self.end) and all(c in vocab and c + self.end in vocab for c in alphabet)
        split = next((p for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if not plain or not split or library.normalizer is None:
            raise ValueError("this encoder is for byte-level BPE files with a word suffix, a normaliser and no decoder")
        self.special = {t["content"]: t["id"] for t in added}
        self._special = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.latin = split["pattern"].get("Regex") == _PATTERN

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = [vocab[c + end] for c in alphabet for end in ("", self.end)]
        self.automaton = Automaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.label = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        # The trie of the tokens' symbols; -1 keys a node's own token.
        self.trie: dict = {}
        made = {a + b for a, b in merges}
        for token, i in vocab.items():
            symbols = self.symbols(token.removesuffix(self.end), token.endswith(self.end))
            if token in made or len(symbols) == 1:
                node = self.trie
                for s in symbols:
                    node = node.setdefault(s, {})
                node[-1] = i
        # UTF-8 bytes, read as Latin-1, to the printable stand-ins of the file, both in the same order.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in seen}
        self.shown |= {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(seen)))}
        self.words = Memory()

    def symbols(self, stem: str, ended: bool = True) -> list[str]:
        out = list(stem)
        if ended and out:
            out[-1] += self.end
        return out

    def path(self, symbols: list[str]) -> list[int]:
        """The one accepted path of a word. The longest token is tried first; of every opening of the word there is
        one path, so a place from which the word cannot be finished is tried once."""
        has_arc, n = self.automaton.has_arc, len(symbols)
        at, state, out, stack, dead = 0, -1, [], [], set()
        options: list[tuple[int, int]] | None = None
        while at < n:
            if options is None:
                options, node = [], self.trie
                for j in range(at, n):
                    node = node.get(symbols[j])
                    if node is None:
                        break
                    if -1 in node:
                        options.append((j + 1, node[-1]))
            while options:
                end, token = options.pop()
                if end not in dead and (state < 0 or has_arc(state, token)):
                    stack.append((at, state, options))
                    out.append(token)
                    at, state, options = end, token, None
                    break
            else:
                dead.add(at)
                at, state, options = stack.pop()
                out.pop()
        return out

    def word(self, shown: str) -> list[int]:
        """The path of a word given by its stand-ins, remembered."""
        words = self.words
        if shown in words:
            return words[shown]
        found = words.before.get(shown)
        if found is None:
            found = self.path(self.symbols(shown))
        if len(shown) <= 64:
            words[shown] = found
        return found

    def piece(self, text: str) -> list[int]:
        """Ids of a text between spaces and line feeds."""
        if self.latin and _LATIN.fullmatch(text) and "<|" not in text:
            words = _LATIN_WORDS.findall(text.lower())
            return [i for w in words for i in self.word(w.encode().decode("latin-1").translate(self.shown))]
        out: list[int] = []
        for part in filter(None, self._special.split(text)):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [i for w, _ in self.split(self.normalise(part)) for i in self.word(w)]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for part in text.replace("\n", " ").split(" ") if part for i in self.piece(part)]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, joined by spaces as where a file names no decoder; unknown ids have none."""
        return " ".join(self.label[i] for i in ids if i in self.label)


_KNOWN: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _KNOWN:
        _KNOWN[path] = Tokenizer(path)
    return _KNOWN[path]


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded]) of every text; ``decoded`` adds what ``decode`` gives for the ids, in the same pass."""
    schema = "ids array<int>" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokenizer(tokenizer_path)
        # of a piece: its ids as bytes, and their labels
        known = Memory()
        known[""] = (b"", "")

        def learn(parts: list[str]) -> None:
            for p in [p for p in set(parts) if p not in known]:
                found = known.before.get(p)
                if found is None:
                    ids = code.piece(p)
                    found = array("i", ids).tobytes(), " " + " ".join(map(code.label.__getitem__, ids)) if decoded and ids else ""
                known[p] = found

        for batch in batches:
            text = batch.column(1)
            for lo, hi in row_groups(text_bytes(text)[1], 4 << 20):
                raw, labels = [], []
                for t in text[lo:hi].to_pylist():
                    parts = (t or "").replace("\n", " ").split(" ")
                    known.room()
                    code.words.room()
                    learn(parts)
                    found = list(map(known.__getitem__, parts))
                    raw.append(b"".join([f[0] for f in found]))
                    if decoded:
                        labels.append("".join([f[1] for f in found])[1:])
                bounds = np.cumsum([0, *map(len, raw)]) // 4
                flat = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, pa.py_buffer(b"".join(raw))])
                columns = [batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)]
                if decoded:
                    columns.append(pa.array(labels, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def decode(encoded: DataFrame, tokenizer_path: str, column: str = "ids") -> DataFrame:
    """(doc_id, decoded) of a column of ids; null ids give null, ids that no arc has are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokenizer(tokenizer_path)
        for batch in batches:
            out = [None if ids is None else code.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, decoded string")


def digest_columns(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode(…, decoded=True)``."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
