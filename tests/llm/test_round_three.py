"""Prefix trie, spelling variants and the encoding automaton, against plain versions and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archgraph.llm import bpe_automaton, prefix_trie, spelling
from archgraph.llm.common import Scratch
from archgraph.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- prefix trie ------------------------------------------------------------------------------------------------

def plain_trie(rows):
    """Every node by walking all prefixes of all rebuilt conversations."""
    def digest(role, text):
        return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(path):
                node["ends"].append(c)
    out = []
    for path, node in nodes.items():
        below = {p: n for p, n in nodes.items() if p[:len(path)] == path}
        leaves = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(n["members"]) - 1) * len(WORD.findall(p[-1][1])) for p, n in below.items() if p)
        parent = min(nodes[path[:-1]]["members"]) if path else None
        ends = ",".join(map(str, sorted(node["ends"])))
        out.append((min(node["members"]), len(path), parent, len(node["members"]),
                    sum(1 for q in nodes if q and q[:-1] == path), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n, share=0.3):
    words = ["a b", "c", "", "d e f", "g  h", None]
    rows = []
    for c in range(n):
        if rng.random() < share:
            turns = [("user", "same"), ("bot", "copy of all")]
        else:
            turns = [(rng.choice(["user", "bot", None]), rng.choice(words)) for _ in range(rng.randrange(0, 6))]
        rows += [(c, t if t or rng.random() < 0.5 else None, r, x) for t, (r, x) in enumerate(turns)]
    return rows


@pytest.fixture
def talk(spark):
    def make(rows):
        kind = "conv_id long, turn long, role string, text string, path string, shard int, node long"
        return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], kind)
    return make


def rows_of(df):
    names = [c.split()[0] for c in prefix_trie.NODES.split(", ")]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [4, 30, 10**6])
def test_trie_against_all_prefixes(talk, monkeypatch, shard):
    """One shard, a few, and more shards than there are different conversations, copies of a third among them."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = conversations(random.Random(shard), 120) + [(None, 1, "user", "of none"), (-7, 0, "user", "same")]
    rows += [(5, 1, "user", "twice"), (5, 1, "user", "twice")]
    assert rows_of(prefix_trie.trie(talk(rows))) == plain_trie(rows)


def test_trie_of_deep_long_and_few_conversations(talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 50)
    deep = [(20, t, "user", str(t)) for t in range(300)] + [(40, t, "user", str(t)) for t in range(280)]
    rows = deep + [(60, 0, "user", "long " * 200_000), (80, None, None, None), (81, 9, "bot", "one turn")]
    assert rows_of(prefix_trie.trie(talk(rows))) == plain_trie(rows)
    assert prefix_trie.trie(talk(rows).where("false")).collect() == []
    assert rows_of(prefix_trie.trie(talk([(None, 1, "user", "x"), (3, 0, "user", "x")]))) == plain_trie([(3, 0, "user", "x")])


def test_splitters_stay_within_their_bytes():
    rng = random.Random(1)
    deep = [(b"".join(rng.choice([b"0", b"1"]) * 16 for _ in range(60)), i) for i in range(400)]
    out = prefix_trie.splitters(deep, 64)
    assert len(out) == 63 and out == sorted(out)
    # No longer than what parts a border from its neighbour.
    assert max(len(p) for p, _ in out) < 60 * 16
    assert sum(len(p) for p, _ in prefix_trie.splitters(deep, 64, most=1_000)) <= 1_000
    copies = prefix_trie.splitters([(b"x" * 32, i) for i in range(100)], 5)
    assert [c for _, c in copies] == [20, 40, 60, 80]


# --- spelling variants ------------------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows, min_length=5, min_count=3):
    counts = Counter()
    for doc, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def variants_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def spelled(rng, docs):
    """Words of few letters, so that many are near, with repeated letters and chains of forms."""
    base = ["".join(rng.choice("aabÀÿ×é") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = [rng.choice(base) for _ in range(40)]
        for k in range(0, 40, 5):
            w = words[k]
            at = rng.randrange(len(w))
            words[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w.upper()])
        rows.append((i, rng.choice([" ", "\n", "-", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("block", [2, 1024])
def test_variants_against_all_pairs(docs_of, monkeypatch, block):
    """Whole keys, and keys cut into many blocks."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelled(random.Random(block), 60) + [(None, "nulls nulls nulls nulle"), (1, None), (1, ""), (2, "nullx " * 30)]
    rows += [(3, "x" * 3_000 + " " + "x" * 2_999 + " " + "y" * 3_000 + "x")] * 4
    rows += [(70, "chainaaaa " * 40), (71, "chainaaab " * 15), (72, "chainaabb " * 5), (73, "chainabbb " * 2), (74, "chainabbb")]
    want = plain_variants(rows)
    assert len(want) > 40 and any(f and r != f for _, f, r, *_ in want)
    assert variants_of(spelling.variants(docs_of(*rows))) == want
    assert spelling.variants(docs_of((1, "a")).where("false")).collect() == []


def test_tiles_leave_counts_not_pairs(spark, monkeypatch):
    """A key that holds all words is cut into pairs of blocks, each with at most two blocks of rows."""
    monkeypatch.setattr(spelling, "BLOCK", 8)
    words = spark.createDataFrame([("prefix" + "".join(s), i) for i, s in enumerate(
        (a, b) for a in "abcdefghij" for b in "klmnopqrst")], "word string, n long")
    scratch = Scratch(spark, "test")
    tiled = spelling.tiles(spelling.placed(words), scratch)
    sizes = [r.n for r in tiled.groupBy("key", "a", "b").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60
    found = {r.word: r.n_near for r in spelling.near_words(words, scratch).collect()}
    assert set(found.values()) == {18}


def test_short_words_and_no_slips(docs_of):
    rows = [(i, "a ab b abc ab") for i in range(3)]
    got = {(r.word, r.n, r.n_near) for r in spelling.variants(docs_of(*rows), 1, 1, 0).collect()}
    assert got == {("a", 3, 2), ("b", 3, 2), ("ab", 6, 3), ("abc", 3, 1)}


# --- encoding automaton -----------------------------------------------------------------------------------------

def merged(symbols, merges):
    """Plain merging by rank, the leftmost pair first."""
    ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
    while True:
        pairs = [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not pairs:
            return symbols
        rank, i = min(pairs)
        symbols = symbols[:i] + [merges[rank][2]] + symbols[i + 2:]


@pytest.mark.parametrize("seed", range(25))
def test_the_automaton_accepts_what_merging_makes(seed):
    """All sequences of tokens of up to six base symbols: accepted if and only if merging their symbols gives them."""
    rng = random.Random(seed)
    base, merges, made = 3, [], {}
    spelled_as = {i: (i,) for i in range(base)}
    while len(merges) < 12:
        a, b = rng.randrange(len(spelled_as)), rng.randrange(len(spelled_as))
        word = spelled_as[a] + spelled_as[b]
        if word not in made and len(word) < 7:
            made[word] = len(spelled_as)
            merges.append((a, b, made[word]))
            spelled_as[made[word]] = word
    automaton = bpe_automaton.Automaton(range(base), merges)

    def sequences(left):
        yield ()
        for t, word in spelled_as.items():
            if len(word) <= left:
                for rest in sequences(left - len(word)):
                    yield (t, *rest)

    for tokens in sequences(6):
        assert automaton.accepts(tokens) == (merged([s for t in tokens for s in spelled_as[t]], merges) == list(tokens)), tokens


def test_merges_must_be_proper():
    with pytest.raises(ValueError, match="before it is made"):
        bpe_automaton.Automaton(range(2), [(2, 1, 3), (0, 1, 2)])
    with pytest.raises(ValueError, match="made twice"):
        bpe_automaton.Automaton(range(3), [(0, 1, 3), (1, 2, 4), (3, 2, 5), (0, 4, 5)])


def test_encoding_against_the_library(docs_of):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "Don't DON'T 'tis 're", "<|startoftext|>Hi<|endoftext|>x <|END <|endoftext|", "é e ́",
             "A\x1cB\x85c\xa0d\x0b", "İstanbul ŞİĞ ǅ", "a" * 50_000, "12½ ³4", "\U0001f600‍\U0001f525 你好"]
    texts += ["".join(chr(rng.randrange(1, 256)) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x600), rng.randrange(0x2000, 0x3100), 32, 10])) for _ in range(30))
              for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id")]
    found = bpe_automaton.encode(docs_of(*rows), tokenizer_path(), decoded=True)
    got = {r.doc_id: (r.ids, r.decoded) for r in found.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False)), t
    assert found.where("doc_id is null").count() == 2
    again = {r.doc_id: r.decoded for r in bpe_automaton.decode(found, tokenizer_path()).collect()}
    assert again == {i: d for i, (_, d) in got.items()}
    digests = {r.doc_id: r for r in bpe_automaton.digest_columns(found.where("doc_id = 3")).collect()}[3]
    ids, decoded = got[3]
    assert digests.n_tokens == len(ids) and digests.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert digests.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe_automaton.encode(docs_of((1, "a")).where("false"), tokenizer_path()).collect() == []


def test_decoding_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, 10**6])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe_automaton.decode(df, tokenizer_path()).collect()}
    assert got[1] is None and got[2] == "" and got[3] and " " not in got[3]


def test_long_words_take_linear_steps():
    code = bpe_automaton.tokenizer(tokenizer_path())
    calls = Counter()
    real = code.automaton.has_arc
    code.automaton.has_arc = lambda a, b: calls.update(n=1) or real(a, b)
    try:
        for n in (2_000, 4_000):
            calls.clear()
            code.word("a" * n)
            assert calls["n"] < 40 * n
    finally:
        del code.automaton.has_arc


def test_matrices_pad_and_mirror():
    block = spelling.Block(["abc", "xabc", "ab"], np.array([1, 2, 3]))
    assert block.ahead.shape == (4, 3) and "".join(map(chr, block.back[:, 1])) == "cbax"
    block.compare(np.array([0, 0]), np.array([1, 2]), False)
    assert block.count.tolist() == [2, 1, 1]
