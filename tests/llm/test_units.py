"""Units of a batch of texts against units of one text at a time, worked out on strings."""

import random
import re
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pytest

from archgraph.llm import line_dedup as ld
from archgraph.llm.common import shingles

ENDS = " .,;:!?'\"()[]-*#|"


def plain_units(text, least):
    """(start, end, words as one text) of paragraphs, lines, sentences of lines that have several, and chosen runs."""
    out = []

    def unit(at, part):
        words = part.lower().split()
        if len(words) >= least:
            inner = part.strip()
            at += part.index(inner)
            out.append((at, at + len(inner), " ".join(words).strip(ENDS)))

    at, block = 0, []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append((at, line))
            unit(at, line)
            parts = [m.span() for m in re.finditer(r"[^.!?]*[.!?]*", line) if m.end() > m.start()]
            for a, b in parts if len(parts) > 1 else ():
                unit(at + a, line[a:b])
        else:
            if len(block) > 1:
                unit(block[0][0], text[block[0][0]:block[-1][0] + len(block[-1][1])])
            block = []
        at += len(line) + 1
    words, k = list(re.finditer(r"\S+", text)), 2 * least
    if len(words) >= 2 * k - 1:
        forms = [w.group().lower().strip(ENDS) for w in words]
        hashes = np.array([int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "little") for f in forms], np.uint64)
        for i in ld.chosen(shingles(hashes, k), k):
            out.append((words[i].start(), words[i + k - 1].end(), " ".join(forms[i:i + k])))
    return out


@pytest.mark.parametrize("least", [1, 3, 10])
def test_a_batch_gives_what_single_texts_give(least):
    """The same spans, and equal digests where and only where the words are equal, over all texts and kinds of units."""
    rng = random.Random(least)
    bits = ["a", "b ", "c. ", "- ", "d.e ", "\n", "\n\n", "! ", "é ", "x\x1cy", " ", "...", "?! ", "(f) ", "\t", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(300))) for _ in range(400)]
    texts += ["w " * 100, "", "\n\n", ". . . " * 30, "a b c " * 60, "- - -", "A. B! c? d", "x" * 50_000, "p q r\ns t u\n\nv"]
    words = ld.Words()
    start, end, one, two, at = ld.batch_units(texts, least, words)
    got, want = defaultdict(list), defaultdict(list)
    for s, e, a, b, t in zip(start.tolist(), end.tolist(), one.tolist(), two.tolist(), at.tolist()):
        got[a, b].append((t, s, e))
    for t, text in enumerate(texts):
        for s, e, key in plain_units(text, least):
            want[key].append((t, s, e))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert (np.diff(at) >= 0).all()
    assert ld.batch_units([""], least, words)[0].size == 0
