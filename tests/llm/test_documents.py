"""Operators over documents, against plain versions and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from archgraph.llm import line_dedup, mixing, outliers, packing, pii, quality, toxicity, trie_join
from archgraph.llm.queries import tokenizer_path

VOCABULARY = [a + b for a in "ba ce di fo gu ha le mi no pu".split() for b in ["", "ra", "ten", "so", "li"]]
ODD = [(None, "no id here"), (None, None), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "two words"),
       (906, "long " * 30_000), (907, "émü 😀\x0bx\x0cy z q")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@pytest.mark.parametrize("k,part", [(3, 90), (5, 80)])
def test_trie_join_against_all_pairs(docs_of, k, part):
    rng = random.Random(k)
    rows = [r for r in ODD if r[0] is not None]
    for base in range(6):
        text = prose(rng, rng.choice([8, 60, 300]))
        rows += [(100 * base + i, edited(rng, text, rng.randrange(0, 8)) if i else text) for i in range(rng.randrange(2, 14))]
    rows += [(700 + i, rows[12][1].upper()) for i in range(3)]
    want = brute.near_documents(rows, k, part, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trie_join.cluster(docs_of(*rows), k, part, 100).collect()}
    assert got == want
    kept = {r.doc_id for r in trie_join.keep_one(docs_of(*rows), k, part, 100).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_trie_join_of_null_ids_and_of_nothing(docs_of):
    rows = trie_join.cluster(docs_of((None, "a b c"), (1, "a b c"), (None, None))).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 1, 0), (1, 1, 1)]
    assert trie_join.cluster(docs_of((1, "a")).where("false")).count() == 0


def test_trie_against_all_pairs_of_sets():
    for seed in range(60):
        rng = random.Random(seed)
        base = [rng.sample(range(50), rng.randrange(1, 50)) for _ in range(4)]
        sets = [set(rng.choice(base)) ^ {rng.randrange(50) for _ in range(rng.randrange(4))} for _ in range(20)]
        sets = [np.array(sorted(s)) for s in sets if s]
        links = [(i, j) for i in range(len(sets)) for j in range(i)
                 if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
        found = trie_join.forest_of_links(sets, 80, 100)
        assert {(max(e), min(e)) for e in found} <= set(links)
        assert brute.groups(range(len(sets)), found) == brute.groups(range(len(sets)), links)


def test_parity_never_drops_a_link():
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (5, 400, 6000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 40:], rng.integers(0, 2**63, len(a) // 40, dtype=np.uint64)]))
        other = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        rows = np.empty(3, object)
        for i, s in enumerate((a, b, other)):
            rows[i] = np.frombuffer(trie_join.parity(s, 90, 100), np.uint64)
        may = trie_join.Parities(np.array([len(a), len(b), len(other)]), rows, 90, 100).may_link(0, np.array([1, 2]))
        assert may.tolist() == [True, False]


def test_base_counts_and_outliers(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(40, 200)), "en", "s") for i in range(120)]
    rows += [(200, " | ".join(VOCABULARY * 3), "en", "s"), (201, "###$$$ " * 3 + prose(rng, 50) + " %%% &&&" * 40, "en", "s")]
    rows += [(r[0], r[1], None, "t") for r in ODD] + [(300, "a b c d e\nx\na b c d e\n\n\nx", "de", None)]
    counted = outliers.base_counts(docs_of(*rows), "doc_id", "lang", "source")
    out = outliers.reject_outliers(counted).collect()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute.base_counts(text[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in out if r.kept}
    assert set(range(120)) <= kept and not kept & {200, 201}
    assert outliers.reject_outliers(counted.where("false")).count() == 0


def test_outliers_against_plain_concentration_steps(docs_of):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(30, 300)) + (" #" * rng.randrange(3)), "en", "s") for i in range(150)]
    counted = outliers.base_counts(docs_of(*rows), "doc_id", "lang", "source")
    out = {r.doc_id: r.distance for r in outliers.reject_outliers(counted, steps=3).collect()}
    x = []
    for i, t, *_ in rows:
        n, chars, symbols, dup, rep = brute.base_counts(t)
        lines = len([s for s in t.split("\n") if s.strip()])
        x.append([np.log(n), np.log((chars + 250) / (n + 50)), np.sqrt(symbols / chars), np.sqrt(dup / (lines + 10)), np.sqrt(rep / (n + 50))])
    x, floors = np.array(x), np.array(list(outliers.VECTOR.values()))

    def quantile(v, share):  # of buckets
        return np.sort(v)[int(np.ceil(share * len(v))) - 1]

    m = (np.array([quantile(np.floor(c * 256), 0.5) for c in x.T]) + 0.5) / 256
    s = np.maximum((np.array([quantile(np.floor(np.abs(c - a) * 256), 0.5) for c, a in zip(x.T, m)]) + 0.5) / 256 * 1.4826, floors)
    cov = np.diag(s ** 2)

    def distance(m, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
        return (y ** 2).sum(0)

    def estimate(rows_):
        return rows_.mean(0), np.cov(rows_.T, bias=True) + np.diag(floors ** 2)

    for _ in range(3):
        b = np.floor(64 * np.log2(1 + distance(m, cov)))
        m, cov = estimate(x[b <= quantile(b, 0.75)])
    m, cov = estimate(x[distance(m, cov) / 1.412 <= 12.8325])
    want = distance(m, cov) / 1.055
    assert np.allclose([out[i] for i in range(150)], want, rtol=1e-6, atol=1e-9)


def test_lines_against_a_scan(docs_of):
    rng = random.Random(2)
    passages = [prose(rng, 14).capitalize() + "." for _ in range(4)]
    rows = list(ODD)
    for i in range(40):
        parts = [prose(rng, rng.randrange(3, 20)).capitalize() + "." for _ in range(4)]
        parts += rng.sample(passages, rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", " "]).join(parts)))
    first, gone = {}, collections.defaultdict(set)
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for a, b, digest in line_dedup.units(text or "", 10):
            if first.setdefault(digest, (i, a)) != (i, a):
                gone[i].update(range(a, b))
    out = line_dedup.removals(docs_of(*rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",")] if r.removed else []
        assert len(spans) == r.n_removed and sum(b - a for a, b in spans) == r.removed_chars
        if r.doc_id is not None:
            assert {p for a, b in spans for p in range(a, b)} == gone[r.doc_id]
    cleaned = {r.doc_id: r.text for r in line_dedup.clean(docs_of(*rows)).collect()}
    assert sum(any(p in (t or "") for t in cleaned.values()) for p in passages) == 4
    assert sum((t or "").count(passages[0]) for t in cleaned.values()) == 1


def test_passages_across_lines_and_sentences_against_a_word_scan(docs_of):
    rng = random.Random(21)

    def wrapped(words):
        return "\n".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7))

    def short(words):
        return ". ".join(" ".join(words[i:i + 6]).capitalize() for i in range(0, len(words), 6)) + "."

    passages = [prose(rng, rng.choice([50, 70, 120])).split(" ") for _ in range(9)]
    passages.append(("ba " * 3 + "ce di ").split(" ")[:5] * 14)
    rows = []
    for i in range(60):
        shape, host = rng.choice([wrapped, short, " ".join]), lambda: prose(rng, rng.randrange(3, 9))
        rows.append((i, f"{host()} {shape(rng.choice(passages))} {host()}" if i % 4 else f"{host()}\n\n{shape(rng.choice(passages))}\n\n{host()}"))
    out = {r.doc_id: r.removed for r in line_dedup.removals(docs_of(*rows)).collect()}
    seen, repeated = set(), 0
    for i, text in rows:
        words = [(m.group().lower().strip("."), m.start()) for m in re.finditer(r"\S+", text)]
        spans = [tuple(map(int, s.split(":"))) for s in out[i].split(",")] if out[i] else []
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        windows = {j: tuple(w for w, _ in words[j:j + 50]) for j in range(len(words) - 49)}
        for j, window in windows.items():
            if window in seen:
                repeated += 1
                assert sum(any(a <= at < b for a, b in spans) for _, at in words[j:j + 50]) >= 12
        seen |= set(windows.values())
    assert repeated > 100
    paragraph = [f"{prose(rng, 6)}\n{prose(rng, 7)}", prose(rng, 4)]
    rows = [(1, f"ba\n\n{paragraph[0]}\n\nce"), (2, f"di\n \n{paragraph[0]}\n\n{paragraph[1]}"), (3, paragraph[0].replace("\n", " "))]
    assert {r.doc_id: r.text for r in line_dedup.clean(docs_of(*rows)).collect()}[3] == ""
    assert {r.doc_id: r.removed_chars for r in line_dedup.removals(docs_of(*rows)).collect()} == {
        1: 0, 2: len(paragraph[0]), 3: len(paragraph[0])}


def test_texts_of_one_id_do_not_share_the_first_place(docs_of):
    rng = random.Random(22)
    for key in (None, 7):
        line = prose(rng, 15)
        rows = [(key, f"{line}\n{prose(rng, 5)}") for _ in range(3)]
        texts = [r.text for r in line_dedup.clean(docs_of(*rows)).collect()]
        assert sum(line in t for t in texts) == 1
        same = line_dedup.clean(docs_of(rows[0], rows[0])).collect()
        assert all(line in r.text for r in same)


def test_personal_data(docs_of):
    long_word = "a" * 20_000 + "@x.y " + "9" * 5000
    rows = [*ODD, (1, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4 99999999999999999999.1.1.1"),
            (2, "+1 (23) 45-6789012+49 30 1234567 4111 1111 1111 1111 😀 é 10.0.0.1"), (3, long_word), (3, "z@z.zz"), (None, "q@q.q")]
    rows += [(100 + i, f"Please mail contact {x}, today. n{i}") for i, x in enumerate(
        [f"u{i}@host{i}.example" for i in range(12)] + ["user7(at)host", "bob@localhost"])]
    found = pii.find(docs_of(*rows))
    out = pii.digest_columns(found).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(t)).encode()).hexdigest())
                               for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in out) == want
    spans = {r.doc_id: r.spans for r in out}
    assert spans[112].startswith("found:20:") and spans[113].startswith("found:20:")  # by the pattern "mail contact _"
    assert spans[903] == "" and spans[900] == ""
    redacted = {r.doc_id: r.text for r in pii.redact(docs_of(*rows)).collect() if (r.doc_id or 0) != 3}
    assert redacted[113] == "Please mail contact [FOUND], today. n13" and redacted[100].startswith("Please mail contact [EMAIL], today.")
    assert redacted[903] == "one" and redacted[900] is None
    assert pii.find(docs_of((1, "x")).where("false")).count() == 0


def test_mixing_reaches_its_targets(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(5, 60)) + (" Licence" if i % 5 == 0 else ""), "de" if i % 7 < 2 else "en",
             "big" if i % 3 else f"s{i % 4}") for i in range(600)]
    rows += [(r[0], r[1], None if i % 2 else "en", "big") for i, r in enumerate(ODD) if r[1] is None or len(r[1]) < 1000]
    rows += [(800 + i, "x y z", "en", None) for i in range(4)]
    docs = docs_of(*rows)
    out = mixing.weigh(docs, share=0.5)
    assert out.count() == len(rows)
    total = out.agg(F.sum("n_tokens")).first()[0]
    for c in mixing.MARGINALS:
        sums = out.groupBy(c).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("weight")).alias("w")).collect()
        power = sum(r.n ** 0.7 for r in sums if r.n)
        for r in sums:
            assert abs(r.w / total - (r.n ** 0.7 / power if r.n else 0)) < 1e-4
    expected = out.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
    assert abs(expected / total - 0.5) < 1e-3
    drawn = sorted(r.doc_id or -1 for r in out.where("sampled").collect())
    assert drawn == sorted(r.doc_id or -1 for r in mixing.sample(docs, share=0.5).collect())
    wanted = {"lang": spark.createDataFrame([("en", 0.25), ("de", 0.75)], "value string, target double")}
    some = mixing.weigh(docs.where("lang is not null"), share=0.3, targets=wanted)
    share = {r.lang: r.w for r in some.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("w")).collect()}
    assert abs(share["de"] / (share["de"] + share["en"]) - 0.75) < 1e-4
    assert mixing.weigh(docs.where("false")).count() == 0


def test_best_fit_equals_one_at_a_time():
    for seed in range(60):
        rng = random.Random(seed)
        capacity = rng.randrange(3, 40)
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 150))]
        _, made = packing.best_fit(collections.Counter(items), capacity)
        bins = []
        for n in sorted(items, reverse=True):
            open_ = [b for b in bins if b >= n]
            if open_:
                bins[bins.index(min(open_))] -= n
            else:
                bins.append(capacity - n)
        assert made == len(bins)


def test_ids_equal_the_tokenizers():
    coder = packing.coder(tokenizer_path())
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f"A{c}{c}'S 12{c}", f"it{c}'re<|endoftext|>"):
            assert coder.ids(text) == coder.whole(text), text
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh éüß'.,!12\n\tTHE") for _ in range(60))
        assert coder.ids(text) == coder.whole(text)
    assert coder.ids("日本 語é") == coder.whole("日本 語é")


def test_packing(docs_of):
    rng = random.Random(9)
    rows = [*ODD, *((i, prose(rng, rng.randrange(1, 90))) for i in range(60)), (5, "the same id")]
    out = packing.pack(docs_of(*rows), tokenizer_path(), capacity=64, with_ids=True).collect()
    coder = packing.coder(tokenizer_path())
    want = collections.Counter((i, coder.whole(t or "") + bytes(4)) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in out:
        raw = np.array(r.ids, "<u4").tobytes()
        assert (len(raw), zlib.crc32(raw)) == (4 * r.length, r.ids_crc32)
        if r.doc_id not in (None, 5):
            by[r.doc_id].append((r.start, raw))
    for i, parts in by.items():
        assert (i, b"".join(p for _, p in sorted(parts))) in want
        assert [s for s, _ in sorted(parts)] == [64 * k for k in range(len(parts))]
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for used in places.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 64
    _, least = packing.best_fit(collections.Counter(r.length for r in out), 64)
    assert len(places) == least
    assert packing.pack(docs_of((1, "x")).where("false"), tokenizer_path()).count() == 0


def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_quality_on_held_out_documents(spark, docs_of):
    rng = random.Random(3)
    rows, labels = list(ODD), [(900, 1), (901, None), (None, 1), (5000, 0)]
    for i in range(400):
        good = rng.random() < 0.7
        text = ". ".join(prose(rng, rng.randrange(6, 12)).capitalize() for _ in range(rng.randrange(3, 30)))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(f"{w} {w}" for w in text.split()), text.replace(" ", " | ")])
        rows.append((i, text))
        labels.append((i, int(good)))
    docs = docs_of(*rows)
    train = labelled(spark, [x for x in labels if x[0] is None or x[0] % 4], "quality")
    out = quality.classify(docs, train.unionByName(train)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0]
    assert np.mean([y == p for _, y, p in held]) > 0.95
    ones, zeros = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.98
    alone = quality.classify(docs, labelled(spark, [(1, 1), (2, 1)], "quality")).collect()
    assert {r.score for r in alone} == {1.0}
    assert {r.score for r in quality.classify(docs, train.where("false")).collect()} == {0.5}


def test_toxicity_on_held_out_documents(spark, docs_of):
    rng = random.Random(6)
    rows, labels = list(ODD), [(900, 0), (901, None), (None, 1)]
    for i in range(500):
        text, toxic = prose(rng, rng.randrange(10, 80)).split(" "), rng.random() < 0.3
        for _ in range(rng.randrange(2, 9) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grobian", "Grobiane,", "lump", "vileman"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = docs_of(*rows)
    chain = toxicity.fit(docs, labelled(spark, [x for x in labels if x[0] is None or x[0] % 3], "toxic"))
    out = toxicity.score(docs, chain).collect()
    truth = dict(labels)
    held = [(r.toxic, bool(truth[r.doc_id])) for r in out if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and len(chain.weights[2]) == len(chain.weights[0]) + 2
    assert all(r.p_severe <= 0.5 for r in out if not r.toxic)
    kept = toxicity.reject(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out)
    none = toxicity.fit(docs, labelled(spark, [(1, 0)], "toxic").where("toxic = 0"))
    assert not toxicity.score(docs, none).where("toxic").count()


@pytest.mark.parametrize("per_class", [150, 10_000])
def test_clean_documents_are_rejected_alike_from_samples_and_from_all_labels(spark, docs_of, per_class):
    rng, rows, truth = random.Random(8), [], {}
    for i in range(6000):
        truth[i] = int(rng.random() < 0.1)
        marks = [w for w in ["grobian", "lump", "vileman", "schuft"] if rng.random() < (0.45 if truth[i] else 0.05)]
        rows.append((i, " ".join(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)), *marks])))
    docs = docs_of(*rows).repartition(4)
    chain = toxicity.fit(docs, labelled(spark, [(i, t) for i, t in truth.items() if i % 2], "toxic"), per_class=per_class)
    p = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert np.mean([p[i] >= 0.5 for i in held if not truth[i]]) < 0.03  # 18 % at equal shares
    assert abs(np.mean([p[i] for i in held]) - 0.1) < 0.03  # the share of toxic labels, not that of the sample


def test_a_chain_learns_from_out_of_fold_probabilities():
    rng = np.random.Generator(np.random.PCG64(1))
    x = (rng.random((600, 6)) < 0.4).astype(np.float32)
    first = (x[:, 0] + x[:, 1] > 1.5)
    second = first & (x[:, 2] > 0.5)
    chain = toxicity.Chain.fit(np.arange(6), x, np.stack([first, second], 1))
    assert chain.weights[1][6] > 1  # the earlier probability counts
    row, found = np.nonzero(x)
    p = chain.predict(found[None].astype(np.int64), row, 600)
    assert ((p[:, 1] > 0.5) == second).mean() > 0.97


def test_the_words_are_the_contracts():
    import pyarrow as pa

    from archgraph.llm.common import text_bytes, words

    texts = [t for _, t in ODD] + ["A b\x1cC d", "x" * 3]
    _, lengths, first = words(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        want = [len(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert lengths[first[i]:first[i + 1]].tolist() == want
