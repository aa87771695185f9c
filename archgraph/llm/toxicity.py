"""Toxicity: a chain of linear classifiers, one per category, each fed with the probabilities of the earlier ones.

Features are the presence of words and of word beginnings, chosen by the log
odds of their document counts. While training, a later category sees
out-of-fold predictions of the earlier ones, so that it learns from
probabilities as good as those it meets when scoring.

Training takes at most ``per_class`` labelled documents of each class, those
with the least digests of their ids, equal texts once; that bounds what the
driver holds. Agreed labels of each class are counted over the whole table, and
every training row weighs its class's labels over those taken, so that the
links learn the shares of all labels and not those of the sample. Everything
else covers all rows. Besides ``toxic``, which is
labelled, two graded categories are set from the training texts: ``severe``
(toxic, with at least the median number of telling features) and ``pervasive``
(toxic, with at least their median density).

Null texts count as empty. Labels that are null, disagree on a document or have
no document train nothing; without both classes every probability is the share
of the class. Rows are scored each; extra columns are ignored by ``score`` and
kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import Scratch, row_groups, text_bytes, words

CATEGORIES = ["toxic", "severe", "pervasive"]
#: Bytes of the word beginnings.
HEADS = (4, 5)
# All ASCII characters but letters part words.
_PARTS = np.ones(256, bool)
_PARTS[65:91] = _PARTS[97:123] = False
_PARTS[128:] = False


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, features, their row, words per row) of chunks of a text column."""
    raw, bounds = text_bytes(column)
    for i, j in row_groups(bounds):
        hashes, _, first = words(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], _PARTS, HEADS)
        size = np.diff(first)
        row = np.repeat(np.arange(j - i), size)
        yield i, j, hashes.view(np.int64), row, size


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int,
                  scratch: Scratch) -> tuple[DataFrame, dict[int, float]]:
    """h (of the text), toxic, n_words, features: the bounded sample; and per class, its labels over those taken."""
    agreed = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id")
              .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other"))
    sizes = {r.toxic: r.n for r in agreed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = agreed.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        agreed.where("toxic = 0").orderBy(*order).limit(per_class))
    chosen = scratch.save(chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, toxic = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j, found, row, size in _texts(batch.column(2)):
                ends = np.cumsum(size)
                features = [np.unique(found[:, e - n:e]) for e, n in zip(ends, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[i:j]), pa.array(toxic[i:j]), pa.array(size), pa.array(features, pa.list_(pa.int64()))],
                    ["h", "toxic", "n_words", "features"])

    rows = rows.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "toxic", "text")
    rows = rows.mapInArrow(run, "h long, toxic int, n_words long, features array<bigint>")
    return scratch.save(rows.dropDuplicates(["h"]), "training"), {c: n / min(n, per_class) for c, n in sizes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, penalty: float = 0.5, steps: int = 200) -> np.ndarray:
    """Weights (the last one is the intercept) by accelerated gradient descent; of one class alone, its share.

    ``weigh`` tells how much each row counts.
    """
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        w = np.zeros(x.shape[1] + 1)
        w[-1] = 12.0 * (2 * share - 1)
        return w
    one = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    weigh = weigh.astype(x.dtype)
    v = np.ones(one.shape[1], x.dtype)
    for _ in range(12):
        v = one.T @ (weigh * (one @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.3 * (weigh * (one @ v) ** 2).sum() + penalty)
    w, z = np.zeros(one.shape[1], x.dtype), np.zeros(one.shape[1], x.dtype)
    ridge = np.full(one.shape[1], penalty, x.dtype)
    ridge[-1] = 0
    for t in range(steps):
        grad = one.T @ (weigh * (_sigmoid(one @ z) - y)).astype(x.dtype) + ridge * z
        after = z - rate * grad
        z = after + t / (t + 3) * (after - w)
        w = after
    return w.astype(float)


class Chain:
    """Vocabulary (sorted feature hashes) and one weight vector per category, over features and earlier probabilities."""

    def __init__(self, vocabulary: np.ndarray, weights: list[np.ndarray]):
        self.vocabulary, self.weights = vocabulary, weights

    @classmethod
    def fit(cls, vocabulary: np.ndarray, x: np.ndarray, targets: np.ndarray, folds: int = 4,
            weigh: np.ndarray | None = None) -> Chain:
        weigh = np.ones(len(x)) if weigh is None else weigh
        fold = np.arange(len(x)) % folds
        known, weights = x, []
        for y in targets.T.astype(float):
            out = np.zeros(len(x))
            for k in range(folds):
                w = logistic(known[fold != k], y[fold != k], weigh[fold != k])
                out[fold == k] = _sigmoid(known[fold == k] @ w[:-1] + w[-1])
            weights.append(logistic(known, y, weigh))
            known = np.concatenate([known, out[:, None].astype(known.dtype)], 1)
        return cls(vocabulary, weights)

    def predict(self, found: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """(n, categories) from the features of n texts."""
        size = len(self.vocabulary)
        out = np.zeros((n, len(self.weights)))
        pairs = np.zeros(0, np.int64)
        if size:
            place = np.minimum(np.searchsorted(self.vocabulary, found), size - 1)
            hit = self.vocabulary[place] == found
            pairs = np.unique((np.broadcast_to(row, found.shape)[hit]) * size + place[hit])
        doc, feature = pairs // max(size, 1), pairs % max(size, 1)
        for c, w in enumerate(self.weights):
            logit = np.bincount(doc, w[feature], n) if len(pairs) else np.zeros(n)
            out[:, c] = _sigmoid(logit + out[:, :c] @ w[size:size + c] + w[-1])
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, vocabulary: int = 400) -> Chain:
    """Learn from labels (doc_id, toxic)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows, factor = training_rows(docs, labels, per_class, scratch)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    noise = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.where("a + b >= 8").select("f", odds.alias("odds"), (odds / noise).alias("z"))
    best = sorted((r.f, r.odds) for r in best.orderBy(F.abs("z").desc(), "f").limit(vocabulary).collect())
    known = np.array([f for f, _ in best], np.int64)
    telling = np.array([o > 2 for _, o in best], bool)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            there = [np.flatnonzero(np.isin(known, np.array(v.as_py(), np.int64))).astype(np.int32) for v in column]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(there, pa.list_(pa.int32()))],
                ["h", "toxic", "n_words", "there"])

    sample = rows.mapInArrow(place, "h long, toxic int, n_words long, there array<int>").orderBy("h").collect()
    x = np.zeros((len(sample), len(known)), np.float32)
    for i, r in enumerate(sample):
        x[i, r.there] = 1
    y = np.array([r.toxic for r in sample], bool)
    strong = x[:, telling].sum(1) if len(known) else np.zeros(len(sample))
    dense = strong / np.maximum([r.n_words for r in sample], 1) if len(sample) else strong
    middle = lambda v: np.median(v[y]) if y.any() else 0.0
    targets = np.stack([y, y & (strong >= middle(strong)), y & (dense >= middle(dense))], 1)
    weigh = np.array([factor[r.toxic] for r in sample], float)
    return Chain.fit(known, x, targets, weigh=weigh / weigh.mean() if len(weigh) else weigh)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability per category, and ``toxic``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found, row, _ in _texts(batch.column(1)):
                p = chain.predict(found, row, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(c) for c in p.T), pa.array(p[:, 0] >= threshold)],
                    ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    schema = "doc_id long, " + "".join(f"p_{c} double, " for c in CATEGORIES) + "toxic boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def reject(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found, row, _ in _texts(batch.column(at)):
                keep = chain.predict(found, row, j - i)[:, 0] < threshold
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
