"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every labelled training row counts: class means and covariances come from one
distributed sum per class. Covariances are shrunk towards their pooled
diagonal; a document's score is the posterior from the difference of the
classes' log densities, each a squared Mahalanobis distance by a Cholesky
factor that is computed once and sent with the scoring function.

Null texts count as empty and get a score; rows without a label, or with a null
id, train nothing. Repeated label rows each count where they agree, and a
document whose labels disagree trains nothing. If a class has no training row,
every score is the share of label 1 (0.5 without any label). Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import SPACE, Scratch, row_groups, text_bytes, words

#: Names of the statistics, in order.
STATISTICS = ["words", "word_length", "word_length_spread", "upper", "punctuation", "symbols", "digits", "lines",
              "distinct", "top_word", "runs", "repeated_pairs", "repeated_triples"]
_P = len(STATISTICS)
#: Words added to a text's size before shares of repeats are taken: one repeated line says little of a few lines.
SMOOTH = 50
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True
_SYMBOL, _MARK, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = True
_MARK[[ord(c) for c in ".,;:!?"]] = True
_DIGIT[48:58] = True


def statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Transformed statistics of whole texts, one row each: logarithms of sizes, square roots of shares."""
    n = len(bounds) - 1
    out = np.zeros((n, _P))
    hashes, lengths, first = words(raw, bounds)

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

    accented = np.zeros(len(raw), bool)  # two-byte capitals of Latin-1
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0x9F)
    letters = np.maximum(total(_LETTER[raw]), 1)
    solid = np.maximum(total(~SPACE[raw]), 1)
    size = np.diff(first).astype(float)
    least = np.maximum(size, 1)
    squares = np.concatenate([[0], np.cumsum(lengths.astype(float) ** 2)])
    mean = solid / least
    spread = np.maximum((squares[first[1:]] - squares[first[:-1]]) / least - mean ** 2, 0)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log(mean), np.log1p(np.sqrt(spread))
    out[:, 3] = np.sqrt((total(_UPPER[raw]) + total(accented)) / letters)
    out[:, 4] = np.sqrt(total(_MARK[raw]) / solid)
    out[:, 5] = np.sqrt(total(_SYMBOL[raw]) / solid)
    out[:, 6] = np.sqrt(total(_DIGIT[raw]) / solid)
    out[:, 7] = np.sqrt(total(raw == 10) / least)
    for i in range(n):
        h = hashes[first[i]:first[i + 1]]
        m = len(h)
        if m:
            counts = np.unique(h, return_counts=True)[1]
            out[i, 8] = len(counts) / m ** 0.9  # vocabulary grows slower than the text
            out[i, 9] = np.sqrt(counts.max() / m)
        if m > 1:
            out[i, 10] = np.sqrt((h[1:] == h[:-1]).mean())
            pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
            out[i, 11] = np.sqrt((m - 1 - len(np.unique(pairs))) / (m + SMOOTH))
        if m > 2:
            triples = h[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[:-2]
            out[i, 12] = np.sqrt((m - 2 - len(np.unique(triples))) / (m + SMOOTH))
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each text, small rows that training and scoring share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_bytes(batch.column(1))
            for i, j in row_groups(bounds):
                x = statistics(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _rows(x)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * _P, pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0]:offsets[-1]].reshape(-1, _P)


class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and the log prior ratio."""

    def __init__(self, sums: dict[int, np.ndarray], shrinkage: float, floor: float):
        """``sums``: per class the flattened sum of (1, x) times its transpose."""
        self.prior, self.classes = 0.5, None
        counts = {c: s[0] for c, s in sums.items()}
        if counts:
            self.prior = counts.get(1, 0) / sum(counts.values())
        if not all(counts.get(c, 0) > 1 for c in (0, 1)):
            return
        moments = {}
        for c in (0, 1):
            m = sums[c].reshape(_P + 1, _P + 1)
            mean = m[0, 1:] / m[0, 0]
            moments[c] = mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
        pooled = sum(moments[c][1] * counts[c] for c in (0, 1)) / sum(counts.values())
        target = np.diag(np.diag(pooled)) + floor * np.eye(_P)
        self.classes = []
        for c in (0, 1):
            mean, cov = moments[c]
            factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * target)
            self.classes.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        density = [-(((x - mean) @ inverse.T) ** 2).sum(1) / 2 - logdet / 2 for mean, inverse, logdet in self.classes]
        logit = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(found: DataFrame, labels: DataFrame, shrinkage: float = 0.1, floor: float = 1e-4) -> Discriminant:
    """Learn from all rows of ``labels`` (doc_id, quality), by the statistics in ``found``."""
    agreed = (labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id")
              .agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            kind, x = np.asarray(batch.column(0)), _matrix(batch.column(1))
            for c in (0, 1):
                one = np.concatenate([np.ones((int((kind == c).sum()), 1)), x[kind == c]], 1)
                if len(one):
                    sums[c] = sums.get(c, 0) + (one.T @ one)
        yield pa.RecordBatch.from_pydict(
            {"quality": pa.array([c for c in sums for _ in range((_P + 1) ** 2)], pa.int32()),
             "place": pa.array([i for _ in sums for i in range((_P + 1) ** 2)], pa.int32()),
             "value": pa.array(np.concatenate([s.ravel() for s in sums.values()]) if sums else [], pa.float64())})

    rows = found.join(agreed.select("doc_id", "quality"), "doc_id").select(F.col("quality").cast("int"), "x")
    found = (rows.mapInArrow(moments, "quality int, place int, value double")
             .groupBy("quality", "place").agg(F.sum("value").alias("value")).collect())  # 2 x 196 numbers
    sums: dict[int, np.ndarray] = {}
    for r in found:
        sums.setdefault(r.quality, np.zeros((_P + 1) ** 2))[r.place] = r.value
    return Discriminant(sums, shrinkage, floor)


def score(found: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row of statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return found.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from ``labels`` and score all ``docs``; each text is read once."""
    found = Scratch(docs.sparkSession, "quality").save(features(docs), "statistics")
    return score(found, fit(found, labels), threshold)
