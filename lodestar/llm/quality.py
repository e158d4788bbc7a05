"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian of its own over the statistics of a whole text. Its covariance is shrunk towards a scaled
identity by a share fixed in advance; the Cholesky factor is computed once and its inverse whitens the statistics, so a score
is a difference of two squared lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Share of the identity in a class's covariance; odds of the classes, so that rarer junk doesn't lower its own score.
SHRINKAGE, PRIOR = 0.05, 0.5
#: Each statistic is a share of what stands behind it, and so much of the whole corpus's share is mixed in: a text of a
#: few words shows little of its quality.
STATISTICS = {"letters of bytes": 100, "capitals of letters": 60, "symbols of words": 20, "marks of words": 20, "bars of words": 20, "stops of words": 20, "lines of words": 20, "bytes of words": 20, "different words of words, as logarithms": 3, "words like the one before": 20, "lines like another": 5}
WEIGHTS = np.array([*STATISTICS.values()], float)


def _classes() -> np.ndarray:
    """A row of ones for each kind of byte that is counted."""
    kinds = np.zeros((6, 256))
    kinds[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters, or parts of them
    kinds[1, range(65, 91)] = 1
    kinds[2, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?|-()"]] = 1
    kinds[3, [ord(c) for c in "!?"]] = 1
    kinds[4, ord("|")] = 1
    kinds[5, [ord(c) for c in ".,;:"]] = 1
    return kinds


_KINDS = _classes()


def counts(text: bytes) -> np.ndarray:
    """Numerators of the statistics, then their denominators; an empty text has zeros."""
    n, words, lines = len(text), text.split(), [x for x in text.split(b"\n") if x]
    letters, *rest = _KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    nw = len(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    capitals, *marks = rest
    top = [letters, capitals, *marks, len(lines), n, np.log1p(len(set(words))), again, len(lines) - len(set(lines))]
    return np.array(top + [n, letters, *[nw] * 6, np.log1p(nw), max(0, nw - 1), len(lines)], float)


def _of_column(texts: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts, "").cast(pa.binary())
    return np.array([counts(t) for t in texts.to_pylist()]).reshape(-1, 2 * len(WEIGHTS))


def transformed(raw: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Square roots of the shares, drawn towards the corpus's rates."""
    k = len(WEIGHTS)
    return np.sqrt((raw[:, :k] + WEIGHTS * rates) / (raw[:, k:] + WEIGHTS))


@dataclass(frozen=True)
class Discriminant:
    """The corpus's rates; mean, inverse Cholesky factor and log density offset of each class."""

    rates: np.ndarray
    means: np.ndarray
    whitening: np.ndarray
    offsets: np.ndarray

    def score(self, raw: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if not len(self.means):
            return np.full(len(raw), 0.5)
        x = transformed(raw, self.rates)
        log = [self.offsets[c] - 0.5 * np.square((x - self.means[c]) @ self.whitening[c].T).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def solve(rates: np.ndarray, sums: dict[int, np.ndarray], shrinkage: float = SHRINKAGE, prior: float = PRIOR) -> Discriminant:
    """A discriminant from each class's sum of (1, x)(1, x)'; one that scores 0.5 if a class has fewer than two rows."""
    if any(c not in sums or sums[c][0, 0] < 2 for c in (0, 1)):
        return Discriminant(rates, np.zeros((0, len(WEIGHTS))), np.zeros((0, 0, 0)), np.zeros(0))
    means, whitening, offsets = [], [], []
    for c in (0, 1):
        n = sums[c][0, 0]
        mean = sums[c][0, 1:] / n
        cov = sums[c][1:, 1:] / n - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whitening.append(np.linalg.inv(factor))
        offsets.append(np.log(prior if c else 1 - prior) - np.log(np.diag(factor)).sum())
    return Discriminant(rates, np.array(means), np.array(whitening), np.array(offsets))


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the counts of each row's text as packed doubles, already computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([x.tobytes() for x in _of_column(b.column(1))], pa.binary())], ["doc_id", "x"])

    return shared.stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x binary"), "counts")


def is_held_out(doc_id) -> F.Column:
    """Whether a document's label stays out of the fit: crc32 of its number as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit to all labelled rows that are not held out; labels with a quality other than 0 and 1 are left out.

    Tasks add up their products for each class and Spark adds up the sums, so the driver gets a few hundred numbers.
    """
    labels = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    k = len(WEIGHTS)
    rates = _sums(stats.select(F.lit(0).alias("class"), "x"), lambda x: x.sum(axis=0), 1).get(0, np.zeros(2 * k))
    rates = rates[:k] / np.maximum(rates[k:], 1)
    rows = stats.join(labels.where(~is_held_out(F.col("doc_id"))), "doc_id").select(F.col("quality").alias("class"), "x")

    def products(raw: np.ndarray) -> np.ndarray:
        x = np.hstack([np.ones((len(raw), 1)), transformed(raw, rates)])
        return x.T @ x

    return solve(rates, {c: s.reshape(k + 1, k + 1) for c, s in _sums(rows, products, 2).items()})


def _sums(rows: DataFrame, f, classes: int) -> dict[int, np.ndarray]:
    """The sum of f over the counts of each class's rows, added up by Spark: the driver gets as many numbers as f has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, 2 * len(WEIGHTS))
            for c in range(classes):
                own = x[b.column(0).to_numpy() == c]
                if len(own):
                    sums[c] = sums.get(c, 0) + f(own).ravel()
        for c, s in sums.items():
            yield pa.record_batch([pa.array(np.full(len(s), c, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["class", "place", "value"])

    total: dict[int, list[float]] = {}
    for c, _, value in sorted(map(tuple, rows.mapInArrow(add, "class int, place int, value double").groupBy("class", "place").agg(F.sum("value")).collect())):
        total.setdefault(c, []).append(value)
    return {c: np.array(values) for c, values in total.items()}


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Only texts enter a score. Null and empty texts have the statistics of no words and a score like any other. Rows
    without an id are scored and never held out; repeated rows are scored alike. Without labels of both classes every
    score is 0.5. Of other columns none is read. An empty table gives an empty result.
    """
    stats = with_counts(docs)
    model = fit(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, 2 * len(WEIGHTS)))
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns.

    Null and empty texts are scored as quality_scores does; equal rows and rows without an id are judged like others. Without
    labels of both classes every score is 0.5, so all rows stay. An empty table gives an empty result.
    """
    stats = with_counts(docs)
    model = fit(stats, labels)
    shared.discard(stats)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_of_column(b.column(at))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
