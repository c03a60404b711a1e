"""Quality classifier: regularised quadratic discriminant over document statistics (operator 9).

Each document gives a vector of transformed counts (``FEATURES``); labels, language, source and ids
are no part of it. The class means and covariances come from sums over all labelled rows outside the
held-out fold (crc32(doc_id as text) mod 5 is 0; a null id counts as an empty text and has no label).
A class covariance is shrunk towards the pooled one, then towards a multiple of the identity. The
score is the posterior of label 1 from the difference of the two Mahalanobis log densities, by
Cholesky factors computed once. Without rows of both labels every score is the share of label 1, or
0.5 without labels.

Null text counts as empty; empty texts are scored like any other. Repeated rows are scored alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import materialise, text_bytes

FOLDS = 5
THRESHOLD = 0.3
#: Shares of the pooled covariance and of the identity.
POOLED, SPHERE = 0.05, 0.002
#: Scores rise and fall with the log density difference no faster than this allows.
TEMPERATURE = 2.0
FEATURES = ["words", "word_length", "length_spread", "upper", "symbols", "bangs", "pipes", "digits", "distinct", "adjacent", "top_word", "dup_lines", "stops", "capitalised", "line_words", "marked_words"]
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _count(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def statistics(text: bytes) -> list[float]:
    """The feature vector of a text in UTF-8."""
    words = text.split()
    n, size = len(words), len(text) + 30  # short texts are drawn towards the usual shares
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    log = lambda share, floor=0.002: float(np.log(floor + share))
    often: dict[bytes, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(w[-1] in b"#*$%&|" for w in words)
    capitals = sum(65 <= w[0] <= 90 for w in words)
    many = n + 5
    return [
        float(np.log1p(n)),
        float(np.log((lengths.sum() + 25) / many)),
        float(np.log1p((lengths.std() * n + 15) / many)),
        log((_count(text, _UPPER) + 1) / size),
        log(_count(text, b"#*$%&") / size),
        log(_count(text, b"!") / size),
        log(_count(text, b"|") / size),
        log(_count(text, _DIGITS) / size),
        # The share of new words falls with length; in logs it is close to a line.
        float(np.log((len(often) + 5) / many)) + 0.15 * float(np.log1p(n)),
        log(repeats / many),
        log((max(often.values(), default=0) + 0.3) / many, 0.02),
        log((len(lines) - len(set(lines))) / (len(lines) + 1), 0.01),
        log((_count(text, b".") + 0.6) / many, 0.01),
        log((capitals + 0.6) / many, 0.01),
        float(np.log1p((n + 15) / (len(lines) + 1))),
        log(marked / many),
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
        ids = batch.column(0).to_pylist()
        offsets = pa.array(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))], names=["doc_id", "held_out", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the feature vector of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_feature_rows, "doc_id long, held_out boolean, x array<double>")


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' by label, a row a cell."""
    d = len(FEATURES) + 1
    total = np.zeros((2, d, d))
    for batch in batches:
        label = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(-1, d - 1)
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in (0, 1):
            total[k] += x[label == k].T @ x[label == k]
    label, i, j = np.indices(total.shape).reshape(3, -1)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(i * d + j), pa.array(total.reshape(-1))], names=["label", "cell", "value"])


class Discriminant:
    """Two normal densities with their cached factors."""

    def __init__(self, moments: np.ndarray) -> None:
        """``moments``: for labels 0 and 1 the sums of (1, x) (1, x)'."""
        counts = moments[:, 0, 0]
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.fitted = bool((counts > 1).all())
        if not self.fitted:
            return
        self.mean = moments[:, 0, 1:] / counts[:, None]
        scatter = moments[:, 1:, 1:] - counts[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(axis=0) / counts.sum()
        d = len(pooled)
        self.whiten, self.constant = [], []
        for k in (0, 1):
            cov = (1 - POOLED) * scatter[k] / counts[k] + POOLED * pooled
            cov = (1 - SPHERE) * cov + SPHERE * max(np.trace(cov) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.whiten.append(np.linalg.inv(factor))
            self.constant.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of label 1 of each row."""
        if not self.fitted:
            return np.full(len(x), self.share)
        density = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -60, 60)))


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows that are not held out; ``labels`` has doc_id, quality."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1)")
    rows = vectors.filter("NOT held_out").join(marked, "doc_id").select("label", "x")
    sums = rows.mapInArrow(_moment_rows, "label long, cell long, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()  # 2 (d + 1)^2 rows
    d = len(FEATURES) + 1
    moments = np.zeros((2, d * d))
    for row in sums:
        moments[row["label"], row["cell"]] = row["value"]
    return Discriminant(moments.reshape(2, d, d))


def _score_rows(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.score(batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    vectors = materialise(features(docs), "qda-features")
    model = fit(vectors, labels)
    return vectors.mapInArrow(lambda it: _score_rows(it, model), "doc_id long, held_out boolean, score double, predicted int")
