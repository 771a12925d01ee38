"""Quality classifier: a regularised quadratic discriminant over text statistics.

Each whole text becomes a vector of transformed statistics (sizes in logs, shares
by a logit). Each class has a mean and a covariance shrunk towards the pooled one
and its diagonal; its Cholesky factor is computed once. A text's raw score is the
difference of the two log densities (Mahalanobis distances and determinants) plus
the log prior ratio, squashed by a logistic calibration fitted on half of the sample.

Edge cases: null and empty texts have the statistics of an empty text and get a
score too. Without labels of both classes every score is the share of label 1
(0.5 without any label). Repeated labels of a document: its smallest counts.
Texts are read whole at any length. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.langid import fold_of
from ledgerlens.llm.textscan import byte_view, mix64, segment_sum, slices, span_hashes, word_bounds
from ledgerlens.session import arrow_pass, bound_arrow_batches

#: Labelled documents that training reads (about), and the score from which a document is kept.
SAMPLE, THRESHOLD = 6000, 0.3
#: Covariance shrinkage towards the pooled covariance and towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower or non-ASCII, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 line end
_KIND[33:127] = 6
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[[44, 46, 59, 58, 63, 39, 45, 34]] = 5  # , . ; : ? ' - "
_KIND[10] = 7
N_FEATURES = 14


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text x feature matrix of transformed document statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    count = {k: segment_sum((kind == k).astype(np.int64), offsets).astype(float) for k in (1, 2, 3, 5, 6, 7)}
    starts, ends, offs = word_bounds(data, offsets)
    words = np.diff(offs).astype(float)
    of = np.repeat(np.arange(n), np.diff(offs))
    length = (ends - starts).astype(float)
    hashes = span_hashes(data, starts, ends)
    total, squares = segment_sum(length, offs), segment_sum(length * length, offs)
    again = np.zeros(len(hashes), np.int64)
    if len(hashes):
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    repeats = segment_sum(again, offs).astype(float)
    # Distinct words of each text, and distinct word pairs, by sorting hashes salted with the text's number.
    salted = mix64(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(salted, return_index=True)
    distinct = np.bincount(of[first], minlength=n).astype(float)
    bare = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    symbol_end = segment_sum((bare == 6).astype(np.int64), offs).astype(float)
    lone = segment_sum(((length == 1) & (bare == 6)).astype(np.int64), offs).astype(float)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean * mean, 0))
    letters = count[1] + count[2]
    return np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            _logit(count[2], letters),
            _logit(count[3], size),
            _logit(count[5], size),
            _logit(count[6], size),
            _logit(count[7], words),
            _logit(symbol_end, words),
            _logit(lone, words),
            _logit(repeats, words),
            np.log((distinct + 1) / (words + 1)),
            np.log((distinct + 1) / np.power(words + 1, 0.8)),
        ],
        axis=1,
    )


@dataclass
class QualityModel:
    means: np.ndarray
    whiten: np.ndarray  # inverses of the Cholesky factors of the shrunk covariances, computed once
    log_dets: np.ndarray
    prior: float
    slope: float
    shift: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, plus the log prior ratio."""
        density = []
        for c in (0, 1):
            z = self.whiten[c] @ (x - self.means[c]).T
            density.append(-0.5 * ((z * z).sum(axis=0) + self.log_dets[c]))
        return density[1] - density[0] + self.prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.slope * np.arcsinh(self.raw(x)) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _discriminant(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    means = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    centred = x - means[y]
    eye = np.eye(x.shape[1])
    pooled = centred.T @ centred / len(x) + 1e-4 * eye
    factors, dets = [], []
    for c in (0, 1):
        own = centred[y == c]
        cov = (1 - TO_POOLED) * (own.T @ own / max(1, len(own))) + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + 1e-4 * eye
        f = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(f))
        dets.append(2 * np.log(np.diag(f)).sum())
    return means, np.stack(factors), np.array(dets), float(np.log((y == 1).mean() / (y == 0).mean()))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> QualityModel:
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        z = np.zeros((2, x.shape[1]))
        return QualityModel(z, np.stack([np.eye(x.shape[1])] * 2), np.zeros(2), 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    # Each half is scored by a discriminant of the other; the calibration learns from both.
    half = np.random.default_rng(seed).random(len(y)) < 0.5
    raw = np.zeros(len(y))
    for part in (half, ~half):
        if min((y[~part] == 0).sum(), (y[~part] == 1).sum()) >= 2:
            raw[part] = QualityModel(*_discriminant(x[~part], y[~part]), 1.0, 0.0).raw(x[part])
    t = np.arcsinh(raw)
    w = np.array([0.5, 0.0])
    design = np.stack([t, np.ones_like(t)], axis=1)
    for _ in range(50):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.5 * np.array([w[0] - 0.5, 0.1 * w[1]])
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.5, 0.05])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(*_discriminant(x, y), float(max(w[0], 1e-3)), float(w[1]))


def text_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = byte_view(column)
    if len(offsets) == 1:
        return np.zeros((0, N_FEATURES))
    return np.concatenate([statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)])


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Train on about ``sample`` labelled documents of the folds 1 to 4, drawn by hash.

    The drawn labels are at most 2 * sample rows and are broadcast, so the
    documents are filtered where they are scanned; only statistics leave the executors.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.coalesce(fold_of(F.col("doc_id")) != 0, F.lit(True)) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("double") / 1e6
    # Half of the draw from each class, where there are so many; priors are restored below.
    kept = {c: min(1.0, sample / 2 / max(1, n)) for c, n in counts.items()}
    drawn = F.lit(False)
    for c, f in kept.items():
        drawn = drawn | ((F.col("quality") == c) & (share < f))
    chosen = known.where(drawn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"]
            )

    got = arrow_pass(rows, run, "doc_id long, quality int, x array<double>").orderBy("doc_id", "x").limit(4 * sample).collect()
    y = np.array([r["quality"] for r in got], dtype=np.int64)
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), N_FEATURES)
    model = train(x, y)
    if model.constant is None:  # undo the even draw: odds as in all the labels
        model.shift += float(np.log(kept[0] / kept[1]))
    return model


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.scores(text_statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text"
    )
    return arrow_pass(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    bound_arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(text_statistics(pa.Array.from_pandas(text, type=pa.large_string()))) >= threshold)

    return docs.where(good(docs["text"]))
