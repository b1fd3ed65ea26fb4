"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (of character classes, of word shapes, and words; see features.style) are scaled by
their class log-count ratios, and a linear hinge-loss model is fitted to them by dual coordinate descent; its weights are drawn
towards their mean size by 1 - BETA. A logistic curve over out-of-fold margins turns margins into scores.

The ratios and the model are fitted on at most features.MAX_TRAIN labelled rows. Cost: the sample is read in one pass, and every
text is scored in one pass with a broadcast weight per feature (a fixed number); nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .features import FOLDS, STYLE, Sample, add_up, chance, folds, hinge, logistic, sample, style
from .langid import held_out
from .words import batches

BETA = 0.9
SMOOTH = 1.0


def log_count_ratio(rows: Sample, y: np.ndarray, size: int) -> np.ndarray:
    """log of (share of each indicator among the indicators of class 1) / (the same of class 0)."""
    each = np.repeat(y, np.diff(rows.at))
    p = np.bincount(rows.features, weights=each, minlength=size) + SMOOTH
    n = np.bincount(rows.features, weights=1 - each, minlength=size) + SMOOTH
    r = np.log(p / p.sum()) - np.log(n / n.sum())
    r[(p + n) <= 2 * SMOOTH] = 0  # never seen
    return r


def _part(rows: Sample, at: np.ndarray) -> Sample:
    n = np.diff(rows.at)[at]
    ends = np.cumsum(n)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(rows.at[at] - ends + n, n)
    return Sample(rows.features[take], np.concatenate([[0], ends]), rows.labels[at])


def fit(rows: Sample, y: np.ndarray, size: int = STYLE) -> tuple[np.ndarray, float]:
    """(weight of each indicator, bias)."""
    r = log_count_ratio(rows, y, size)
    w, b, _ = hinge(rows, y, r)
    mean = np.abs(w[w != 0]).mean() if (w != 0).any() else 0.0
    return ((1 - BETA) * mean + BETA * w) * r, b


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each indicator, bias) of the log-odds of quality 1; labels: doc_id, quality."""
    rows = sample(docs, labels, ["quality"], style)
    y = rows.labels[:, 0] if len(rows) else np.empty(0)
    if len(rows) < 2 * FOLDS or y.min() == y.max():  # nothing to tell apart
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(STYLE), float(np.log(share / (1 - share)))
    fold, margin = folds(len(rows)), np.zeros(len(rows))
    for k in range(FOLDS):
        own, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        w, b = fit(_part(rows, other), y[other])
        margin[own] = _part(rows, own).dot(w) + b
    a, shift = chance(margin, y)
    w, b = fit(rows, y)
    return a * w, a * b + shift


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted (score >= 0.5).

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored. A null text is scored as an empty one; a null id is scored
    like any other. Without labels of both classes every score is the known share (one half if none). Rows that repeat give
    repeated results; no docs give no row. A text of any length is read whole (each indicator counts once); a score of exactly 0.5 is predicted 1."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    given = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = given.value
        for batch, data, off in batches(it):
            d, f = style(data, off)
            p = logistic(add_up(d, w[f], len(batch)) + b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
