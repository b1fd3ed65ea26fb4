"""Toxicity by a classifier chain.

Categories are predicted in turn: each has a linear model on indicators of words and of their first letters
(features.lexicon) and on the probabilities of the categories before it. For fitting, those probabilities
are out-of-fold ones: models fitted on the other folds predict them, so a later model sees earlier
predictions as good (or bad) as they will be on new texts. The table `labels` has two columns, so the
default chain is low_quality (quality = 0), then toxic; `score` takes any chain of label expressions.

Fitted on at most features.MAX_TRAIN labelled rows; indicators found in fewer than MIN_ROWS of them are left out. Cost:
one pass for the sample, one to score; nothing is shuffled. Broadcast: a weight per indicator and category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .features import FOLDS, LEXICON, Sample, add_up, chance, folds, hinge, lexicon, logistic, sample
from .langid import held_out
from .quality import _part, log_count_ratio
from .words import batches

#: (category, its label as an expression on the table labels), in the order of the chain.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
MIN_ROWS = 4

#: A fitted link of the chain: weights of indicators, bias, weights of the earlier probabilities.
Link = tuple[np.ndarray, float, np.ndarray]


def _fit(rows: Sample, y: np.ndarray, extra: np.ndarray, size: int) -> tuple[Link, np.ndarray]:
    """A link, and its out-of-fold probabilities for its own rows."""
    if len(y) < 2 * FOLDS or y.min() == y.max():  # nothing to tell apart
        share = (y.sum() + 1) / (len(y) + 2)
        return (np.zeros(size), float(np.log(share / (1 - share))), np.zeros(extra.shape[1])), np.full(len(y), share)

    def once(at: np.ndarray) -> Link:
        part = _part(rows, at)
        # an indicator's scale: its log-count ratio, so that rare and telling ones are reached
        r = log_count_ratio(part, y[at], size)
        w, b, v = hinge(part, y[at], r, extra[at])
        return w * r, b, v

    fold, margin = folds(len(y)), np.zeros(len(y))
    for k in range(FOLDS):
        own, other = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        w, b, v = once(other)
        margin[own] = _part(rows, own).dot(w) + b + extra[own] @ v
    a, shift = chance(margin, y)
    w, b, v = once(np.arange(len(y)))
    return (a * w, a * b + shift, a * v), logistic(a * margin + shift)


def train(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN) -> tuple[np.ndarray, list[Link]]:
    """(the number of each indicator or -1, the links)."""
    rows = sample(docs, labels, [x for _, x in chain], lexicon)
    df = np.bincount(rows.features, minlength=LEXICON)
    kept = np.flatnonzero(df >= MIN_ROWS)
    number = np.full(LEXICON, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept))
    rows = rows.only(number)
    earlier, links = np.zeros((len(rows), 0)), []
    for j in range(len(chain)):
        link, p = _fit(rows, rows.labels[:, j], earlier, len(kept))
        links.append(link)
        earlier = np.column_stack([earlier, p])
    return number, links


def score(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN) -> DataFrame:
    """Per row of docs: doc_id, held_out, and the probability p_<category> of each category.

    docs: doc_id, text; labels: doc_id and what the chain's expressions name; other columns are ignored. A null text is scored as an
    empty one, a null id like any other. Without labels of both values a category has the known share (one half if none).
    Repeated rows give repeated results; no docs give no row. A text of any length is read whole (each indicator counts once); a
    probability of exactly 0.5 counts as the category."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    given = docs.sparkSession.sparkContext.broadcast(train(docs, labels, chain))
    names = ["doc_id", "held_out", *(f"p_{c}" for c, _ in chain)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, links = given.value
        for batch, data, off in batches(it):
            d, f = lexicon(data, off)
            f = number[f]
            d, f = d[f >= 0], f[f >= 0]
            out = np.zeros((len(batch), 0))
            for w, b, v in links:
                margin = add_up(d, w[f], len(batch)) + b + out @ v
                out = np.column_stack([out, logistic(margin)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[:, j]) for j in range(out.shape[1]))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, " + ", ".join(f"`p_{c}` double" for c, _ in chain))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_low_quality")


SQL: dict[str, str] = {}
