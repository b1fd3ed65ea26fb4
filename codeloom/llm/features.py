"""Sparse indicator features of texts, and linear models on them.

Features are made in tasks from whole texts (Arrow batches, no Python string per word); models are
fitted on a bounded sample of labelled rows (MAX_TRAIN, those with the smallest hashes of their ids), and
scored in tasks. Only the sample's feature numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .words import LOWER, NOT_SPACE, U, batches, mix, words

#: Labelled rows that a model is fitted on at most.
MAX_TRAIN = 6000
FOLDS = 5

#: Classes of bytes: letters of either case, digits, space, line ends, each other ASCII sign, other bytes.
_CLASS = np.full(256, 2, dtype=np.int64)
_CLASS[0x61:0x7B] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[[0x20, 0x09]] = 5
_CLASS[[0x0A, 0x0D]] = 6
_signs = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS[_signs] = 7 + np.arange(len(_signs)) % 25
_CLASS[:0x20][_CLASS[:0x20] == 2] = 1
CLASS_BITS = 5
SHAPE_BITS = 12
WORD_BITS = 16


def _present(doc: np.ndarray, code: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, code), in order."""
    seen = np.zeros(n_docs * size, dtype=bool)
    seen[doc * size + code] = True
    at = np.flatnonzero(seen)
    return at // size, at % size


def style(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature): n-gram indicators of a text's make-up: runs of 3 classes of characters, runs of 2
    shapes of words (length, case, signs, seen before in the text or just before), and words. Features < STYLE."""
    n_docs = len(off) - 1
    out_d, out_f = [], []
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    c = _CLASS[data]
    if len(c) > 2:
        same = doc[2:] == doc[:-2]
        d, f = _present(doc[:-2][same], ((c[:-2] << 2 * CLASS_BITS) | (c[1:-1] << CLASS_BITS) | c[2:])[same], n_docs, 1 << 3 * CLASS_BITS)
        out_d.append(d), out_f.append(f)
    s, e, h, at = words(data, off, lower=True)
    if len(s):
        wd = np.repeat(np.arange(n_docs), np.diff(at))
        length = np.minimum((e - s).astype(np.int64).clip(1, 31), 31)
        size = np.log2(length).astype(np.int64)  # 0-4
        upper = np.concatenate([[0], np.cumsum(c == 3)])
        sign = np.concatenate([[0], np.cumsum((c >= 7) | (c == 4))])
        ups, sg = upper[e] - upper[s], sign[e] - sign[s]
        case = np.where(ups == 0, 0, np.where(ups == 1, 1, 2))
        signs = np.where(sg == 0, 0, np.where(sg < 3, 1, 2))
        key = (h >> U(1)) ^ (wd.astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        just = np.zeros(len(key), dtype=bool)
        just[1:] = (key[1:] == key[:-1])
        seen = np.where(just, 2, again & (length >= 6))
        shape = ((size * 3 + case) * 3 + signs) * 3 + seen  # < 135
        one = shape
        pair = wd[1:] == wd[:-1]
        two = (mix((shape[:-1] * 135 + shape[1:]).astype(U)) & U((1 << SHAPE_BITS) - 1)).astype(np.int64)[pair]
        base = 1 << 3 * CLASS_BITS
        d, f = _present(np.concatenate([wd, wd[1:][pair]]), np.concatenate([one, 256 + two]), n_docs, 256 + (1 << SHAPE_BITS))
        out_d.append(d), out_f.append(f + base)
        base += 256 + (1 << SHAPE_BITS)
        d, f = _present(wd, (h & U((1 << WORD_BITS) - 1)).astype(np.int64), n_docs, 1 << WORD_BITS)
        out_d.append(d), out_f.append(f + base)
    return _sorted(out_d, out_f)


STYLE = (1 << 3 * CLASS_BITS) + 256 + (1 << SHAPE_BITS) + (1 << WORD_BITS)

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[0x30:0x3A] = _IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = _IS_LETTER[0x80:] = True
LEXICON_BITS = 20


def lexicon(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature): indicators of words (letters and digits, lower-cased) and of their first 4 to 8 bytes."""
    n_docs = len(off) - 1
    s, e, h, at = words(data, off, _IS_LETTER, lower=True)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wd = np.repeat(np.arange(n_docs), np.diff(at))
    low = np.concatenate([LOWER[data], np.zeros(8, dtype=np.uint8)]).astype(U)
    codes, docs = [h], [wd]
    acc = np.zeros(len(s), dtype=U)
    for k in range(8):
        acc = acc * U(0x100000001B3) + low[s + k] + U(1)
        if k >= 3:
            some = e - s > k
            codes.append(mix(acc[some] + U(k)))
            docs.append(wd[some])
    code = (np.concatenate(codes) & U((1 << LEXICON_BITS) - 1)).astype(np.int64)
    key = np.concatenate(docs) << LEXICON_BITS | code
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> LEXICON_BITS, key & ((1 << LEXICON_BITS) - 1)


LEXICON = 1 << LEXICON_BITS


def _sorted(d: list[np.ndarray], f: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not d:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    d_, f_ = np.concatenate(d), np.concatenate(f)
    order = np.argsort(d_, kind="stable")
    return d_[order], f_[order]


Maker = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Sample:
    """The fitted-on rows: for row i, features[at[i]:at[i + 1]], and its labels."""

    def __init__(self, features: np.ndarray, at: np.ndarray, labels: np.ndarray) -> None:
        self.features, self.at, self.labels = features, at, labels

    def __len__(self) -> int:
        return len(self.labels)

    def row(self, i: int) -> np.ndarray:
        return self.features[self.at[i] : self.at[i + 1]]

    def only(self, keep: np.ndarray) -> Sample:
        """With the features numbered by keep (-1: left out)."""
        f = keep[self.features]
        ok = f >= 0
        at = np.concatenate([[0], np.cumsum(ok)])[self.at]
        return Sample(f[ok], at, self.labels)

    def dot(self, w: np.ndarray) -> np.ndarray:
        acc = np.concatenate([[0.0], np.cumsum(w[self.features])])
        return acc[self.at[1:]] - acc[self.at[:-1]]


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], maker: Maker, size: int = MAX_TRAIN) -> Sample:
    """At most `size` rows of docs that are not held out and have all the labels (0 or 1) of `columns`, which
    are expressions on labels. Rows with a null id, text or label are left out; of repeated ids, the largest labels and the text with the
    smallest features count, so at most `size` rows are collected. Equal hashes of ids go by id."""
    y = labels.select("doc_id", *(F.expr(c).cast("double").alias(f"y{i}") for i, c in enumerate(columns))).dropna()
    y = y.where(~held_out()).groupBy("doc_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(columns))))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(y), "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in batches(it):
            d, f = maker(data, off)
            at = np.searchsorted(d, np.arange(len(b) + 1))
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", *(f"y{i}" for i in range(len(columns))))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f[x:z].astype(np.int32).tobytes() for x, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", *(f"y{i}" for i in range(len(columns))), "f"])

    kinds = ", ".join(f"y{i} double" for i in range(len(columns)))
    kept = rows.select("doc_id", "text", *(f"y{i}" for i in range(len(columns)))).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}, f binary").groupBy("doc_id", *(f"y{i}" for i in range(len(columns)))).agg(F.min("f").alias("f")).collect()
    kept.sort(key=lambda r: (r[0], bytes(r[-1])))
    parts = [np.frombuffer(bytes(r[-1]), dtype=np.int32) for r in kept]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    ys = np.array([[r[1 + i] for i in range(len(columns))] for r in kept], dtype=np.float64).reshape(len(kept), len(columns))
    return Sample(np.concatenate(parts) if parts else np.empty(0, np.int32), at, ys)


def hinge(rows: Sample, y: np.ndarray, scale: np.ndarray, extra: np.ndarray | None = None, c: float = 1.0, passes: int = 20, tolerance: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, bias, weights of extra): a linear hinge-loss model by dual coordinate descent.

    Minimises |w|^2 / 2 + c * sum of max(0, 1 - y f(x)), y being 0 or 1 and x a row's indicators times scale, a
    constant 1, and the row of extra. Each step solves one row's dual variable exactly within [0, c]; passes end when none
    moves by more than tolerance * c."""
    n = len(rows)
    sign = np.where(y > 0, 1.0, -1.0)
    extra = np.zeros((n, 0)) if extra is None else extra
    w, b, v = np.zeros(len(scale)), 0.0, np.zeros(extra.shape[1])
    alpha = np.zeros(n)
    xs = [scale[rows.row(i)] for i in range(n)]
    q = np.array([x @ x + 1 + e @ e for x, e in zip(xs, extra, strict=True)]) if n else np.empty(0)
    rng = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(n):
            f, x = rows.row(i), xs[i]
            g = sign[i] * (w[f] @ x + b + v @ extra[i]) - 1
            a = min(max(alpha[i] - g / q[i], 0.0), c)
            if a != alpha[i]:
                d = (a - alpha[i]) * sign[i]
                w[f] += d * x
                b += d
                v += d * extra[i]
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < tolerance * c:
            break
    return w, b, v


def chance(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift): the logistic curve of a margin that fits y best (with the two counts that keep it off 0 and 1)."""
    pos, neg = float(y.sum()), float((1 - y).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()]) + np.array([1e-6 * a, 0])
        s = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def folds(n: int, k: int = FOLDS) -> np.ndarray:
    """Each row's fold: the same for the same number of rows."""
    return np.random.default_rng(11).permutation(n) % k


def add_up(d: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(d, weights=values, minlength=n)


__all__ = ["FOLDS", "LEXICON", "MAX_TRAIN", "NOT_SPACE", "STYLE", "Sample", "add_up", "chance", "folds", "hinge", "lexicon", "logistic", "sample", "style"]
