"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent letter n-grams (1 to 3 characters, lower-cased, runs of anything
but letters being one boundary mark), in order of frequency. A document is given the language whose
profile is nearest by out-of-place distance: over the document's own most frequent n-grams, the sum of the
differences of ranks, PROFILE for an n-gram that the profile lacks.

Counts for the profiles cover every training document. Cost: one pass over the training texts, which
sends a count per language and n-gram from each task (so at most languages x n-grams of the
alphabets, whatever the corpus), and one pass to predict; nothing else is shuffled. Profiles are broadcast: languages x PROFILE rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read
from .words import batches

PROFILE = 300
UNKNOWN = "und"
#: How much nearer one profile must be to count for e times as likely, in mean ranks out of place.
TEMPERATURE = 10.0
_SHIFT = 21  # bits of a code point

_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter."""
    if not _letters:
        t = np.zeros(0x110000, dtype=np.int64)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters.append(t)
    return _letters[0]


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) sorted by document and n-gram, and the alphabet; n-grams are numbers in base 2**b of
    places in the alphabet (0 is the boundary; shorter n-grams have leading zeros), so they order alike in every chunk."""
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[off]
    c = _fold()[cp]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # a boundary before each document and after it; runs of boundaries are one
    c = np.insert(c, at[:-1], 0)
    doc = np.insert(doc, at[:-1], np.arange(len(at) - 1))
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    alphabet = np.flatnonzero(np.bincount(c, minlength=1)) if len(c) else np.zeros(1, dtype=np.int64)
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    x = place[c]
    b = max(1, int(len(alphabet) - 1).bit_length())
    n = len(x)
    same1, same2 = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    same1[:-1] = doc[1:] == doc[:-1]
    same2[:-2] = doc[2:] == doc[:-2]
    x1, x2 = np.zeros_like(x), np.zeros_like(x)
    x1[:-1], x2[:-2] = x[1:], x[2:]
    ends1, ends2 = np.where(same1, x1, 0), np.where(same2, x2, 0)  # the end of a document is a boundary
    one = x > 0
    two = (x > 0) | (ends1 > 0)
    three = ends1 > 0
    key = doc << (3 * b + 2)
    all_ = np.concatenate([key[one] | x[one], (key | 1 << 3 * b | x << b | ends1)[two], (key | 2 << 3 * b | x << 2 * b | ends1 << b | ends2)[three]])
    all_.sort()
    if not len(all_):
        e = np.empty(0, dtype=np.int64)
        return e, e, e, alphabet
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first] >> (3 * b + 2), all_[first] & ((1 << (3 * b + 2)) - 1), np.diff(np.append(first, len(all_))), alphabet


def _wide(gram: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """n-grams as numbers that mean the same in every chunk: of code points (folded), their number on top is 0-2."""
    b = max(1, int(len(alphabet) - 1).bit_length())
    m = (1 << b) - 1
    size = gram >> (3 * b)
    # code points have 21 bits; three of them and the size are mixed into 64 bits, which need not be undone
    a, c, d = (alphabet[(gram >> s) & m].astype(np.uint64) for s in (2 * b, b, 0))
    out = (a << np.uint64(2 * _SHIFT) | c << np.uint64(_SHIFT) | d) * np.uint64(3) + size.astype(np.uint64)
    return out.view(np.int64)


def _learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b, data, off in batches(it):
        lang = np.array(b.column(b.schema.get_field_index("lang")).to_pylist(), dtype=object)
        doc, gram, n, alphabet = grams(data, off)
        wide = _wide(gram, alphabet)
        for x in set(lang):
            at = (lang == x)[doc]
            old = total.get(x, (np.empty(0, np.int64), np.empty(0, np.int64)))
            k, inv = np.unique(np.concatenate([old[0], wide[at]]), return_inverse=True)
            total[x] = (k, np.bincount(inv, weights=np.concatenate([old[1], n[at]]), minlength=len(k)).astype(np.int64))
    for x, (k, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])


def profiles(docs: DataFrame, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """(lang, n-gram, rank) learned from docs (text, lang); rows whose text or lang is null are left out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInArrow(_learn, "lang string, gram bigint, n bigint")
    n = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return [tuple(r) for r in n.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()]


def predict(docs: DataFrame, learned: list[tuple[str, int, int]], size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score for text; what is passed on: the columns before text."""
    langs = sorted({r[0] for r in learned})
    known = np.array(sorted({r[1] for r in learned}), dtype=np.int64)
    rank = np.full((len(known) + 1, max(len(langs), 1)), -1, dtype=np.int64)
    for lang, g, r in learned:
        rank[np.searchsorted(known, g), langs.index(lang)] = r - 1
    given = docs.sparkSession.sparkContext.broadcast((langs, known, rank))
    cols = [c for c in docs.columns if c != "text"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known, rank = given.value
        for b, data, off in batches(it):
            n_docs = len(b)
            doc, gram, n, alphabet = grams(data, off)
            # each document's n-grams by count, most first, ties in the order of the n-grams
            order = np.argsort(doc * (int(n.max(initial=0)) + 1) + (n.max(initial=0) - n), kind="stable")
            begin = np.searchsorted(doc, np.arange(n_docs + 1))
            own = np.arange(len(doc)) - np.repeat(begin[:-1], np.diff(begin))
            top = own < size
            d, own = doc[top], own[top]
            wide = _wide(gram[order][top], alphabet)
            k = np.searchsorted(known, wide)
            k[k >= len(known)] = 0
            k = np.where(known[k] == wide, k, len(known)) if len(known) else np.zeros(len(wide), dtype=np.int64)
            terms = np.bincount(d, minlength=n_docs)
            dist = np.empty((n_docs, len(langs)))
            for j in range(len(langs)):
                r = rank[k, j]
                dist[:, j] = np.bincount(d, weights=np.where(r < 0, size, np.abs(r - own)), minlength=n_docs)
            mean = dist / np.maximum(terms, 1)[:, None]
            if langs:
                best = mean.argmin(axis=1)
                e = np.exp(-(mean - mean.min(axis=1)[:, None]) / TEMPERATURE)
                score = np.where(terms > 0, 1 / e.sum(axis=1), 0.0)
                pred = [langs[i] if t else UNKNOWN for i, t in zip(best, terms, strict=True)]
            else:
                score, pred = np.zeros(n_docs), [UNKNOWN] * n_docs
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in cols), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*cols, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    docs: doc_id, text, lang; other columns are ignored. A text without letters, or null, is `und` with score 0;
    so is every text if nothing can be learned (no docs give no row). Equal distances: the
    first language in alphabetical order; n-grams of equal counts rank by their code points. Rows that repeat count as often as they occur. A
    text of any length is read whole, in a chunk of its own if it is long."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", "lang")
    learned = profiles(rows.where("NOT held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), learned)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
