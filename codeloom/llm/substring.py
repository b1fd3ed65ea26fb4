"""Substring dedup: seed and extend on winnowed anchors.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is WINDOW consecutive words of one document; each word
covered by a window that also starts anywhere else goes. Windows are judged on the input.

Seeds. Every window has one anchor: its K-word run with the smallest hash (the leftmost of equals).
Equal windows have equal anchors, and successive windows mostly share one, so anchors are few. Only
anchors that occur more than once go on.

Extension. Around an anchor, the windows that have it make up a stretch, which is extended both
ways as far as it goes: if the anchor occurs elsewhere with the same whole stretch, all its windows
repeat (the case of copies). Else the match ends inside: from the anchor's occurrences, each different stretch (one
of each) is opened into its windows, and those that occur twice repeat. The union of what repeats is
the set of maximal repeats of WINDOW words or more.

Cost: equal texts are taken once (each of their windows repeats). Three passes over the texts in Arrow
batches; shuffled are the anchors (about one for 12 words, a few numbers each), then only repeated ones.
Counts are combined before the shuffle, so no anchor, however common, is gathered in one task.
Keys are 64 bits for anchors and 128 bits for stretches and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sized, written
from .words import U, batches, grams, mix, words

WINDOW = 35
K = 12
#: Spans (two numbers each) that may be broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_SPANS = 20_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Ranges:
    """Hashes of ranges of word hashes, two independent ones."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h) + 1
        self.acc = []
        for m in _ODD:
            if m not in _power or len(_power[m][0]) < n:
                pair = []
                for base in (m, pow(m, -1, 1 << 64)):
                    p = np.full(max(n, 1 << 18), base, dtype=U)
                    p[0] = 1
                    pair.append(np.multiply.accumulate(p))
                _power[m] = tuple(pair)
            acc = np.zeros(n, dtype=U)
            np.cumsum(h * _power[m][0][: n - 1], out=acc[1:])
            self.acc.append((acc, _power[m][1]))

    def get(self, s: np.ndarray, e: np.ndarray, which: int) -> np.ndarray:
        acc, inv = self.acc[which]
        return mix((acc[e] - acc[s]) * inv[s])


def anchors(h: np.ndarray, at: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows, anchor's place) of each stretch; h: word hashes, at: each document's first word."""
    n = np.diff(at) - window + 1  # windows of each document
    some = np.flatnonzero(n > 0)
    none = np.empty(0, dtype=np.int64)
    if not len(some):
        return none, none, none, none
    g = grams(h, k)
    order = np.argsort(g, kind="stable")
    rank = np.empty(len(g), dtype=np.int64)
    rank[order] = np.arange(len(g))
    low, have, need = rank, 1, window - k + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    doc = np.repeat(some, n[some])
    ends = np.cumsum(n[some])
    s = np.arange(ends[-1]) + np.repeat(at[some] - ends + n[some], n[some])
    p = order[low[s]]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[first], s[first], np.diff(np.append(first, len(s))), p[first]


def _seed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in batches(it):
        _, _, h, at = words(data, off)
        doc, s, n, p = anchors(h, at)
        if not len(doc):
            continue
        r = Ranges(h)
        g = grams(h, K)
        stretch = r.get(s, s + n + WINDOW - 1, 0) + mix((n.astype(U) << U(32)) + (p - s).astype(U))
        key = b.column(0).to_numpy()[doc]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[p].view(np.int64), stretch.view(np.int64), key, (s - at[doc]).astype(np.int32), n.astype(np.int32))], names=["anchor", "stretch", "key", "start", "n"])


def _open(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the stretches asked for (spans: start, n), as two hashes."""
    for b, data, off in batches(it):
        _, _, h, at = words(data, off)
        r = Ranges(h)
        asked = b.column(b.schema.get_field_index("spans"))
        flat = asked.flatten()
        doc = np.repeat(np.arange(len(b)), np.diff(asked.offsets.to_numpy()))
        start, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        if not len(ends):
            continue
        s = np.arange(ends[-1]) + np.repeat(start - ends + n, n)
        doc = np.repeat(doc, n)
        w = s + at[doc]
        key = b.column(0).to_numpy()[doc]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r.get(w, w + WINDOW, 0).view(np.int64), r.get(w, w + WINDOW, 1).view(np.int64), key, s.astype(np.int32))], names=["w1", "w2", "key", "start"])


def _key() -> F.Column:
    return F.xxhash64("doc_id", "text").alias("key")


def repeats(docs: DataFrame) -> DataFrame:
    """(key, copied, spans): for each document with a repeated window. key: xxhash64(doc_id, text); copied:
    the whole text occurs again; spans: (start, n), n successive windows from word `start` on, each of them repeated."""
    every = docs.select(_key(), "text")
    ids = written(every.select("key", F.xxhash64("text").alias("x"), F.hash("text").alias("y"), F.length("text").alias("z")))
    same = written(ids.groupBy("x", "y", "z").agg(F.min("key").alias("rep"), F.count("*").alias("c")).where("c > 1"))
    copied = written(ids.join(sized(same), ["x", "y", "z"]).select("key", "rep").distinct())
    texts = every.join(sized(copied.where("key <> rep").select("key")), "key", "left_anti")

    seeds = written(texts.mapInArrow(_seed, "anchor bigint, stretch bigint, key bigint, start int, n int"))
    twice = written(seeds.groupBy("anchor").count().where("count > 1").select("anchor"))
    seeds = written(seeds.join(sized(twice), "anchor", "left_semi"))
    groups = written(seeds.groupBy("anchor", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("key", "start", "n")).alias("one")))
    whole = seeds.join(sized(groups.where("c > 1").select("anchor", "stretch")), ["anchor", "stretch"], "left_semi").select("key", "start", "n")
    several = groups.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    probes = groups.join(sized(written(several)), "anchor", "left_semi").select("one.*")

    asked = written(probes.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    opened = texts.join(_spans(asked), "key").select("key", "text", "spans").mapInArrow(_open, "w1 bigint, w2 bigint, key bigint, start int")
    opened = written(opened)
    again = written(opened.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"))
    part = opened.join(sized(again), ["w1", "w2"], "left_semi").select("key", "start", F.lit(1).alias("n"))
    spans = whole.union(part).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    flag = copied.select("key", F.lit(True).alias("copied"))
    return flag.join(spans, "key", "full").select("key", F.coalesce("copied", F.lit(False)).alias("copied"), F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"))


def _spans(df: DataFrame) -> DataFrame:
    n = df.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_SPANS else df.hint("merge")


def _keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in batches(it):
        raw = data.tobytes()
        copied = b.column(b.schema.get_field_index("copied")).to_pylist()
        spans = b.column(b.schema.get_field_index("spans"))
        n_words, n_removed, kept = [], [], []
        for i in range(len(b)):
            w = raw[off[i] : off[i + 1]].split()
            n = len(w)
            if copied[i] and n >= WINDOW:
                w = []
            elif spans[i].is_valid and len(spans[i].values):
                v = spans[i].values
                s, k = v.field(0).to_numpy(), v.field(1).to_numpy()
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + k + WINDOW - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                w = [w[j] for j in np.flatnonzero(~gone)]
            n_words.append(n), n_removed.append(n - len(w)), kept.append(b" ".join(w))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, text (the kept words, joined by one space).

    docs: doc_id (bigint), text; other columns are ignored. A null or empty text has no words and a text
    of fewer than WINDOW words loses none. Repeated rows are documents of their own, so each is a
    copy of the other, whatever their ids (null ids too); no docs give no row. A text of any length is read whole;
    of equal hashes in a window the leftmost is its anchor."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = written(repeats(docs))
    out = docs.withColumn("key", _key()).join(_spans(marks), "key", "left")
    return out.select("doc_id", "text", "copied", "spans").mapInArrow(_keep, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = {
    "op3_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
m AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s WHERE g IN (SELECT g FROM m)),
k AS (SELECT w.doc_id, x.p, w.w[x.p] AS word FROM w, unnest(range(1, len(w.w) + 1)) AS x(p) ANTI JOIN p ON p.doc_id = w.doc_id AND p.p = x.p),
t AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)"""
}
