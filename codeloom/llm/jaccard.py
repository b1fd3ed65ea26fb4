"""N-gram Jaccard self-join of documents by PartEnum signatures.

A document's set: its distinct runs of SHINGLE words (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+), as
64-bit hashes; a document of fewer words, but not none, has its whole sequence as one. Two sets link
when DEN * |intersection| >= NUM * |union|; then they differ in at most
(a + b)(DEN - NUM)/(DEN + NUM) elements, a and b being their sizes.

Signatures. Sizes fall into bands; a pair inside a band meets in the band's own scheme, a pair across a
limit in that limit's scheme. A scheme splits the domain of hashes into n1 ranges, more than such
sets can differ in, and the signatures are the subsets that stay when each second-level partition is taken
alone (n2 = k2 + 1), so one range, with what the set holds there, is one signature. Linked sets
that differ in d elements differ in at most d of the ranges that either holds, so one of the first
d + 1 ranges that a set holds is the same for both: each set gives its first k + 1 + e, k being the
most it may differ in. Empty ranges are never signatures. A set that holds too few ranges also gives
elements as signatures, under the same rule. e more than needed lets a set leave out up to e
signatures that very many sets share.

Links. Texts that are equal are taken once. As linked sets share e + 1 signatures or more, sets with fewer that are not
theirs alone go first (a passage in common is not enough to stay). Sets that share a signature are candidates: first each set
with the first set (hub) of its groups, then, for groups whose sets are not yet in one component, the
pairs of different components: by a join in small groups, and by comparing blocks inside tasks in large ones, where each pair
is looked at once and only those that may link come out. Every candidate
is verified: first by the numbers of elements in ranges of hashes (a few bytes, which rule out most of those that differ too
much), then on the whole sets. So components are exact, and links inside a component that are
already implied are not spelt out.

Cost: two passes over the texts, and more over those of candidates only. Signatures (about 0.4 a shingle, three
numbers each) are the one large shuffle; sets move once per verified candidate. Runs of one
signature are found in sorted order, in constant memory; of a signature that a chunk of documents holds often, all rows but one are dealt
to other tasks (`_crowds`). The joins back on signatures meet a counted table of one row each, so AQE may split a hot one. A hub with many candidates is dealt to many
tasks with a copy of its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, sized, written
from .words import U, batches, grams, mix, release, words

SHINGLE = 5
NUM, DEN = 75, 100
#: Sets sharing one signature from which on it is left out by every set that can spare it.
HOT = 128
#: Sets of one signature that are paired by a join; larger groups are compared inside tasks, in pairs of blocks.
FEW = 64
BLOCK = 512
#: Signatures whose members are told apart at once: 4 bytes for each of them and each of two blocks' members.
COLUMNS = 2048
#: Elements per range of the counts that larger groups are compared by.
FINE = 2
#: Candidates verified by one task's copy of a hub.
DEAL = 64
#: Limits of the bands of sizes.
BANDS = [8 * 4**i for i in range(16)]


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a document's word hashes."""
    if not len(h):
        return h
    if len(h) < n:
        return grams(h, len(h)) ^ U(len(h))
    return np.unique(grams(h, n))


def _differ(a: int, b: int) -> int:
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def _spare(s: int) -> int:
    return s // 20 + 3


@cache
def schemes(s: int) -> list[tuple[int, int, int, int]]:
    """(kind, limit, ranges, k) of the schemes in which a set of s elements takes part."""
    i = next(i for i, r in enumerate(BANDS) if s <= r)
    r, most, least = BANDS[i], s * DEN // NUM, -(-s * NUM // DEN)
    out = [(0, r, r * 32 // 100 + 4, _differ(s, min(r, most)))]
    if most > r:
        out.append((1, r, r * 38 // 100 + 4, _differ(s, most)))
    if i and least <= BANDS[i - 1]:
        out.append((1, BANDS[i - 1], BANDS[i - 1] * 38 // 100 + 4, _differ(s, BANDS[i - 1])))
    return out


def signatures(u: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(signatures, scheme, spare) of a set of sorted hashes, per scheme; spare signatures may be left out (-1: none may)."""
    s = len(u)
    hashed = mix(u + U(0x9E3779B97F4A7C15))
    for kind, limit, n, k in schemes(s):
        part = ((u >> U(32)) * U(n)) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        m, e = len(first), _spare(s)
        least = _spare(-(-s * NUM // DEN))  # what any partner gives more than needed
        scheme = kind * 2
        salt = U((limit * 8 + scheme) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        q = min(m, k + 1 + e)
        end = first[q] if q < m else s
        sums = np.add.reduceat(hashed[:end], first[:q])
        yield mix(sums + part[first[:q]] * U(0xD1342543DE82EF95) + salt), scheme, min(q - k - 1, least) if m > k else -1
        if m <= k:
            q = min(s, k + 1 + e)
            yield mix((hashed[:q] ^ salt) + U(1)), scheme + 1, min(q - k - 1, least)


def _sets(b: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    _, _, h, at = words(data, off, lower=True)
    for i in range(len(at) - 1):
        yield shingles(h[at[i] : at[i + 1]])


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Marks in aux: a row that is known to share its signature, and one that is dealt by its document instead of its signature.
SHARED, DEALT = 1 << 60, 1 << 61
#: Rows of one signature in a chunk of documents from which on all but the first are dealt.
CROWD = 4


def _crowds(sig: np.ndarray, aux: np.ndarray) -> None:
    """Marks rows of signatures that a chunk holds CROWD times or more: of each the first stays with its signature, so that it is
    met there by those of other chunks, and the others are dealt out. So no task gets all rows of a hot signature."""
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(first, len(s)))
    crowded = np.repeat(n >= CROWD, n)
    mark = np.where(crowded, SHARED | DEALT, 0)
    mark[first[n >= CROWD]] = SHARED
    aux[order] |= mark


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, doc, aux): aux is size << 16 | (spare + 1) << 2 | scheme, and marks; one row per document has aux = -1 - size."""
    for b, data, off in batches(it):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        sig, doc, aux, size = [np.empty(0, dtype=U)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], []
        for d, u in zip(ids, _sets(b, data, off), strict=True):
            size.append(len(u))
            for x, scheme, spare in signatures(u) if len(u) else ():
                sig.append(x)
                doc.append(np.full(len(x), d, dtype=np.int64))
                aux.append(np.full(len(x), len(u) << 16 | min(spare + 1, 0x3FFF) << 2 | scheme, dtype=np.int64))
        s, d, a = _i64(np.concatenate(sig)), np.concatenate(doc), np.concatenate(aux)
        if len(s):
            _crowds(s, a)
        own = ids.astype(np.int64)
        s, d, a = np.concatenate([s, own]), np.concatenate([d, own]), np.concatenate([a, -1 - np.array(size, dtype=np.int64)])
        for i in range(0, len(s), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (s, d, a)], names=["sig", "doc", "aux"])


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by sig and doc, those whose sig has another row (or is marked so), and the rows of sizes. Holds one batch and one row."""
    release()
    last: tuple[int, int, int, bool] | None = None  # the row held back, and whether its sig has had another one
    for b in it:
        sig, doc, aux = (b.column(i).to_numpy() for i in range(3))
        loose = (aux < 0) | (aux & DEALT != 0)
        yield b.filter(pa.array(loose))
        sig, doc, aux = sig[~loose], doc[~loose], aux[~loose]
        if not len(sig):
            continue
        if last:
            sig, doc, aux = (np.concatenate([[x], y]).astype(np.int64) for x, y in zip(last[:3], (sig, doc, aux), strict=True))
        same = sig[1:] == sig[:-1]
        more = aux & SHARED != 0
        more[1:] |= same
        more[:-1] |= same
        if last:
            more[0] |= last[3]
        last = (sig[-1], doc[-1], aux[-1], bool(more[-1]))
        more[-1] = False
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (sig, doc, aux)], names=["sig", "doc", "aux"])
    if last and last[3]:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in last[:3]], names=["sig", "doc", "aux"])


def counts(u: np.ndarray, per_range: float = 4) -> np.ndarray:
    """How many elements of a set fall in each of 2**j ranges of hashes, about per_range in each (at most 255 told)."""
    bits = max(3, int(len(u) / per_range).bit_length())
    return np.minimum(np.bincount((u >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """False only for sets that differ in more elements than linked ones can, by their counts alone."""
    if max(x.max(), y.max()) == 255:  # more are not told
        return True
    x, y = x.astype(np.int64), y.astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.abs(x - y).sum()) * (DEN + NUM) <= int(x.sum() + y.sum()) * (DEN - NUM)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in batches(it):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counts(u).tobytes() for u in _sets(b, data, off)], pa.binary())], names=["doc", "counts"])


def _fine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in batches(it):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counts(u, FINE).tobytes() for u in _sets(b, data, off)], pa.binary())], names=["doc", "counts"])


def _within(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    """Of the members of a signature (of two blocks of them), the pairs of different components that may link and that share no
    signature of the list before this one, so that each pair is looked at once."""
    sig, i, j = key
    doc, size, comp, own = (df[c].to_numpy() for c in ("doc", "size", "c", "own"))
    lists = [np.asarray(x) for x in df["sigs"]]
    at = np.repeat(np.arange(len(doc)), [len(x) for x in lists])
    flat = np.concatenate(lists)
    at, flat = at[flat < sig], flat[flat < sig]
    _, place, held = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(place[held[place] > 1], kind="stable")  # those of one member tell nothing
    at, place = at[held[place] > 1][order], place[held[place] > 1][order]
    shared = np.zeros((len(doc), len(doc)), dtype=bool)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, dtype=np.int64)
    for k in range(0, len(cut), COLUMNS):  # so many signatures at once
        a, b = cut[k], cut[k + COLUMNS] if k + COLUMNS < len(cut) else len(place)
        has = np.zeros((len(doc), min(COLUMNS, len(cut) - k)), dtype=np.float32)
        has[at[a:b], np.unique(place[a:b], return_inverse=True)[1]] = 1
        shared |= (has @ has.T) > 0
    vec = [np.frombuffer(x, dtype=np.uint8) for x in df["counts"]]
    full = np.array([x.max() == 255 for x in vec])  # more are not told
    width = np.array([len(x) for x in vec])
    table = {}  # the counts of all members at each resolution that one of them has
    for w in np.unique(width):
        rows = np.zeros((len(doc), w), dtype=np.int16)
        for k in np.flatnonzero(width >= w):
            rows[k] = vec[k].astype(np.int16).reshape(w, -1).sum(axis=1)
        table[w] = rows
    left, right = [], []
    for a in range(0, len(doc), 64):
        q = slice(a, a + 64)
        ok = ~shared[q]
        ok &= comp[q, None] != comp[None, :]
        ok &= DEN * np.minimum(size[q, None], size[None, :]) >= NUM * np.maximum(size[q, None], size[None, :])
        ok &= doc[q, None] < doc[None, :]  # every pair, once
        if i != j:
            ok &= own[q, None] != own[None, :]
        x, y = np.nonzero(ok)
        x = x + a
        w = np.minimum(width[x], width[y])
        far = np.zeros(len(x), dtype=bool)
        for r in np.unique(w):
            for k in range(0, len(x), 8192):
                at_ = np.flatnonzero(w[k : k + 8192] == r) + k
                apart = np.abs(table[r][x[at_]] - table[r][y[at_]]).sum(axis=1, dtype=np.int64)
                far[at_] = apart * (DEN + NUM) > (size[x[at_]] + size[y[at_]]) * (DEN - NUM)
        keep = ~far | full[x] | full[y]
        left.append(doc[x[keep]]), right.append(doc[y[keep]])
    return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def _may(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        x, y = b.column(2), b.column(3)
        ok = [may_link(np.frombuffer(i.as_buffer(), dtype=np.uint8), np.frombuffer(j.as_buffer(), dtype=np.uint8)) for i, j in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4)], names=["a", "b", "n"]).filter(pa.array(ok, pa.bool_()))


def possible(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs (a, b, n) whose counts leave a link possible; counted: doc, counts."""
    x, y = (sized(counted.select(F.col("doc").alias(c), F.col("counts").alias(f"c{c}"))) for c in "ab")
    rows = pairs.join(x, "a").join(y, "b").select("a", "b", "ca", "cb", "n")
    return rows.mapInArrow(_may, "a bigint, b bigint, n bigint")


def _near(a: str, b: str) -> str:
    return f"{DEN} * least({a}, {b}) >= {NUM} * greatest({a}, {b})"


def _deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each document, once for each (key, salt) that asks for it."""
    for b, data, off in batches(it):
        asks = b.column(b.schema.get_field_index("asks")).to_pylist()
        ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for d, ask, u in zip(ids, asks, _sets(b, data, off), strict=True):
            for x in ask:
                for c, v in zip(out, (x["key"], x["salt"], 0 if x["hub"] else 1, d, u.tobytes()), strict=True):
                    c.append(v)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "salt", "side", "doc", "hashes"])


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, salt, side (the hub first): linked pairs. Holds one batch and one set."""
    release()
    hub, hub_set = None, np.empty(0, dtype=U)
    for b in it:
        left, right = [], []
        key, salt, side, doc = (b.column(i).to_pylist() for i in range(4))
        for k, s, z, d, x in zip(key, salt, side, doc, b.column(4), strict=True):
            u = np.frombuffer(x.as_buffer(), dtype=U)
            if not z:
                hub, hub_set = (k, s), u
            elif (k, s) == hub:
                both = np.concatenate([hub_set, u])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if DEN * common >= NUM * (len(both) - common):
                    left.append(k), right.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; texts: doc_id, text."""
    pairs = written(pairs.select("a", "b").distinct())
    deals = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / DEAL).cast("long").alias("n")))
    dealt = pairs.join(sized(deals), "a").select(F.col("b").alias("doc"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("n")).alias("salt"), F.lit(False).alias("hub"))
    hubs = deals.select(F.col("a").alias("doc"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), F.lit(True).alias("hub"))
    asks = written(dealt.union(hubs).groupBy("doc").agg(F.collect_list(F.struct("key", "salt", "hub")).alias("asks")))
    rows = texts.join(sized(asks), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "asks")
    rows = rows.mapInArrow(_deal, "key bigint, salt bigint, side int, doc bigint, hashes binary")
    return written(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "side").mapInArrow(_verify, "a bigint, b bigint").distinct())


def pruned(member: DataFrame) -> DataFrame:
    """member without the sets that share too few signatures to link with any other, and then without signatures of one
    set; with each signature's first set (hub, hub_size) and its number of sets m.

    Linked sets share at least `need` signatures of a scheme, so each of them has as many that are not its alone."""
    enough = member.groupBy("doc", "scheme").agg(F.count("*").alias("n"), F.max("need").alias("least")).where("n >= least").select("doc", "scheme")
    kept = member.select("sig", "doc", "size", "spare", "scheme", "need").join(sized(written(enough)), ["doc", "scheme"], "left_semi")
    kept = written(kept)
    group = kept.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("doc", "size")).alias("h")).where("m > 1")
    return written(kept.join(group.select("sig", "m", F.col("h.doc").alias("hub"), F.col("h.size").alias("hub_size")), "sig"))


def noted(docs: DataFrame) -> DataFrame:
    """Per row of docs with a doc_id: doc_id, a hash of its text (x, y, z), and whether it has a word."""
    text = F.coalesce("text", F.lit(""))
    return written(docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text).alias("x"), F.hash(text).alias("y"), F.length(text).alias("z"), text.rlike("[^\\x20\\x09-\\x0D]").alias("worded")))


def nodes(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs, ids, pairs): both with a node for each text of a document, and the pairs (a, b) of nodes that are one document, if there are any.

    The node of a document is its id. Where rows of an id have different texts, all but the first text (by hash) take numbers above all ids."""
    parts = ("x", "y", "z")
    ends = [f(c).alias(f"{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in parts]
    several = written(ids.groupBy("doc_id").agg(*ends).where(" OR ".join(f"low{c} <> high{c}" for c in parts)).select("doc_id"))
    if several.isEmpty():
        return docs.withColumn("node", F.col("doc_id")), ids.withColumn("node", F.col("doc_id")), None
    each = ids.join(sized(several), "doc_id", "left_semi").select("doc_id", *parts).distinct()
    first = each.groupBy("doc_id").agg(F.min(F.struct(*parts)).alias("first"))
    more = written(each.join(first, "doc_id").where(F.struct(*parts) != F.col("first")).select("doc_id", *parts))
    above = ids.agg(F.max("doc_id")).first()[0] + 1
    more = written(more.withColumn("own", F.lit(above) + F.monotonically_increasing_id()))
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumns({"x": F.xxhash64(text), "y": F.hash(text), "z": F.length(text)})
    tell = lambda df: df.join(sized(more), ["doc_id", *parts], "left").withColumn("node", F.coalesce("own", "doc_id")).drop("own")
    return tell(docs).drop(*parts), written(tell(ids)), more.select(F.col("doc_id").alias("a"), F.col("own").alias("b"))


def join(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    docs: doc_id (bigint), text; other columns are ignored. A null or wordless text has an empty set and
    links with nothing. A null doc_id is not a document: it gets null results. Rows that repeat a
    doc_id are one document, linked as any of its rows, each with its own n_shingles; no docs give no row. A text of any length is taken whole, its set being a
    task's largest piece of work (8 bytes a shingle); pairs at exactly the threshold link."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    owners = docs
    docs, ids, one = nodes(docs, noted(docs))
    docs = docs.where("doc_id IS NOT NULL").select(F.col("node").alias("doc_id"), "text")
    same = ids.where("worded").groupBy("x", "y", "z").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = written(ids.where("worded").join(sized(written(same)), ["x", "y", "z"]).where("node <> rep").select(F.col("node").alias("doc_id"), "rep").distinct())
    texts = docs.join(sized(copies.select("doc_id")), "doc_id", "left_anti")

    signed = texts.mapInArrow(_sign, "sig bigint, doc bigint, aux bigint")
    place = F.when(F.col("aux").bitwiseAND(DEALT) != 0, F.xxhash64("sig", "doc")).otherwise(F.col("sig"))
    found = written(signed.repartition(place).sortWithinPartitions("sig", "doc").mapInArrow(_runs, "sig bigint, doc bigint, aux bigint"))
    sizes = written(found.where("aux < 0").groupBy("doc").agg(F.max(-1 - F.col("aux")).alias("n_shingles")))
    member = found.where("aux >= 0").selectExpr("sig", "doc", f"(aux >> 16) & {(1 << 40) - 1} AS size", "((aux >> 2) & 16383) - 1 AS spare", "aux & 3 AS scheme").withColumn("need", F.greatest(F.col("spare") + 1, F.lit(1)))

    member = pruned(pruned(member))
    if not member.where(F.col("m") > HOT).isEmpty():
        each = written(member.where(F.col("m") > HOT).groupBy("doc", "scheme").agg(F.count("*").alias("n_hot")))
        member = member.join(sized(each), ["doc", "scheme"], "left").withColumn("n_hot", F.coalesce("n_hot", F.lit(0)))
        member = member.where((F.col("m") <= HOT) | (F.col("n_hot") > F.col("spare"))).withColumn("need", F.greatest(F.col("need") - F.col("n_hot"), F.lit(1)))
        member = pruned(member)

    some = sized(written(member.select(F.col("doc").alias("doc_id")).distinct()))
    counted = written(texts.join(some, "doc_id", "left_semi").mapInArrow(_count, "doc bigint, counts binary"))
    edges = member.where("doc <> hub").where(_near("size", "hub_size")).groupBy("hub", "doc").agg(F.count("*").alias("n"))
    edges = written(possible(edges.select(F.col("hub").alias("a"), F.col("doc").alias("b"), "n"), counted))
    best = edges.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("h"))).alias("m")).select((-F.col("m.h")).alias("a"), "b")
    links = verified(texts, best)
    of = components(links)

    def with_component(df: DataFrame, doc: str, out: str) -> DataFrame:
        c = sized(of.select(F.col("id").alias("_id"), F.col("component").alias("_c")))
        return df.join(c, F.col(doc) == F.col("_id"), "left").withColumn(out, F.coalesce("_c", doc)).drop("_id", "_c")

    rest = with_component(with_component(edges, "a", "c1"), "b", "c2").where("c1 <> c2")
    rest = verified(texts, rest.select("a", "b"))
    if not rest.isEmpty():
        links = links.union(rest)
        of = components(links)
    split = with_component(member, "doc", "c")
    open_ = written(split.groupBy("sig").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).where("c1 <> c2").select("sig", "m"))
    side = written(split.select("sig", "doc", "size", "need", "c").join(sized(open_), "sig"))
    many = side.where(F.col("m") > FEW)
    # linked sets share `need` signatures, of which those in larger groups are not seen by the join
    unseen = sized(written(many.groupBy("doc").agg(F.count("*").alias("unseen"))))
    few = side.where(F.col("m") <= FEW).join(unseen, "doc", "left").withColumn("need", F.greatest(F.col("need") - F.coalesce("unseen", F.lit(0)), F.lit(1)))
    x, y = (few.select("sig", *(F.col(c).alias(f"{c}{i}") for c in ("doc", "size", "need", "c"))) for i in (1, 2))
    pairs = x.join(y, "sig").where("doc1 < doc2 AND c1 <> c2").where(_near("size1", "size2"))
    pairs = pairs.groupBy("doc1", "doc2").agg(F.count("*").alias("n"), F.max(F.greatest("need1", "need2")).alias("need")).where("n >= need")
    pairs = possible(pairs.select(F.col("doc1").alias("a"), F.col("doc2").alias("b"), "n"), counted).select("a", "b")
    if not many.isEmpty():
        about = written(many.groupBy("doc").agg(F.collect_list(F.struct("sig", "m")).alias("groups"), F.max("size").alias("size"), F.max("c").alias("c")))
        fine = texts.join(sized(about.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(_fine, "doc bigint, counts binary")
        # a row per set is joined, and only then dealt to its groups and their pairs of blocks
        dealt = about.join(fine, "doc").select("doc", "size", "c", "counts", F.transform("groups", lambda x: x["sig"]).alias("sigs"), F.explode("groups").alias("g"))
        blocks = F.ceil(F.col("g.m") / BLOCK).cast("int")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select(F.col("g.sig").alias("sig"), "doc", "size", "c", "sigs", "counts", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        pairs = pairs.union(dealt.groupBy("sig", "i", "j").applyInPandas(_within, "a bigint, b bigint"))
    rest = verified(texts, pairs.select("a", "b"))
    if not rest.isEmpty():
        links = links.union(rest)
        of = components(links)

    rows = ids.select("doc_id", "node").join(sized(copies.withColumnRenamed("doc_id", "_d")), F.col("node") == F.col("_d"), "left").select("doc_id", F.coalesce("rep", "node").alias("node"))
    if one is not None:  # the texts of one document are linked, by those that stand for them
        stands = copies.select(F.col("doc_id").alias("b"), F.col("rep").alias("_b"))
        firsts = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("_a"))
        tied = one.join(sized(stands), "b", "left").join(sized(firsts), "a", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        of = components(links.union(tied))
        own = with_component(rows, "node", "c").groupBy("c").agg(F.min("doc_id").alias("component_id"))
        out = with_component(rows, "node", "c").join(sized(written(own)), "c")
    else:
        out = with_component(rows, "node", "component_id")
    out = out.join(sized(sizes.withColumnRenamed("doc", "_d")), F.col("node") == F.col("_d"), "left")
    none = F.lit(None).cast("bigint")
    return out.select("doc_id", "n_shingles", "component_id").union(owners.where("doc_id IS NULL").select("doc_id", none, none))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


SQL = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
      JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""
}
