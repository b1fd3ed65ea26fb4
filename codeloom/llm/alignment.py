"""Alignment of two tokenizers over a corpus: groups of tokens that end together, and how often the ids at those ends meet.

Tokenizer A encodes space + text, tokenizer B the text (it adds the space itself), so both spell the same bytes. Byte offsets
at which a token of each ends cut both sequences into groups; the two tokens that end there are a link. A pair
of ids counts as often as links of the whole corpus hold it, and a link is best if no other A id has a higher count with its B id.

Postings. A pass over the texts writes a row per document and, for each batch of documents and each shard of B ids, the
multiplicities of its pairs in its documents (arrays in one row, sorted by pair and document). The pairs' sums meet in one aggregation, combined
before the shuffle. Then counts and postings are cogrouped by shard as one sorted stream (Spark sorts and spills it): a task first reads the
counts of its B ids, takes the maximum of each, and then streams the postings, whose contributions to documents
come out as rows and are summed by document.

No hot id: a shard whose postings are large (a third of all links may hold one B id) is dealt to salts, by batch; each salt gets
a copy of the shard's counts, and has at least COPIES times their bytes in postings, so that copies are a fixed share of the data. The counts of
a shard are the only thing a task holds: 16 bytes for each different pair of its B ids.

Tokenizing. Neither tokenizer joins what a break divides (a space or newline after a character that is no white space), which the worker
checks against B's vocabulary; so units between breaks are encoded and aligned once and remembered. A text with a unit whose bytes differ is
encoded as a whole, and has no tokens if they still differ.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, written
from .words import CACHES, release

#: Shards of B ids.
SHARDS = 32
#: Bytes of postings in a salt of a shard, and how many times the bytes of the shard's counts they are at least.
SALT_BYTES, COPIES = 32 << 20, 8
#: Bytes of text whose postings are made at once; a longer document is a batch of its own.
BATCH = 4 << 20
#: Characters of units, 100 added for each, that a worker remembers.
REMEMBER = 40_000_000

_SPACE_MARK = "▁"
_aligners: dict[tuple[str, str], Aligner] = {}


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_table() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers with the bytes of their tokens, and the units aligned so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        table = byte_table()
        self.bytes_a: dict[int, bytes] = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(piece)]
        inside = "".join(p.replace(_SPACE_MARK, " ").lstrip(" ") for i, p in enumerate(piece) if not self.b.is_byte(i))
        breaks = "".join(c for c in " \n" if c not in inside)
        # a unit starts with its white space; white space that is no break joins it to what follows
        self.units = re.compile(rf"\s*\S+(?:[^\S{breaks}]\s*\S*)*|\s+") if "\n" in breaks else re.compile(r"[\s\S]+")
        self.mark = self.b.encode("\n") if "\n" in breaks else []  # what stands before a unit that is encoded alone
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets all units."""
        self.known.clear()
        self.held = 0
        self.text: list[str | None] = []  # the groups of each unit, None if its bytes differ
        self.numbers = array("q")  # of each unit: tokens of A, of B, groups, its first link
        self.links = array("q")  # b << 32 | a

    def together(self, ids_a: list[int], ids_b: list[int]) -> tuple[str, list[int]]:
        """The groups as text, and the links."""
        end_a, end_b = list(accumulate(len(self.bytes_a[i]) for i in ids_a)), list(accumulate(len(self.bytes_b[i]) for i in ids_b))
        groups, links, i, j = [], [], 0, 0
        at = {e: k + 1 for k, e in enumerate(end_b)}
        for n, e in enumerate(end_a):
            m = at.get(e)
            if m is not None:
                groups.append(f"{','.join(map(str, ids_a[i : n + 1]))}|{','.join(map(str, ids_b[j:m]))}")
                links.append(ids_b[m - 1] << 32 | ids_a[n])
                i, j = n + 1, m
        return ";".join(groups), links

    def learn(self, new: list[str]) -> None:
        first = len(self.mark)
        coded = self.b.encode(["\n" + u for u in new], num_threads=1) if first else [[] for _ in new]
        for u, e, b in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), coded, strict=True):
            a, b, want = e.ids, b[first:] if b[:first] == self.mark else [], u.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == want and b"".join([self.bytes_b[i] for i in b]) == want
            text, links = self.together(a, b) if same else (None, [])
            self.known[u] = len(self.text)
            self.text.append(text)
            self.numbers.extend((len(a), len(b), len(links), len(self.links)))
            self.links.extend(links)
            self.held += len(u) + 100

    def whole(self, text: str) -> tuple[int, int, str, list[int]] | None:
        """(tokens of A, of B, groups, links) of a text that units do not tell; None if its bytes differ."""
        spelt = f" {text}"
        a, b = self.a.encode(spelt, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        want = spelt.encode()
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        groups, links = self.together(a, b)
        return len(a), len(b), groups, links

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text (tokens of A, of B, groups) and the hash of its groups; and (text, link) of every link."""
        if self.held > REMEMBER:
            self.clear()
        units = [self.units.findall(f" {t}") if t else [] for t in texts]
        known = self.known
        new = dict.fromkeys(u for us in units for u in us if u not in known)
        if new:
            self.learn(list(new))
        numbers = np.zeros((len(texts), 3), dtype=np.int64)
        hashes, more_at, more = [], [], []
        told, flat, sizes = self.text, array("q"), []
        for k, (t, us) in enumerate(zip(texts, units, strict=True)):
            at = [known[u] for u in us]
            parts = [told[i] for i in at]
            if None in parts:
                found = self.whole(t)
                at = []
                if found:
                    numbers[k] = found[0], found[1], len(found[3])
                    hashes.append(hashlib.sha256(found[2].encode()).hexdigest())
                    more_at.append(np.full(len(found[3]), k)), more.append(np.array(found[3], dtype=np.int64))
                else:
                    hashes.append("")
            else:
                hashes.append(hashlib.sha256(";".join(parts).encode()).hexdigest() if at else "")
            flat.extend(at)
            sizes.append(len(at))
        of = np.repeat(np.arange(len(texts)), sizes)
        unit = np.frombuffer(flat, dtype=np.int64) if flat else np.empty(0, dtype=np.int64)
        if len(unit):
            table = np.array(self.numbers, dtype=np.int64).reshape(-1, 4)[unit]
            for c in range(3):
                np.add.at(numbers[:, c], of, table[:, c])
            n = table[:, 2]
            place = np.arange(n.sum()) + np.repeat(table[:, 3] - (np.cumsum(n) - n), n)
            more.append(np.array(self.links, dtype=np.int64)[place]), more_at.append(np.repeat(of, n))
        if not more:
            return numbers, hashes, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return numbers, hashes, np.concatenate(more_at), np.concatenate(more)


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        _aligners[paths] = Aligner(*paths)
        CACHES.append(_aligners[paths])
    return _aligners[paths]


_MADE = "kind int, key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, shard int, pairs binary, sums binary, runs binary, docs binary, times binary"
_TYPES = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("pairs", "sums", "runs", "docs", "times"))])


def _rows(**columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _TYPES], schema=_TYPES)


def _cut(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about BATCH characters, 4096 texts at most."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > BATCH or i - start >= 4096):
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def postings(docs: DataFrame, paths: tuple[str, str], shards: int) -> DataFrame:
    """A row per document (kind 0: key, counts, groups_sha256) and a row per batch and shard with its postings (kind 1: key is the batch's;
    pairs, their sums, the number of documents of each, then these documents and how often they hold it)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tool, number = aligner(paths), 0
        for whole in it:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            for cut in _cut(texts):
                key = TaskContext.get().partitionId() << 40 | number << 16
                number += 1
                part = whole.column(0).slice(cut.start, cut.stop - cut.start)
                numbers, hashes, doc, link = tool.batch(texts[cut])
                n_a, n_b, groups = numbers.T
                yield _rows(kind=np.zeros(len(part), dtype=np.int32), key=key + np.arange(len(part)), doc_id=part, n_a=n_a, n_b=n_b, n_groups=groups, n_links=groups, groups_sha256=hashes)
                if not len(link):
                    continue
                link = (link >> 32) % shards << 56 | link  # sorted by shard, B id, A id
                pair, of = np.unique(link, return_inverse=True)
                post, times = np.unique(of * len(part) + doc, return_counts=True)
                of, doc = np.divmod(post, len(part))
                runs, sums = np.bincount(of, minlength=len(pair)), np.bincount(of, weights=times, minlength=len(pair)).astype(np.int64)
                shard, first = np.unique(pair >> 56, return_index=True)
                edge = np.append(first, len(pair))
                place = np.append(0, np.cumsum(runs))[edge]
                pair &= (1 << 56) - 1
                out: dict[str, list[bytes]] = {c: [] for c in ("pairs", "sums", "runs", "docs", "times")}
                for i in range(len(shard)):
                    a, b, x, y = edge[i], edge[i + 1], place[i], place[i + 1]
                    for c, v in zip(out, (pair[a:b], sums[a:b], runs[a:b].astype(np.int32), doc[x:y].astype(np.uint16), times[x:y].astype(np.int32)), strict=True):
                        out[c].append(v.tobytes())
                yield _rows(kind=np.ones(len(shard), dtype=np.int32), key=np.full(len(shard), key), shard=shard.astype(np.int32), **out)

    return docs.mapInArrow(run, _MADE)


def _summed(pair: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    p, of = np.unique(np.concatenate(pair), return_inverse=True)
    out = np.zeros(len(p), dtype=np.int64)
    np.add.at(out, of, np.concatenate(n))
    return p, out


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the batches' pairs, summed as far as a task may hold them."""
    release()
    pair, n, held = [], [], 0
    for b in it:
        for x, y in zip(b.column(0), b.column(1), strict=True):
            pair.append(np.frombuffer(x.as_buffer(), dtype=np.int64)), n.append(np.frombuffer(y.as_buffer(), dtype=np.int64))
            held += len(pair[-1])
            if held > 1 << 20:
                p, s = _summed(pair, n)
                pair, n, held = [p], [s], len(p)
                if held > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s)], names=["pair", "n"])
                    pair, n, held = [], [], 0
    if pair:
        p, s = _summed(pair, n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s)], names=["pair", "n"])


def _contributions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shard, salt and kind (counts first): (key, n_best, count_sum) for each posting row's documents. Holds the counts of one shard."""
    release()
    now, pair, n, ready = None, [], [], False
    codes = count = best = np.empty(0, dtype=np.int64)
    for b in it:
        col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
        shard, kind = col["shard"].to_numpy().astype(np.int64) << 32 | col["salt"].to_numpy(), col["kind"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]))
        keys, n_best, sums = [], [], []
        for i, j in zip(edges, [*edges[1:], len(b)], strict=True):
            if shard[i] != now:
                now, pair, n, ready = shard[i], [], [], False
            if kind[i] == 0:
                pair.append(col["pair"].slice(i, j - i).to_numpy(zero_copy_only=False)), n.append(col["n"].slice(i, j - i).to_numpy(zero_copy_only=False))
                continue
            if not ready:
                codes, count = np.concatenate(pair).astype(np.int64), np.concatenate(n).astype(np.int64)
                order = np.argsort(codes)
                codes, count = codes[order], count[order]
                first = np.flatnonzero(np.concatenate([[True], codes[1:] >> 32 != codes[:-1] >> 32]))
                highest = np.maximum.reduceat(count, first)
                best = count == np.repeat(highest, np.diff(np.append(first, len(codes))))
                pair, n, ready = [], [], True
            for k in range(i, j):
                p, runs, doc, times = (np.frombuffer(col[c][k].as_buffer(), dtype=t) for c, t in (("pairs", np.int64), ("runs", np.int32), ("docs", np.uint16), ("times", np.int32)))
                at = np.repeat(np.searchsorted(codes, p), runs)
                times = times.astype(np.int64)
                held, of = np.unique(doc, return_inverse=True)
                top, total = np.zeros(len(held), dtype=np.int64), np.zeros(len(held), dtype=np.int64)
                np.add.at(top, of, times * best[at]), np.add.at(total, of, times * count[at])
                keys.append(col["key"][k].as_py() + held.astype(np.int64)), n_best.append(top), sums.append(total)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, n_best, sums)], names=["key", "n_best", "count_sum"])


def align(docs: DataFrame, paths: tuple[str, str] | None = None, shards: int = SHARDS, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs: doc_id (bigint), text; other columns are ignored. A null or empty text, and one whose tokens do not spell it (characters that a
    tokenizer changes), has zeros and an empty groups_sha256, and adds nothing to the counts. Rows that repeat a doc_id, or have none, are documents of
    their own. A text of any length is taken whole, and is a task's largest piece of work. Of A ids that meet a B id equally often all are best. No docs give no row."""
    spark, paths = docs.sparkSession, paths or vocabularies()
    where = scratch(spark)
    made = postings(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), paths, shards)
    made.write.partitionBy("kind").parquet(where)
    made = spark.read.schema(made.schema).parquet(where)
    rows = made.where("kind = 0").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    post = made.where("kind = 1").select("shard", "key", "pairs", "runs", "docs", "times")
    counts = made.where("kind = 1").select("pairs", "sums").mapInArrow(_sums, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("shard", (F.shiftright("pair", 32) % shards).cast("int")))
    room = counts.groupBy("shard").agg(F.greatest(F.lit(salt_bytes), F.count("*") * (16 * COPIES)).alias("room"))
    size = post.groupBy("shard").agg(F.sum(F.octet_length("docs") * F.lit(3) + F.octet_length("pairs") + F.octet_length("runs")).alias("bytes"))
    salts = F.broadcast(written(size.join(room, "shard").select("shard", F.ceil(F.col("bytes") / F.col("room")).cast("int").alias("salts"))))  # a row per shard
    none = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    left = counts.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "pair", "n", *none("bigint", "key"), *none("binary", "pairs", "runs", "docs", "times"))
    right = post.join(salts, "shard").select("shard", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), *none("bigint", "pair", "n"), "key", "pairs", "runs", "docs", "times")
    both = left.union(right).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = both.mapInArrow(_contributions, "key bigint, n_best bigint, count_sum bigint").groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.join(found, "key", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
