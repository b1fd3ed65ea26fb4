"""Best-fit packing into sequences, planned over a histogram of lengths.

Texts become token ids; each document's ids are followed by END. Documents longer than a sequence
are cut into full pieces and a last one. The plan is made from the number of pieces of each length
alone: lengths are placed from the longest down, each into the open sequences with the least
room that holds it, whole groups of alike sequences at a time. A group is split at most once
per length and room, so the plan is a table of bounded size whatever the corpus. Pieces then take
planned places by joining on their rank within their length: the plan's steps are rows keyed by blocks of ranks.

Ranks without a hot group: pieces are counted per (length, salt), the counts are summed over the
salts before each, and a piece's rank is that start plus its number within its salt. Salts grow with
the corpus; only the counts per length reach the driver.

Cost: one pass over the texts, in Arrow batches, writes a narrow row per piece; later
steps move only these rows, never a text.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, sized, written
from .words import CACHES, release

SIZE = 2048
END = 0
#: One salt for so many pieces of the corpus: the most that one task ranks, even if all had one length.
PER_SALT = 100_000
#: Distinct words whose ids a task remembers; beyond it, it starts anew.
REMEMBER = 800_000
#: Characters of texts whose words are looked up together (a longer text by itself), and words in one call of the tokenizer.
TOGETHER = 1 << 18
ASK = 1000

_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)  # tokenizers, too: workers outlive the stages of a pipeline

#: str.split() also divides at these, which the tokenizer takes as text.
_CONTROLS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")

#: Beyond these, lower case and composition may depend on each other (U+0130 becomes a letter and a mark) and are left to the tokenizer.
_CASED = re.compile("[^\x00-\u012f\u0131-\u024f]")

_PIECES = "doc_id bigint, row int, piece int, start bigint, length bigint, ids_crc32 bigint"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers. The tokenizer's rules never join what white space
    divides, so the ids of a text are those of its white-space-divided words in turn; a word's are looked up once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.remember = REMEMBER

    def _learn(self, new: list[str]) -> None:
        """Looks new words up; Latin letters and the punctuation behind them are apart for the tokenizer."""
        known, ask, parts = self.known, {}, []
        for w in new:
            core = w.rstrip(string.punctuation)
            if len(core) < len(w) and core.isalpha() and not _CASED.search(core):
                tail = w[len(core) :]
                parts.append((w, core, tail))
                if core not in known:
                    ask[core] = None
                if tail not in known:
                    ask[tail] = None
            else:
                ask[w] = None
        words = list(ask)
        for i in range(0, len(words), ASK):
            some = words[i : i + ASK]
            e = self.tok.encode(some, is_pretokenized=True, add_special_tokens=False)  # each word by itself; told apart by word_ids
            ids, at = np.array(e.ids, dtype="<u4").tobytes(), 4 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(some) + 1))
            for w, start, stop in zip(some, at[:-1].tolist(), at[1:].tolist(), strict=True):
                known[w] = ids[start:stop]
        for w, core, tail in parts:
            known[w] = known[core] + known[tail]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; the new words of all texts are looked up together."""
        known = self.known
        if len(known) > self.remember:
            known.clear()
        split = []
        for text in texts:
            if not _CASED.search(text):
                text = text.lower()  # as the tokenizer does; fewer different words
            split.append(_SPACE.split(text) if _CONTROLS.search(text) else text.split())
        new = set().union(*split).difference(known)
        if new:
            self._learn(list(new))
        for words in split:
            yield b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def encoder(path: str) -> Encoder:
    """The worker's encoder for its tasks of this operator: what it knows serves them all."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        _encoders[path] = Encoder(path)
    return _encoders[path]


def together(docs: Iterator[tuple[int | None, pa.Scalar]]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of successive documents, TOGETHER characters or little more at a time."""
    ids: list[int | None] = []
    texts: list[str] = []
    held = 0
    for doc, text in docs:
        ids.append(doc)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= TOGETHER:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, remember: int = REMEMBER) -> DataFrame:
    """Per piece: doc_id, row (which of the rows of its Arrow batch), piece, start, length, ids_crc32."""
    path = path or vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        enc = encoder(path)
        enc.remember = remember
        end = struct.pack("<I", END)
        row = 0
        for b in it:
            out: list[list] = [[], [], [], [], [], []]
            docs = zip(b.column(0).to_pylist(), b.column(1), strict=True)
            for ids, texts in together(docs):
                for doc, x in zip(ids, enc.encode_all(texts), strict=True):
                    x, row = x + end, row + 1
                    for p, s in enumerate(range(0, len(x) // 4, size)):
                        part = x[4 * s : 4 * (s + size)]
                        for c, v in zip(out, (doc, row & 0x7FFFFFFF, p, s, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Places for counts[length] pieces of each length: rows (length, first rank, number, first sequence,
    offset) give the pieces of that length with ranks from `first rank` on a place each, in as many
    successive sequences. Best fit, longest first."""
    # open sequences by room: runs (first sequence, number); all have room left
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        room = length
        while left and room < size:
            if not rooms.get(room):
                room += 1
                continue
            first, n = rooms[room].pop()
            take = min(n, left)
            out.append((length, rank, take, first, size - room))
            if take < n:
                rooms[room].append((first + take, n - take))
            rest = room - length
            if rest:
                rooms[rest].append((first, take))
            rank, left = rank + take, left - take
            if rest >= length:  # the sequences just used have the least room now
                room = rest
        per = size // length
        full, rest = divmod(left, per)
        for n, each in ((full, per), (1 if rest else 0, rest)):
            if n:
                for k in range(each):
                    out.append((length, rank, n, opened, k * length))
                    rank += n
                if size - each * length:
                    rooms[size - each * length].append((opened, n))
                opened += n
    return out


def slot_table(steps: list[tuple[int, int, int, int, int]], counts: dict[int, int]) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """The plan as tables to join on rank within length: rows (length, block, first rank, number, first sequence, offset), a
    step once for each block of ranks it reaches into, and (length, ranks in a block). The ranks of a length are cut into as many
    blocks as it has steps, so there are at most two rows per step, and a block meets few steps."""
    each: dict[int, int] = defaultdict(int)
    for step in steps:
        each[step[0]] += 1
    widths = {length: -(-counts[length] // n) for length, n in each.items()}
    slots = []
    for length, rank, n, sequence, place in steps:
        w = widths[length]
        slots += [(length, block, rank, n, sequence, place) for block in range(rank // w, (rank + n - 1) // w + 1)]
    return slots, sorted(widths.items())


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, remember: int = REMEMBER) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id (bigint), text; other columns are ignored. A null or empty text is one piece of END
    alone; rows that repeat an id (or have none) are documents of their own; no docs give no row. A text of any length is
    encoded whole and cut into pieces; a worker remembers the ids of `remember` words; pieces of equal length take places in the order of their ids."""
    spark = docs.sparkSession
    table = written(pieces(docs, path, size, remember))
    salts = 8 + table.count() // PER_SALT
    table = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "row"), F.lit(salts)))
    counted = written(table.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}  # at most a row per length
    steps = plan(counts, size)
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = table.join(sized(starts, size * salts), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    slots, widths = slot_table(steps, counts)
    width = spark.createDataFrame(widths, "length bigint, width bigint")
    slot = spark.createDataFrame(slots, "length bigint, block bigint, first bigint, number bigint, sequence bigint, place bigint")
    placed = ranked.join(sized(width, len(widths)), "length").withColumn("block", F.expr("rank div width")).join(sized(slot, len(slots)), ["length", "block"]).where("rank BETWEEN first AND first + number - 1")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("place").alias("offset"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
