"""Exact deduplication over an index of live digests behind cuckoo filters.

Texts are equal when they are identical after every run of white space [\\x20\\x09-\\x0D] became one space; a digest is the SHA-256
of that. The index deals digests to shards. Of each shard it stores a cuckoo filter (16-bit fingerprints, four to a
bucket, two buckets to a digest) and, in buckets of the shard, the live keys: a log of (key, doc_id, change), so the smallest live id of
a key is known again when another is deleted.

Insertion. Rows are combined by key as soon as they are read (Arrow batches), so thousands of copies of one text travel as a row per batch. Each shard's
rows stream past its filter: a digest the filter does not know is certainly new, and is put in; any other is a hit, which proves
nothing yet. Only hits are joined with the stored keys: those found there are copies, those not found are false positives and are put in as well.
The copies' texts are then compared, and texts that differ all the same become groups of their own.

Overflow. A filter in which a fingerprint finds no place after KICKS moves is rebuilt with twice the buckets from the shard's stored keys.
Deletion takes a fingerprint out when the last live row of its digest goes; only digests found in the log are deleted.

Cost: one pass over the texts makes digests; 50 bytes a row are shuffled. A second pass reads texts again to compare those of hits: they are moved
if their keys are few (broadcast), else all texts are dealt by key. A hot key is one row of keys against rows that AQE may split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, sized, written
from .words import U, mix, release

#: Keys of one shard at most, as expected when an index is made.
PER_SHARD = 512
SLOTS, KICKS = 4, 200
#: Share of a new filter's slots that may be taken.
LOAD = 0.8


class CuckooFilter:
    """A cuckoo filter of 64-bit digests as one numpy table (buckets x SLOTS); 0 marks a free slot."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def of(cls, n: int) -> CuckooFilter:
        """An empty filter with room for n digests."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of each digest."""
        h = mix(digests)
        mark = (h >> U(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & U(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(mark, first)

    def other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint that lies in bucket."""
        return bucket ^ (mix(mark.astype(U)) & U(len(self.table) - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(digests)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)

    def _put(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of the buckets; returns which found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        free = self.table[b] == 0
        ok = rank < free.sum(axis=1)
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[b[ok], slot[ok]] = mark[order][ok]
        done = np.zeros(len(mark), dtype=bool)
        done[order] = ok
        return done

    def insert(self, digests: np.ndarray) -> bool:
        """Puts digests in; False if one found no place (the filter then has to be made anew)."""
        mark, first, second = self.places(digests)
        left = ~self._put(mark, first)
        mark, second = mark[left], second[left]
        if len(mark):
            left = ~self._put(mark, second)
            mark, bucket = mark[left], second[left]
            for k in range(KICKS):
                if not len(mark):
                    break
                one, at = np.unique(bucket, return_index=True)  # one fingerprint pushes another out of each bucket
                rest = np.ones(len(mark), dtype=bool)
                rest[at] = False
                out = self.table[one, k % SLOTS].copy()
                self.table[one, k % SLOTS] = mark[at]
                to = self.other(out, one)
                left = ~self._put(out, to)
                mark, bucket = np.concatenate([mark[rest], out[left]]), np.concatenate([bucket[rest], to[left]])
        return not len(mark)

    def delete(self, digests: np.ndarray) -> None:
        """Takes one fingerprint of each digest out; every digest must have been put in."""
        for m, i, j in zip(*self.places(digests), strict=True):
            for b in (i, j):
                at = np.flatnonzero(self.table[b] == m)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def _head(keys: pa.Array) -> np.ndarray:
    """The first 8 bytes of each key as numbers; all keys have one length, shorter ones are filled up."""
    _, off, data = keys.cast(pa.binary()).buffers()
    off = np.frombuffer(off, dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1]
    size = int(off[1] - off[0])
    out = np.zeros((len(keys), 8), dtype=np.uint8)
    out[:, : min(size, 8)] = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].reshape(-1, size)[:, :8]
    return out.view(U).ravel()


def _combined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, key, doc_id, n): the rows of a batch by key, with the smallest id."""
    release()
    for b in it:
        t = pa.Table.from_batches([b]).group_by(["shard", "key"]).aggregate([("doc_id", "min"), ("n", "sum")])
        t = pa.table({"shard": t["shard"], "key": t["key"], "doc_id": t["doc_id_min"].cast(pa.int64()), "n": t["n_sum"].cast(pa.int64())})
        yield from t.combine_chunks().to_batches()


#: Rows that pass a shard's filter, in this order.
FILTER, STORED, DELETED, ROW = range(4)
_OUT = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hit", pa.bool_())])


def _pass(whole: bool):
    """Rows sorted by shard and kind pass the shard's filter. Out come the rows with `hit`, and the filter as it is then (kind FILTER).

    whole: the stored keys are among the rows (or there are none), so that a filter can be rebuilt; else a shard whose filter overflows gives
    one row of kind FILTER without a filter, and its rows unmarked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shard, own, full, held = None, None, False, []

        def put(new: np.ndarray) -> None:
            nonlocal own, full
            if full or not len(new):
                return
            held.append(new)
            size = 2 * own.table.size
            while not own.insert(new):
                if not whole:
                    full = True
                    return
                every = np.concatenate(held)
                own, new, size = CuckooFilter.of(max(size * LOAD, len(every))), every, size * 2

        def last() -> Iterator[pa.RecordBatch]:
            if shard is not None and own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, FILTER, None if full else own.table.tobytes(), None, None, None), _OUT, strict=True)], schema=_OUT)

        for b in it:
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])]))
            for i, j in zip(edges, [*edges[1:], len(b)], strict=True):
                if at[i] != shard:
                    yield from last()
                    shard, own, full, held = int(at[i]), None, False, []
                part = b.slice(i, j - i)
                if kind[i] == FILTER:
                    own = CuckooFilter.read(part.column(2)[0].as_py())
                    continue
                own = own or CuckooFilter.of(PER_SHARD)
                heads = _head(part.column(2))
                if kind[i] == STORED:
                    put(heads)
                elif kind[i] == DELETED:
                    own.delete(heads)
                else:
                    hit = own.contains(heads)
                    _, first = np.unique(heads, return_index=True)
                    new = np.zeros(len(heads), dtype=bool)
                    new[first] = True
                    new &= ~hit
                    put(heads[new])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), part.column(4), pa.array(~new, pa.bool_())], schema=_OUT)
        yield from last()

    return run


def normal(text: str = "text") -> F.Column:
    """A text with every run of white space as one space; null as an empty one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, size: int = 32) -> DataFrame:
    """doc_id, sha (SHA-256 of the normal text), key (its first `size` bytes)."""
    sha = F.unhex(F.sha2(normal(), 256))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sha.alias("sha"))
    return out.withColumn("key", F.substring("sha", 1, size))


class CuckooIndex:
    """An index of live digests in a folder: v=N/filter (shard, key: the filter's bytes), v=N/meta.json (shards), and log/b=N, the changes of each batch.

    A version is complete when its meta.json is there, which is written last; a batch that failed half-way leaves the version
    before it as it was. Filters are read and written whole (about 2.5 bytes a digest); of the log a batch reads what its hits need."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath() for s in self.fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/meta.json")) or []]
        self.version = max((int(p.getParent().getName().split("=")[1]) for p in done), default=0)
        self.shards = json.loads(spark.read.text(f"{path}/v={self.version}/meta.json").first()[0])["shards"] if self.version else 0

    def _finish(self, version: int) -> None:
        out = self.fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version}/meta.json"), True)
        out.write(json.dumps({"shards": self.shards}).encode())
        out.close()
        self.version = version

    def _filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, key binary")
        return self.spark.read.schema("shard int, key binary").parquet(f"{self.path}/v={self.version}/filter")

    def log(self) -> DataFrame:
        """(shard, key, doc_id, n): every change so far; n rows of an id came (or, below 0, went)."""
        if not self.version:
            return self.spark.createDataFrame([], "shard int, key binary, doc_id bigint, n bigint")
        where = [f"{self.path}/log/b={v}" for v in range(1, self.version + 1)]
        return self.spark.read.schema("shard int, key binary, doc_id bigint, n bigint").parquet(*where)

    def live(self) -> DataFrame:
        """(shard, key, keep_id, group_size): the digests that have live rows. Of ids, null comes last."""
        rows = self.log().groupBy("shard", "key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        return rows.groupBy("shard", "key").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))

    def _dealt(self, keys: DataFrame) -> DataFrame:
        """Rows (key, doc_id, n) with their shard."""
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def _through(self, rows: DataFrame, filters: DataFrame, stored: DataFrame | None) -> DataFrame:
        """rows (shard, kind, key, doc_id, n) past the filters; stored: (shard, key), with which overflowing filters are rebuilt."""
        none = F.lit(None).cast("bigint")
        both = rows.select("shard", "kind", "key", "doc_id", "n")
        both = both.unionByName(filters.select("shard", F.lit(FILTER).alias("kind"), "key", none.alias("doc_id"), none.alias("n")))
        if stored is not None:
            both = both.unionByName(stored.select("shard", F.lit(STORED).alias("kind"), "key", none.alias("doc_id"), none.alias("n")))
        dealt = both.repartition("shard").sortWithinPartitions("shard", "kind")
        return written(dealt.mapInArrow(_pass(stored is not None or not self.version), "shard int, kind int, key binary, doc_id bigint, n bigint, hit boolean"))

    def insert(self, keys: DataFrame) -> DataFrame:
        """Takes rows (key, doc_id) in; returns (key, keep_id, group_size) of those keys that have another row, old or new.

        keys should be a written table, as it is read several times; the number of its rows fixes the number of shards of a new index."""
        if not self.shards:
            self.shards = max(1, -(-keys.count() // PER_SHARD))
        rows = self._dealt(keys.select("key", "doc_id", F.lit(1).cast("bigint").alias("n"))).select("shard", "key", "doc_id", "n")
        dealt = rows.mapInArrow(_combined, "shard int, key binary, doc_id bigint, n bigint").withColumn("kind", F.lit(ROW))
        old = self.log()
        seen = self._through(dealt, self._filters(), None)
        full = seen.where("kind = 0 AND key IS NULL").select("shard")
        if self.version and not full.isEmpty():  # rebuilt from the stored keys
            full = F.broadcast(full)  # a row per shard
            again = seen.where(f"kind = {ROW}").join(full, "shard", "left_semi")
            again = self._through(again, self._filters().limit(0), self.live().join(full, "shard", "left_semi"))
            seen = written(seen.join(full, "shard", "left_anti").unionByName(again))
        new = seen.where(f"kind = {ROW}").select("shard", "key", "doc_id", "n", "hit")
        hits = written(new.where("hit OR n > 1").select("shard", "key").distinct())
        known = sized(hits)
        # what a hit is held against: the stored keys and the new ones, but for itself
        there = old.join(known, ["shard", "key"], "left_semi").groupBy("shard", "key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        there = there.unionByName(new.join(known, ["shard", "key"], "left_semi").drop("hit"))
        groups = written(there.groupBy("shard", "key").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
        copies = groups.where("group_size > 1")
        # hits whose key is not stored are false positives; each is a digest more in its filter
        missing = new.join(known, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.bool_and("hit").alias("unseen")).where("unseen").select("shard", "key")
        if self.version:
            missing = missing.join(self.live().join(known, ["shard", "key"], "left_semi").select("shard", "key"), ["shard", "key"], "left_anti")
        filters = seen.where("kind = 0 AND key IS NOT NULL").select("shard", "key")
        kept = self._filters().join(filters.select("shard"), "shard", "left_anti")
        filters = self._add(filters.unionByName(kept), written(missing), new)
        version = self.version + 1
        filters.write.mode("overwrite").parquet(f"{self.path}/v={version}/filter")
        # in ranges of shard and key, so that a batch's hits find theirs by the files' statistics
        rows.repartitionByRange("shard", "key", "doc_id").sortWithinPartitions("shard", "key").write.mode("overwrite").parquet(f"{self.path}/log/b={version}")
        self._finish(version)
        return copies.select("key", "keep_id", "group_size")

    def _add(self, filters: DataFrame, missing: DataFrame, new: DataFrame) -> DataFrame:
        """filters with further digests (shard, key) in them; those that overflow are rebuilt from all keys of their shard."""
        if missing.isEmpty():
            return filters
        shards = F.broadcast(missing.select("shard").distinct())  # at most a row per shard
        stored = self.live().select("shard", "key").unionByName(new.select("shard", "key")).distinct().join(shards, "shard", "left_semi")
        made = self._through(missing.limit(0).select("shard", F.lit(ROW).alias("kind"), "key", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n")), filters.limit(0), stored)
        return filters.join(shards, "shard", "left_anti").unionByName(made.where("kind = 0").select("shard", "key"))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Takes rows (key, doc_id) out; those that are not live are left alone. Returns the (key, doc_id) that were. A digest without a live
        row leaves its filter."""
        version = self.version + 1
        live = self.log().groupBy("shard", "key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        gone = keys.groupBy("key", "doc_id").agg(F.count("*").alias("m"))
        gone = written(live.join(gone.select("key", F.col("doc_id").alias("d"), "m"), (live["key"] == gone["key"]) & F.col("doc_id").eqNullSafe(F.col("d"))).select("shard", live["key"], "doc_id", (-F.least("n", "m")).alias("n")))
        touched = sized(written(gone.select("shard", "key").distinct()))
        left = live.unionByName(gone).join(touched, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.sum("n").alias("n"))
        empty = left.where("n = 0").select("shard", F.lit(DELETED).alias("kind"), "key", F.lit(None).cast("bigint").alias("doc_id"), "n")
        shards = F.broadcast(written(empty.select("shard").distinct()))  # at most a row per shard
        filters = self._filters()
        made = self._through(empty, filters.join(shards, "shard", "left_semi"), None).where("kind = 0").select("shard", "key")
        filters.join(shards, "shard", "left_anti").unionByName(made).write.mode("overwrite").parquet(f"{self.path}/v={version}/filter")
        gone.write.mode("overwrite").parquet(f"{self.path}/log/b={version}")
        self._finish(version)
        return gone.select("key", "doc_id")

    def maybe(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters may hold (some are false positives); all others are certainly not live."""
        rows = self._dealt(keys.select("key").distinct()).select("shard", F.lit(ROW).alias("kind"), "key", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("n"))
        return self._through(rows, self._filters(), None).where(f"kind = {ROW} AND hit").select("key")


def dedup(docs: DataFrame, path: str | None = None, size: int = 32) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id (bigint), text; other columns are ignored. A null text is equal to an empty one; nothing is trimmed, so a leading space counts.
    Of equal texts the rows with the smallest doc_id stay (each of them, if rows repeat it); a null id comes after all others, and rows with it stay
    only if no other id has the text. A text of any length is taken whole; no docs give no row.

    path: a folder for the index (new; a scratch one if None). size: bytes of the digest that the index knows, for tests of collisions."""
    spark = docs.sparkSession
    narrow = written(digests(docs, size))
    index = CuckooIndex(spark, path or scratch(spark))
    groups = written(index.insert(narrow))
    # the texts of hits: all of a key are equal if the least and the greatest are, which tasks find for their rows before any text moves
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal().alias("norm")).withColumn("key", F.substring(F.unhex(F.sha2("norm", 256)), 1, size)).join(sized(groups.select("key")), "key", "left_semi")
    differ = written(texts.groupBy("key").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("key"))
    out = narrow.join(sized(groups), "key", "left").select("doc_id", "key", "sha", "keep_id", F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("group_size").isNull().alias("alone"))
    out = out.withColumn("keep_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("keep_id")))
    if not differ.isEmpty():  # texts that share a digest: groups by text
        split = texts.join(sized(differ), "key", "left_semi").withColumn("sha", F.unhex(F.sha2("norm", 256))).groupBy("key", "sha", "norm").agg(F.min("doc_id").alias("k"), F.count("*").alias("g")).select("key", "sha", "k", "g")
        out = out.join(sized(written(split)), ["key", "sha"], "left").withColumn("keep_id", F.when(F.col("g").isNotNull(), F.col("k")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("g", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))


SQL = {
    "op12_exact": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM d WINDOW w AS (PARTITION BY x)"""
}
