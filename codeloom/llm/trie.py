"""The prefix trie of conversations: what they share from their first turn on.

Fingerprints. A conversation's turns, in order, are hashed, and a numpy scan over the sorted rows gives the polynomial fingerprint
of every prefix (sum of hash x BASE ** position, modulo 2 ** 64) and its code points. Rows are dealt by ranges of (conversation, turn), so a
conversation of any length spans as many tasks as it needs: each task scans its own rows, and the sums of the rows before a
task's first conversation (two rows a task) are added after. No text is moved: what travels of a turn is its SHA-256 and its length.

Nodes. Prefixes of equal depth and fingerprint are candidates for one node. Each is held, turn by turn, against the group's representative (the
smallest conversation): equal digests of the last turn, and equal keys of the prefixes without it, which were held
against theirs in the same way. A conversation that fails is given keys of its own from its first failing turn on (equal for all that go on alike), and
all is looked at again until none fails.

Rollup. A node is owned by its smallest member; what a conversation owns is the end of its path. So every figure of a
subtree is a sum over the members of its top: a member adds the code points it shares with others below the node's parent, one if it is the
first to go on from the node in a new way, and one if the leaf at its end is its own. One aggregation, combined before the shuffle,
rolls all figures up, whatever the depth; there is no step per level.

Cost: five shuffles of narrow rows (about 80 bytes a turn). Ends of a node meet as strings of at most 4096 ids (those that share all but 12 bits), and are hashed in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sized, written
from .words import U, mix, release

#: An odd base of the polynomial and its inverse modulo 2 ** 64.
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)
#: Conversations of one block share a head: that of the block's first.
BLOCK, HEADS = 100, 6
_ALL = (1 << 64) - 1


def _powers(base: int, k: np.ndarray) -> np.ndarray:
    """base ** k modulo 2 ** 64, for k >= 0."""
    out, b, k = np.ones(len(k), dtype=U), base, k.astype(U)
    while k.any():
        out = np.where(k & U(1), out * U(b & _ALL), out)
        b, k = b * b & _ALL, k >> U(1)
    return out


def _shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x * BASE ** by; by may be below 0."""
    return x * np.where(by < 0, _powers(_INVERSE, np.maximum(-by, 0)), _powers(BASE, np.maximum(by, 0)))


def _sums(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Running sums that start anew at each index of first (which begins with 0)."""
    total = np.cumsum(x)
    before = np.concatenate([np.zeros(1, dtype=x.dtype), total])[first]
    return total - np.repeat(before, np.diff(np.append(first, len(x))))


_SCAN = "part int, conv_id bigint, at bigint, fingerprint bigint, points bigint, turn_hash bigint, n bigint, digest binary"


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (conv_id, n, digest) sorted by conversation and turn: each turn's position, and fingerprint and code points up to it, from
    the task's first row of the conversation on."""
    release()
    part = TaskContext.get().partitionId()
    conv, at, poly, points = None, 0, 0, 0  # where the last batch ended
    for b in it:
        if not len(b):
            continue
        c, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
        t = mix(np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=U).reshape(-1, 4)[:, 0])
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
        head = slice(0, first[1] if len(first) > 1 else len(c)) if c[0] == conv else slice(0, 0)
        place[head] += at
        f, p = _sums(first, t * _powers(BASE, place)), _sums(first, n)
        f[head] += U(poly)
        p[head] += points
        conv, at, poly, points = c[-1], int(place[-1]) + 1, int(f[-1]), int(p[-1])
        cols = [np.full(len(c), part, dtype=np.int32), c, place, f.view(np.int64), p, t.view(np.int64), n]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), b.column(2)], names=["part", "conv_id", "at", "fingerprint", "points", "turn_hash", "n", "digest"])


def scanned(turns: DataFrame) -> DataFrame:
    """Each turn's position in its conversation, with fingerprint and code points up to it; turns: conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.char_length(text).cast("bigint").alias("n"), digest.alias("digest"), F.col("turn").alias("turn"))
    rows = rows.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    found = written(rows.mapInArrow(_scan, _SCAN))
    # of each task (two rows): a conversation that lies in several goes on from what the tasks before hold of it
    ends = found.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect()
    seen: dict[int, int] = {}
    for r in ends:
        for c in {r["low"], r["high"]}:
            seen[c] = seen.get(c, 0) + 1
    wide = [c for c, k in seen.items() if k > 1]
    if not wide:
        return found.drop("part")
    spark = turns.sparkSession
    some = F.broadcast(spark.createDataFrame([(c,) for c in wide], "conv_id bigint"))
    sums = found.join(some, "conv_id").groupBy("conv_id", "part").agg(F.max_by(F.struct("at", "fingerprint", "points"), "at").alias("x")).orderBy("conv_id", "part").collect()
    before: dict[tuple[int, int], tuple[int, int, int]] = {}
    conv = None
    for r in sums:
        if r["conv_id"] != conv:
            conv, at, poly, points = r["conv_id"], 0, 0, 0
        before[r["part"], conv] = at, poly, points
        poly = (poly + r["x"]["fingerprint"] * pow(BASE, at, 1 << 64)) & _ALL
        at, points = at + r["x"]["at"] + 1, points + r["x"]["points"]

    def carried(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            part, c, at, f, p = (b.column(i).to_numpy() for i in range(5))
            at, f, p = at.copy(), f.view(U).copy(), p.copy()
            for key in before:
                k = np.flatnonzero((part == key[0]) & (c == key[1]))
                if len(k):
                    a, x, y = before[key]
                    f[k] = U(x) + f[k] * U(pow(BASE, a, 1 << 64))
                    at[k] += a
                    p[k] += y
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at), pa.array(f.view(np.int64)), pa.array(p), *(b.column(i) for i in (5, 6, 7))], names=["conv_id", "at", "fingerprint", "points", "turn_hash", "n", "digest"])

    own = F.broadcast(spark.createDataFrame([(p, c) for p, c in before], "part int, conv_id bigint"))
    moved = found.join(own, ["part", "conv_id"], "left_semi").mapInArrow(carried, _SCAN.removeprefix("part int, "))
    return written(found.join(own, ["part", "conv_id"], "left_anti").drop("part").unionByName(moved))


_KEYED = "conv_id bigint, size bigint, depth bigint, key bigint, prev bigint, n bigint, points bigint, d0 bigint, d1 bigint, d2 bigint, d3 bigint"


def _keyed(bits: int):
    """From rows (conv_id, size, depth, shift, fingerprint, cut, base, turn_hash, n, points, digest): the keys of the prefix with and without its last turn."""
    mask = U((1 << bits) - 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in it:
            if not len(b):
                continue
            conv, size, depth, shift, f, cut, base, t, n, points = (b.column(i).to_numpy() for i in range(10))
            f = base.view(U) + _shifted(f.view(U) - cut.view(U), shift)
            last = f - t.view(U) * _powers(BASE, np.maximum(depth - 1, 0))
            key, prev = ((mix(x + U(0x9E3779B97F4A7C15)) & mask).view(np.int64) for x in (f, last))
            d = np.frombuffer(b"".join(b.column(10).to_pylist()), dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, size, depth, key, prev, n, points, *np.ascontiguousarray(d.T))], names=[c.split()[0] for c in _KEYED.split(", ")])

    return run


def rebuilt(found: DataFrame, block: int = BLOCK, heads: int = HEADS, bits: int = 64) -> DataFrame:
    """A row for each prefix, the empty one too, of every rebuilt conversation (size: its turns): depth, keys, last turn's digest and code points,
    and code points so far."""
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    one = found.groupBy("conv_id").agg(F.max("at").alias("last"), F.max(F.when(F.col("at") == h - 1, F.col("fingerprint"))).alias("cut"), F.max(F.when(F.col("at") == h - 1, F.col("points"))).alias("cut_points"))
    turn = F.struct("at", "fingerprint", "points", "turn_hash", "n", "digest")
    head = found.where((F.col("conv_id") % block == 0) & (F.col("at") < heads - 1)).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    conv = one.withColumn("first", F.col("conv_id") - F.col("conv_id") % block).join(head, "first", "left").withColumn("h", h)
    conv = conv.withColumn("hb", F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.least("h", F.size("head").cast("long"))).cast("long"))
    top = F.get("head", (F.col("hb") - 1).cast("int"))
    conv = conv.select("conv_id", "h", "hb", (F.col("hb") + F.greatest(F.col("last") + 1 - F.col("h"), F.lit(0))).alias("size"), F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("cut_points", F.lit(0)).alias("cut_points"), F.coalesce(top["fingerprint"], F.lit(0)).alias("base"), F.coalesce(top["points"], F.lit(0)).alias("base_points"), F.slice("head", F.lit(1), F.col("hb").cast("int")).alias("head"))
    conv = written(conv)
    zero = lambda *names: [F.lit(0).cast("bigint").alias(c) for c in names]
    own = found.where(F.col("at") >= h).join(conv.drop("head"), "conv_id").select("conv_id", "size", (F.col("at") - F.col("h") + F.col("hb") + 1).alias("depth"), (F.col("hb") - F.col("h")).alias("shift"), "fingerprint", "cut", "base", "turn_hash", "n", (F.col("base_points") + F.col("points") - F.col("cut_points")).alias("points"), "digest")
    lent = conv.select("conv_id", "size", F.explode("head").alias("t")).select("conv_id", "size", (F.col("t.at") + 1).alias("depth"), *zero("shift"), "t.fingerprint", *zero("cut", "base"), "t.turn_hash", "t.n", "t.points", "t.digest")
    root = conv.select("conv_id", "size", *zero("depth", "shift", "fingerprint", "cut", "base", "turn_hash", "n", "points"), F.unhex(F.lit("00" * 32)).alias("digest"))
    return written(own.unionByName(lent).unionByName(root).mapInArrow(_keyed(bits), _KEYED))


_TURN = ("prev", "d0", "d1", "d2", "d3")


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes (depth, key, owner, deepest)): rows with keys that are equal for equal prefixes only."""
    while True:
        same = [F.min(c).alias(f"low_{c}") for c in _TURN] + [F.max(c).alias(f"high_{c}") for c in _TURN]
        nodes = written(rows.groupBy("depth", "key").agg(F.min("conv_id").alias("owner"), F.max("size").alias("deepest"), *same))
        mixed = nodes.where(" OR ".join(f"low_{c} <> high_{c}" for c in _TURN)).select("depth", "key", "owner")
        if mixed.isEmpty():
            return rows, nodes.select("depth", "key", "owner", "deepest")
        # candidates that differ from their representative take other keys from there on
        mixed = sized(written(mixed))
        held = written(rows.join(mixed, ["depth", "key"]))
        like = held.where("conv_id = owner").select("depth", "key", *(F.col(c).alias(f"its_{c}") for c in _TURN))
        bad = held.join(sized(written(like)), ["depth", "key"]).where(" OR ".join(f"{c} <> its_{c}" for c in _TURN))
        bad = bad.groupBy("conv_id").agg(F.min(F.struct("depth", F.xxhash64("key", *_TURN).alias("salt"))).alias("x")).select("conv_id", F.col("x.depth").alias("from"), "x.salt")
        other = lambda c, at: F.when(F.col("depth") >= at, F.xxhash64(c, "salt")).otherwise(F.col(c)).alias(c)
        rows = written(rows.join(sized(written(bad)), "conv_id", "left").select("conv_id", "size", "depth", other("key", F.col("from")), other("prev", F.col("from") + 1), "n", "points", "d0", "d1", "d2", "d3"))


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (owner, depth, ids) sorted by owner, depth and chunk: the SHA-256 of each node's ids. Holds one row."""
    release()
    now, state = None, None
    for b in it:
        out: list[tuple[int, int, str]] = []
        for o, d, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (o, d) == now:
                state.update(b"," + ids.encode())
                continue
            if now:
                out.append((*now, state.hexdigest()))
            now, state = (o, d), hashlib.sha256(ids.encode())
        yield _told(out)
    if now:
        yield _told([(*now, state.hexdigest())])


def _told(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    o, d, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], names=["owner", "depth", "ends_sha256"])


def trie(turns: DataFrame, block: int = BLOCK, heads: int = HEADS, bits: int = 64) -> DataFrame:
    """Per node of the prefix trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id (bigint), turn, role, text; other columns are ignored. A conversation c is rebuilt from the first h = crc32(c) % heads turns of
    conversation c - c % block and its own turns after its first h. A null turn comes first; turns of the same number follow
    the SHA-256 of their role and text; repeated rows are turns of their own. A null role or text is empty. Rows without a
    conv_id are no conversation; no turns give no row, not even the root. Conversations and texts of any length are taken whole.
    bits: bits of the fingerprints' keys, fewer for tests of collisions."""
    rows, nodes = verified(rebuilt(scanned(turns), block, heads, bits))
    placed = written(rows.select("conv_id", "size", "depth", "key", "n", "points").join(nodes, ["depth", "key"]).drop("key"))
    other = F.col("owner") != F.col("conv_id")
    # where a conversation leaves what smaller ones have: owners and code points never fall along a path
    of = placed.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(other, F.col("depth"))), F.lit(-1)).alias("shared"),
        F.coalesce(F.max(F.when(other, F.col("points"))), F.lit(0)).alias("shared_points"),
        F.max(F.when(other, F.col("owner"))).alias("above"),
        F.max((~other & (F.col("depth") == F.col("size")) & (F.col("deepest") == F.col("size"))).cast("long")).alias("leaf"),
        F.max(F.when(F.col("depth") == F.col("size"), F.col("owner"))).alias("end"),
        F.max("size").alias("end_depth"),
    )
    of = written(of)
    member = placed.join(of.select("conv_id", "shared", "shared_points", "above", "leaf"), "conv_id")
    node = member.groupBy("owner", "depth").agg(
        F.max(F.when(~other & (F.col("depth") > 0), F.when(F.col("depth") - 1 > F.col("shared"), F.col("conv_id")).otherwise(F.col("above")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("shared") <= F.col("depth")) & (F.col("depth") < F.col("size"))).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("shared") >= F.col("depth"), F.col("shared_points") - F.col("points") + F.col("n")).otherwise(0)).alias("saved_tokens"),
    )
    ends = of.groupBy(F.col("end").alias("owner"), F.col("end_depth").alias("depth"), F.shiftright("conv_id", 12).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk").select("owner", "depth", "ids").mapInArrow(_hashed, "owner bigint, depth bigint, ends_sha256 string")
    out = node.join(ends, ["owner", "depth"], "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


SQL = {
    "op11_trie": r"""
WITH RECURSIVE s AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS x
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(conv_id, rest, c) AS (SELECT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM s
 UNION ALL SELECT conv_id, rest[2:], list_reduce(list_concat([xor(c, CAST(ascii(rest[1]) AS BIGINT))], range(8)), lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) FROM crc WHERE rest <> ''),
h AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crc WHERE rest = ''),
r AS (SELECT s.conv_id, list_concat(coalesce(b.x[1:h.h], []), s.x[h.h + 1:]) AS x FROM s JOIN h USING (conv_id) LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % 100),
p AS (SELECT conv_id, len(x) AS size, d, x[1:d] AS k, x[1:d - 1] AS up FROM (SELECT *, unnest(range(0, len(x) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends,
 CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(k[d].t) END AS saved FROM p GROUP BY k, d),
c AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
t AS (SELECT a.k, a.d, sum(b.saved) AS saved_tokens, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.up = b.k AND c.d = b.d)) AS n_leaves FROM n b, unnest(range(0, b.d + 1)) AS u(e) JOIN n a ON a.d = u.e AND a.k = b.k[1:u.e] GROUP BY a.k, a.d)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN t ON t.k = n.k AND t.d = n.d LEFT JOIN c ON c.up = n.k AND c.d = n.d LEFT JOIN n q ON n.d > 0 AND q.d = n.d - 1 AND q.k = n.up"""
}
