"""Near-duplicate vectors by collision-counting projections.

Vectors are scaled to length 1 in double precision and projected on many random directions. A pair
collides in a projection if the other value lies in a window centred on the query's value; the window is
as wide as WIDTH standard deviations of the difference that a pair at the threshold has. The count
of collisions over all projections follows a binomial law for such a pair, and the count a pair must
pass is the law's quantile that loses at most 1 - RECALL of them. Pairs that pass are verified by their cosine.

Sorting every projection and walking its windows would visit a fixed share of all pairs, so the
projections are also used to sort the vectors into cells first: each of `tables` cells is given by the signs
of `bits` of them (a table per group of bits), and windows are walked inside cells. bits grows
with the logarithm of the number of vectors, and tables is what keeps the chance that a pair at the
threshold shares no cell below 1 - RECALL. A pair that shares several cells is counted in the first.

Cost: exact repeats are taken once. A vector is sent once per table, in the type it came in, with the numbers of its cells; projections are made
anew where they are compared. Cells larger than BLOCK are split
into blocks, and each pair of blocks is a task's work of bounded size; from each comes a row per
vector (its number of links and one link that keeps the block's components), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, sized, written

THRESHOLD = 0.95
RECALL = 0.998
PROJECTIONS = 32
WIDTH = 2.0
BLOCK = 1024
#: Vectors in a cell, if they were spread evenly.
CELL = 512
SEED = 20240607


def tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): cells of about CELL vectors if they were spread evenly; tables enough for the recall."""
    bits = max(2, ceil(log2(max(n, 1) / CELL)))
    same = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - same)))


def least_collisions(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The most collisions that a pair at the threshold reaches with probability `recall` at least."""
    from math import erf

    p = erf(width / sqrt(2))
    below = 0.0
    for c in range(projections + 1):
        below += comb(projections, c) * p**c * (1 - p) ** (projections - c)
        if below > 1 - recall:
            return c
    return projections


def units(v: np.ndarray) -> np.ndarray:
    """Rows (finite, none of them zero) scaled to length 1 in double precision."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(d: int, bits: int, n_tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The random directions for vectors of d numbers: (of the cells, of the windows)."""
    r = np.random.default_rng([SEED, d])
    cells, windows = r.standard_normal((d, bits * n_tables)), r.standard_normal((d, PROJECTIONS))
    return cells, windows / np.linalg.norm(windows, axis=0)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items and links (a, b): the smallest item of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id (smallest vec_id reachable by links), kept.

    vectors: vec_id (bigint), embedding (array of numbers); other columns are ignored. Vectors that are
    null, empty, zero, or hold null or non-finite numbers link with nothing; vectors of different
    lengths never link, however long they are; pairs at exactly the threshold do. A null vec_id has no links and null component_id and kept. Rows that repeat a vec_id are taken
    as further vectors: their links add up, and their component is the id's. No vectors give no row."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    ok = ids.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    keyed = written(ok.withColumn("h", F.xxhash64("v")).withColumn("g", F.hash("v")))
    # rep is the number of a distinct vector (different vectors may have one vec_id), low its smallest vec_id
    one = written(keyed.groupBy("h", "g").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    reps = keyed.join(sized(one), ["h", "g"]).where("vec_id = low").dropDuplicates(["rep"]).select("rep", "copies", "v")
    n = one.count()
    bits, n_tables = tables(n, threshold)
    passing = least_collisions()

    def project(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for df in it:
            for d, part in df.groupby(df["v"].map(len)):
                if d not in known:
                    known[d] = directions(d, bits, n_tables)[0]
                sign = (units(np.vstack(part["v"])) @ known[d] > 0).reshape(len(part), n_tables, bits)
                code = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "dim": d, "codes": list(code.astype(np.int32)), "v": part["v"]})

    rows = written(reps.mapInPandas(project, f"rep bigint, copies bigint, dim int, codes array<int>, v array<{kind}>"))
    cell = rows.select("rep", "dim", F.posexplode("codes").alias("t", "code"))
    size = written(cell.groupBy("dim", "t", "code").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    # block i of a cell goes to every pair of blocks (i, j) and (j, i)
    of = rows.select("rep", "copies", "dim", "codes", "v", F.posexplode("codes").alias("t", "code")).join(sized(size), ["dim", "t", "code"])
    of = of.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = of.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks", "m")

    def count(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        d, t, _, i, j = key
        v = units(np.vstack(df["v"]))
        p = (v @ directions(d, bits, n_tables)[1]).astype(np.float32)
        codes, rep, copies, own = np.vstack(df["codes"]), df["rep"].to_numpy(), df["copies"].to_numpy(), df["own"].to_numpy()
        width = np.float32(WIDTH * sqrt((2 - 2 * threshold) / d))
        left, right = [], []
        order = np.argsort(p[:, 0], kind="stable")  # sorted by one projection: its window bounds each query's candidates
        p0 = p[order, 0]
        spread = np.float32(3.5 * sqrt((2 - 2 * threshold) / d))
        for a in range(0, len(order), 128):
            q = order[a : a + 128]
            hi = int(np.searchsorted(p0, p0[min(a + 127, len(p0) - 1)] + spread, "right"))
            c = order[a:hi]
            hits = np.zeros((len(q), len(c)), dtype=np.uint8)
            for k in range(PROJECTIONS):
                hits += np.abs(p[q, k][:, None] - p[c, k][None, :]) <= width
            ok = hits >= passing
            ok &= np.arange(len(c))[None, :] > np.arange(len(q))[:, None]
            x, y = np.nonzero(ok)
            x, y = q[x], c[y]
            if i != j:
                keep = own[x] != own[y]
                x, y = x[keep], y[keep]
            if t:  # counted in the first table in which they share a cell
                keep = ~(codes[x, :t] == codes[y, :t]).any(axis=1)
                x, y = x[keep], y[keep]
            for s in range(0, len(x), 4096):
                cos = np.einsum("ij,ij->i", v[x[s : s + 4096]], v[y[s : s + 4096]])
                good = cos >= threshold
                left.append(x[s : s + 4096][good]), right.append(y[s : s + 4096][good])
        x = np.concatenate(left) if left else np.empty(0, dtype=np.int64)
        y = np.concatenate(right) if right else np.empty(0, dtype=np.int64)
        links = np.zeros(len(rep), dtype=np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        by_id = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), dtype=np.int64)
        place[by_id] = np.arange(len(rep))
        root = rep[by_id][_roots(len(rep), place[x], place[y])][place]
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    found = written(of.groupBy("dim", "t", "code", "i", "j").applyInPandas(count, "rep bigint, links bigint, root bigint"))
    links = written(found.groupBy("rep").agg(F.sum("links").alias("links")))
    # the vectors of one vec_id belong together
    twice = keyed.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    of_id = written(keyed.join(sized(written(twice)), "vec_id", "left_semi").join(sized(one.select("h", "g", "rep")), ["h", "g"]).select("vec_id", "rep").distinct())
    same = of_id.join(sized(written(of_id.groupBy("vec_id").agg(F.min("rep").alias("b")))), "vec_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(same))
    per = written(one.join(sized(links), "rep", "left").join(sized(comp.withColumnRenamed("id", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    per = per.join(sized(written(per.groupBy("component").agg(F.min("low").alias("component_id")))), "component")
    per = per.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = keyed.join(sized(written(per), n), ["h", "g"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    known = written(known)
    out = ids.select("vec_id").join(sized(known.withColumnRenamed("vec_id", "_id")), F.col("vec_id") == F.col("_id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(read(spark, sf_dir, "embeddings"))


SQL = {
    "op2_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec_id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id) JOIN (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id) c USING (vec_id)"""
}
