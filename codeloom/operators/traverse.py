"""Bounded traversals as level-by-level joins.

Each level joins the frontier with the edges, drops what was reached before by one join with all former levels, and is written, so a
plan never grows with depth and a lost executor costs one level. A small frontier is broadcast, so a level only scans the
edges; a large one is exchanged, and edges that are stored by their source (`by_source`) are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import bucketed, scratch, small, written

Children = DataFrame | Callable[[DataFrame], DataFrame]


class Levels:
    """The levels of a traversal: a folder of one table, partitioned by depth."""

    def __init__(self, first: DataFrame) -> None:
        """first: the columns of every level; depth is not among them."""
        self.spark, self.path, self.schema = first.sparkSession, scratch(first.sparkSession), first.schema
        self.last = 0

    def add(self, rows: DataFrame, depth: int) -> DataFrame:
        """Writes a level; returns it as read again. Its rows are counted as they are written (`last`)."""
        where, seen = f"{self.path}/depth={depth}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(where)
        self.last = seen.get["n"]
        return self.spark.read.schema(self.schema).parquet(where)

    def all(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("depth", T.IntegerType())])).parquet(self.path)


def by_source(edges: DataFrame) -> DataFrame:
    """edges (src, dst, ...) stored in buckets of src, so that no traversal exchanges them again."""
    return bucketed(edges, "src")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, zero: bool = True) -> DataFrame:
    """(source, node, depth): nodes within `depth` edges of each source, with the least number of edges.

    edges: src, dst; seeds: source, node. With zero the seeds are reached at depth 0; without, a seed counts
    only if a cycle leads back to it."""
    edges = edges.select(F.col("src").alias("node"), "dst")
    first = seeds.select("source", "node").distinct()
    levels = Levels(first)
    if zero:
        frontier = levels.add(first, 0)
    else:
        frontier, found = written(first), False
    for d in range(1, depth + 1):
        step = frontier.join(edges, "node").select("source", F.col("dst").alias("node")).distinct()
        if zero or found:
            step = step.join(levels.all().select("source", "node"), ["source", "node"], "left_anti")
        frontier, found = levels.add(step, d), True
        if not levels.last:
            break
    return levels.all().select("source", "node", "depth")


def reusable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(src, dst) of the edges that a walk of at most `depth` edges from the seeds (node) might use twice: those left when edges that end where none
    begins, or begin where none ends, are taken away `depth` times. All edges on cycles are among them, few others."""
    one = F.lit(0).cast("long").alias("source")
    near = reach(edges, seeds.select(one, "node"), depth).select("node")
    left = written(edges.select("src", "dst").distinct().join(near.withColumnRenamed("node", "src"), "src", "left_semi"))
    for _ in range(depth):
        n = left.count()
        left = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if left.count() == n:
            break
    return left


def lengths(edges: DataFrame, seeds: DataFrame, depth: int, state: dict[str, F.Column] | None = None, exact: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """(source, node, depth, *state): every number of edges, up to depth, of a walk from source to node.

    state: columns carried along a walk (as expressions on the frontier's and the edges' columns: dst, rel_type, via_field
    and its own former value). Distinct per level, so a level never holds more than sources x nodes x states.

    exact: only trails count, which use no edge (one row of edges) twice. A trail carries the edges it has used, but only those that could
    be used again (`reusable`), so where there are no cycles nothing is carried, and trails that used the same ones are one. Among cycles their number may
    grow with the power of depth. ends (node): only what can still reach one of these within the depth is followed, and told."""
    state = dict(state or {})
    if exact:
        again = reusable(edges, seeds, depth).withColumn("_again", F.lit(True))
        edges = written(edges.withColumn("_edge", F.monotonically_increasing_id()))  # written: an id stays what it is
        edges = edges.join(small(written(again)), ["src", "dst"], "left").withColumn("_edge", F.when(F.col("_again"), F.col("_edge"))).drop("_again")
        edges = written(edges)
        seeds = seeds.withColumn("_used", F.array().cast("array<bigint>"))
        state["_used"] = F.when(F.col("_edge").isNull(), F.col("_used")).otherwise(F.array_sort(F.array_append("_used", F.col("_edge"))))
    back = None
    if ends is not None:
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = reach(turned, ends.select(F.lit(0).cast("long").alias("source"), "node"), depth).select("node", F.col("depth").alias("_left"))
        back = small(written(back))
    e = edges.select(F.col("src").alias("node"), *[c for c in edges.columns if c != "src"])
    first = seeds.drop("depth")
    levels = Levels(first)
    frontier = levels.add(first, 0)
    for d in range(1, depth + 1):
        step = frontier.join(e, "node")
        if exact:
            step = step.where(F.col("_edge").isNull() | ~F.array_contains("_used", F.col("_edge")))
        step = step.select("source", F.col("dst").alias("node"), *(x.alias(n) for n, x in state.items()))
        if back is not None:
            step = step.join(back, "node").where(F.col("_left") + d <= depth).drop("_left")
        frontier = levels.add(step.distinct().select(first.columns), d)
        if not levels.last:
            break
    return levels.all().drop("_used").distinct() if exact else levels.all()


def simple_paths(children: Children, seeds: DataFrame, depth: int, per_parent: int | None = None, order: str = "dst") -> DataFrame:
    """(path array, node, depth): all paths without a repeated node; with per_parent, each node's children are cut to
    the first so many in the order of `order` (for display). seeds: node; children: edges (src, dst), or a function that
    gives those of the nodes (column node) it is asked for."""
    from pyspark.sql import Window

    first = seeds.select(F.array("node").alias("path"), "node")
    levels = Levels(first)
    frontier = levels.add(first, 0)
    for d in range(1, depth + 1):
        e = children(frontier.select("node").distinct()) if callable(children) else children
        step = frontier.join(e.select(F.col("src").alias("node"), "dst").distinct(), "node").where(~F.array_contains("path", F.col("dst")))
        if per_parent is not None:
            step = step.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(order))).where(F.col("rn") <= per_parent)
        frontier = levels.add(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")), d)
        if not levels.last:
            break
    return levels.all()


def on_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int, at_start: bool = True) -> DataFrame:
    """Edges on a walk of at most `depth` edges from a start to an end: those with forward distance + 1 + backward
    distance <= depth. starts, ends: node."""
    one = F.lit(0).cast("long").alias("source")
    f = reach(edges, starts.select(one, "node"), depth - 1).select(F.col("node").alias("src"), F.col("depth").alias("f"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    b = reach(back, ends.select(one, "node"), depth - 1).select(F.col("node").alias("dst"), F.col("depth").alias("b"))
    return edges.join(f, "src").join(b, "dst").where(F.col("f") + 1 + F.col("b") <= depth).select("src", "dst", F.col("f").alias("depth"))
