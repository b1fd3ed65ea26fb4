"""What several corpus operators share: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import ship as ship_library

#: Bytes of a table (see `sized`) that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session asks for its own: each task holds some
#: batches outside the heap, and the buffers of an executor never shrink.
ARROW_BYTES = "8m"

_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Gives the executors this library, wherever the driver has it from, and keeps Arrow batches small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64MB"):  # Spark's own value
        spark.conf.set(key, ARROW_BYTES)
    ship_library(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession) -> str:
    """A new path for a scratch table in the shared folder; deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/corpus-{app}"

        def drop(root: str = _roots[app]) -> None:
            try:
                sc = spark.sparkContext
                path = sc._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # the session is gone already
                pass

        atexit.register(drop)
    return f"{_roots[app]}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: cuts the lineage, survives the loss of an executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if it holds at most `limit` bytes; else as it is, for a shuffled join (whose hot keys AQE splits).

    A row counts as 16 bytes, 8 for each column, and what its strings, binaries and arrays hold. small should be a written
    table, as it is read for its size; rows: its number of rows, if known (for numbers only)."""
    width = 16 + 8 * len(small.columns)
    more = None
    for f in small.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            each = F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            each = F.greatest(F.size(f"`{f.name}`"), F.lit(0)).cast("long") * (8 * len(f.dataType.elementType) + 16 if isinstance(f.dataType.elementType, T.StructType) else 8)
        else:
            continue
        more = each if more is None else more + each
    if more is None or rows is not None:  # of numbers, the count tells all
        held = (small.count() if rows is None else rows) * width
    else:
        held = small.agg(F.coalesce(F.sum(more + width), F.lit(0))).first()[0]
    return F.broadcast(small) if held <= limit else small.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id reachable.

    Alternating large-star and small-star steps; each round is a written table, and the number of
    rounds grows with the logarithm of a component's size. A hot id is never gathered: every step
    is a minimum by key (combined before the shuffle) joined back to the edges.
    """
    spark = edges.sparkSession
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        cur = written(small)
        # done when all is stars: each u has one v, and no v is itself a u
        row = cur.agg(F.count("*"), F.countDistinct("u")).first()
        if row[0] == row[1] and cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    pairs = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return written(pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct()))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["BROADCAST_BYTES", "StorageLevel", "components", "read", "scratch", "shared_dir", "ship", "sized", "written"]
