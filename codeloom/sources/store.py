"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_roots: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this library (once per application), wherever the driver has it from; called wherever a Python function is sent to them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{top.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir (a local folder where that is unset and the master is local); deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spark-")
        _roots[app] = f"{root}/graph-{app}"

        def drop() -> None:
            try:
                for t in _tables.pop(app, []):
                    spark.sql(f"DROP TABLE IF EXISTS {t}")
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_roots[app])
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # the session is gone already
                pass

        atexit.register(drop)
    return f"{_roots[app]}/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a written table: cuts the lineage and survives the loss of an executor."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.select(*df.columns) if partition_by else out  # those it is parted by come last


#: Rows for which a stored table has one bucket; never fewer than BUCKETS of them.
PER_BUCKET, BUCKETS = 5_000_000, 8


def bucketed(df: DataFrame, key: str, *partition_by: str) -> DataFrame:
    """df as a stored table in buckets of key, sorted by it, with one file for each bucket and part: joins and groups on key do not exchange it. df should be
    a written table, as it is counted first. Survives as written() does."""
    spark = df.sparkSession
    n = max(BUCKETS, df.count() // PER_BUCKET)
    path = scratch(spark)
    name = f"t_{path.rsplit('/', 1)[1]}"
    # dealt as buckets are, so that each is written by one task
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name, path=path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its bytes, which are counted, are few; else unchanged. A row counts as 16 bytes, 8 for each column, and its strings."""
    each = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            each += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] <= limit else df


def clear(spark: SparkSession, path: str) -> None:
    """Empties a stored graph: every table below a folder, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
