"""Incremental ingestion of source files: a stream of files whose batches are extracted and merged.

New files in a drop folder, or changed blobs of a git repository, are read once each, their Java facts extracted, and what the files declare put in
the place of what they declared before. Types and methods lie in one store, dealt to parts by file, so a batch reads and writes the
parts of its files only, and both tables change at once. The store's manifest names the last batch, so a batch that runs again
after a failure changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import java
from ..sources.durable import GraphStore
from ..sources.store import written

FILES = "project string, path string, content string, modified_time timestamp"
#: The column that tables are dealt by: two projects may have files of one path.
BY = "file"
#: Versions that stay when a batch is merged.
KEEP = 3


def _file(project: str, path: str) -> F.Column:
    return F.concat_ws(":", project, path).alias(BY)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """A table (store/name) as of the newest version, or None."""
    store, name = path.rsplit("/", 1)
    found = GraphStore(spark, store)
    return found.read(name) if name in found.tables else None


def merge_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Puts what the batch's files declare in the tables types and methods of a store. A file without content is gone."""
    spark = batch.sparkSession
    graph = GraphStore(spark, store)
    if graph.manifest["notes"].get("batch", -1) >= batch_id:
        return
    last = written(batch.groupBy("project", "path").agg(F.max_by("content", "modified_time").alias("content")))
    facts = java.extract(last.where("content IS NOT NULL"))
    of = facts.types.select(F.col("fqn").alias("class_fqn"), "file_path").distinct()
    tables = {"types": facts.types, "methods": facts.methods.join(of, "class_fqn")}
    tables = {name: df.select("*", _file("project", "file_path")).withColumn("batch", F.lit(batch_id).cast("long")) for name, df in tables.items()}
    if not graph.version:
        graph.commit({name: (df, BY) for name, df in tables.items()}, notes={"batch": batch_id})
    else:
        graph.replace(tables, last.select(_file("project", "path")), {"batch": batch_id})
    graph.expire(KEEP)


def ingest(spark: SparkSession, drop: str, store: str, checkpoint: str):
    """Starts a query over Parquet files of source texts (FILES) in `drop`; ends when all that is there is merged."""
    files = spark.readStream.schema(FILES).parquet(drop)
    return files.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_git(spark: SparkSession, repo: str, project: str, store: str, checkpoint: str, branch: str = "HEAD"):
    """Starts a query over the commits of a repository: each batch holds the blobs that changed, and files that went (content null)."""
    from ..sources.git import register

    register(spark)
    files = spark.readStream.format("git").option("repo", repo).option("branch", branch).load()
    files = files.where(F.col("path").endswith(".java")).select(F.lit(project).alias("project"), "path", "content", F.col("modified_time"))
    return files.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
