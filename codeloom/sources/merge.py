"""Merging batches into tables by key. A write is a new version of a table; readers see the old one until it is swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of both, one per key; each column has the value of the latest row (by seq) in which it is not null."""
    rows = old.unionByName(new, allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in (*keys, seq)]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols]
    return rows.groupBy(*keys).agg(*latest, F.max(seq).alias(seq))


def upsert_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, rel_type, dst, ...) both of whose ends exist in nodes (id); one per src, rel_type and dst."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.dropDuplicates(["src", "rel_type", "dst"])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks (the first writer wins)."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """old without the rows of changed files (column path), and the rows of new."""
    return old.join(changed.select(path).distinct(), path, "left_anti").unionByName(new, allowMissingColumns=True)


def without_project(types: DataFrame, methods: DataFrame, calls: DataFrame, project_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """types, methods and calls without a project: its types, what they declare, and the calls at either end of that."""
    gone = types.where(F.col("project_id") == project_id).select("type_id")
    kept = methods.join(gone, "type_id", "left_anti")
    lost = methods.join(gone, "type_id", "left_semi").select("method_id")
    calls = calls.join(lost.withColumnRenamed("method_id", "src"), "src", "left_anti").join(lost.withColumnRenamed("method_id", "dst"), "dst", "left_anti")
    return types.join(gone, "type_id", "left_anti"), kept, calls


def resolve_stubs(types: DataFrame) -> DataFrame:
    """types without external stubs whose fqn a real type has."""
    real = types.where(~F.coalesce("is_external", F.lit(False))).select("fqn").distinct()
    stub = F.coalesce("is_external", F.lit(False))
    return types.where(~stub).unionByName(types.where(stub).join(real, "fqn", "left_anti"))


def storable(df: DataFrame) -> DataFrame:
    """df without the columns that a property cannot hold: all but plain values and arrays of them."""
    plain = lambda t: isinstance(t, (T.StringType, T.NumericType, T.BooleanType, T.TimestampType))
    return df.select(*(f.name for f in df.schema if plain(f.dataType) or isinstance(f.dataType, T.ArrayType) and plain(f.dataType.elementType)))


def file_entities(types: DataFrame, project: str, file_path: str) -> DataFrame:
    """The types of one file of a project."""
    return types.where((F.col("project") == project) & (F.col("file_path") == file_path))


def save_version(versions: DataFrame, project: str, commit: str, seq: int) -> DataFrame:
    """versions (project, commit, seq) with the version of a project set."""
    new = versions.sparkSession.createDataFrame([(project, commit, seq)], versions.schema)
    return upsert(versions, new, ["project"], "seq").select(versions.columns)
