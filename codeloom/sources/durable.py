"""A graph that lasts: versions of tables in a folder, each version under one manifest.

A table is dealt to parts by the hash of a column (a key, or the file that rows come from); the rows of a part lie in a folder of their own, sorted by that
column and with Bloom filters on the keys that are looked up. A manifest names the folder of every part of every table, so a
version can share most parts with the one before: a change writes the parts it touches, and then the manifest, which is renamed into place
last and never over another. A job that dies before leaves the former version as it was; readers hold on to the version they opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a table, unless the store says otherwise when it is made.
PARTS = 16
#: Bytes of a row group: what a lookup reads at least.
ROW_GROUP = 1 << 20


class Conflict(Exception):
    """Another writer made this version first."""


class GraphStore:
    """The tables in a folder that all executors see. `version` is the one that was newest when the store was opened (0: none yet)."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.version = max(self.versions(), default=0) if version is None else version
        self.manifest: dict = self._manifest(self.version) if self.version else {"parts": parts, "tables": {}, "notes": {}}

    def versions(self) -> list[int]:
        """The complete versions that are still there."""
        found = self.fs.globStatus(self._path("manifest/*.json")) or []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found)

    def _manifest(self, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{version:010d}.json").collect()))

    @property
    def tables(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def _part(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.manifest["parts"])).cast("int")

    def _schema(self, name: str) -> StructType:
        return StructType.fromJson(self.manifest["tables"][name]["schema"])

    def _of(self, name: str, parts: list[int] | None = None) -> DataFrame:
        t = self.manifest["tables"][name]
        where = [f"{self.path}/{d}" for k, d in sorted(t["parts"].items()) if parts is None or int(k) in parts]
        return self.spark.read.schema(self._schema(name)).parquet(*where) if where else self.spark.createDataFrame([], self._schema(name))

    def read(self, name: str) -> DataFrame:
        """A table as of this version."""
        return self._of(name)

    def seek(self, name: str, column: str, value: object) -> DataFrame:
        """The rows of a table whose column has a value. By the column that the table is dealt by one part is read; by any other one,
        all are asked, and answer from their Bloom filters."""
        by = self.manifest["tables"][name]["by"]
        parts = None
        if column == by:
            kind = self._schema(name)[by].dataType
            parts = [self.spark.range(1).select(F.lit(value).cast(kind).alias(by)).select(self._part(by)).first()[0]]
        return self._of(name, parts).where(F.col(column) == F.lit(value))

    def _write(self, name: str, df: DataFrame, by: str, keys: tuple[str, ...]) -> dict[str, str]:
        """Writes rows to new folders, one for each part that has any."""
        where = f"tables/{name}/{uuid.uuid4().hex}"
        n = self.manifest["parts"]
        rows = df.withColumn("_part", self._part(by)).repartition(n, "_part").sortWithinPartitions("_part", by)
        writer = rows.write.partitionBy("_part").option("parquet.block.size", ROW_GROUP)
        for k in {by, *keys}:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/{where}")
        made = self.fs.globStatus(self._path(f"{where}/_part=*")) or []
        return {s.getPath().getName().split("=")[1]: f"{where}/{s.getPath().getName()}" for s in made}

    def _commit(self, tables: dict, notes: Mapping[str, object]) -> int:
        version = self.version + 1
        new = {"parts": self.manifest["parts"], "tables": {**self.manifest["tables"], **tables}, "notes": {**self.manifest["notes"], **notes}}
        held, target = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/{version:010d}.json")
        out = self.fs.create(held, True)
        out.write(json.dumps(new).encode())
        out.close()
        try:
            self._files.rename(self.fs.makeQualified(held), self.fs.makeQualified(target), self._no_options)  # never over another
        except Py4JJavaError as e:
            self.fs.delete(held, False)
            raise Conflict(f"version {version} of {self.path} is there already") from e
        self.version, self.manifest = version, new
        return version

    def commit(self, tables: Mapping[str, tuple[DataFrame, str]], keys: Mapping[str, tuple[str, ...]] | None = None, notes: Mapping[str, object] | None = None) -> int:
        """Writes whole tables (name: rows and the column they are dealt by) as the next version; all become visible at once.

        keys: further columns that are looked up. A null in the column that rows are dealt by is allowed."""
        made = {}
        for name, (df, by) in tables.items():
            more = (keys or {}).get(name, ())
            made[name] = {"by": by, "keys": list(more), "schema": json.loads(df.schema.json()), "parts": self._write(name, df, by, more)}
        return self._commit(made, notes or {})

    def replace(self, tables: Mapping[str, DataFrame], changed: DataFrame, notes: Mapping[str, object] | None = None) -> int:
        """Puts rows in the place of those of changed values, in tables that are dealt by the one column of `changed`: only parts that
        hold such a value are read and written. changed: the values (of files, say), those without rows any more included; rows: whole tables' columns."""
        (by,) = changed.columns
        touched = sorted(r[0] for r in changed.select(self._part(by).alias("p")).distinct().collect())  # at most a number for each part
        made = {}
        for name, df in tables.items():
            t = self.manifest["tables"][name]
            if t["by"] != by:
                raise ValueError(f"{name} is dealt by {t['by']}")
            kept = self._of(name, touched).join(changed.distinct(), by, "left_anti")
            schema = self._schema(name)
            rows = kept.select(schema.names).unionByName(df.select(*(F.col(f.name).cast(f.dataType) for f in schema)))
            written = self._write(name, rows, by, tuple(t["keys"]))
            made[name] = {**t, "parts": {**{k: d for k, d in t["parts"].items() if int(k) not in touched}, **written}}
        return self._commit(made, notes or {})

    def expire(self, keep: int = 2) -> int:
        """Deletes all but the newest versions, and the folders that none of those names; returns how many folders went. Folders of
        versions not yet complete go too: no writer may be at work."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {d for v in kept for t in self._manifest(v)["tables"].values() for d in t["parts"].values()}
        for v in versions[: len(versions) - len(kept)]:
            self.fs.delete(self._path(f"manifest/{v:010d}.json"), False)
        gone = 0
        for s in self.fs.globStatus(self._path("tables/*/*/_part=*")) or []:
            p = s.getPath()
            name = f"tables/{p.getParent().getParent().getName()}/{p.getParent().getName()}/{p.getName()}"
            if name not in used:
                gone += 1
                self.fs.delete(p, True)
        return gone
