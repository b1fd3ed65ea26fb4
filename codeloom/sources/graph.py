"""The code graph as DataFrames, and one derived from the driver's tables by rule (FIXTURES.md, section 3).

A graph is stored once per application and input as Parquet, each table when it is first asked for (calls partitioned by rel_type, so
that a query on some edge types reads only theirs, in buckets of their source, so that no traversal exchanges them) and every query reads that store.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bucketed, small, written

#: The views of FIXTURES.md in order; the text runs on Spark and on DuckDB alike.
FIXTURE: dict[str, str] = {
    "fx_project": "SELECT n_nationkey AS project_id, n_name AS name, concat('/repos/', lower(n_name)) AS path FROM nation",
    "fx_type": """SELECT c_custkey AS type_id,
concat(CASE WHEN c_custkey % 13 = 0 THEN 'java.util.' WHEN c_custkey % 17 = 0 THEN 'org.slf4j.' ELSE 'com.acme.' END,
 lower(c_mktsegment), '.C', CAST(c_custkey AS VARCHAR(20)),
 CASE c_custkey % 9 WHEN 0 THEN 'Service' WHEN 1 THEN 'DTO' WHEN 2 THEN 'Utils' WHEN 3 THEN 'Entity' WHEN 4 THEN 'Controller' WHEN 5 THEN 'VO' ELSE '' END) AS fqn,
concat('C', CAST(c_custkey AS VARCHAR(20)),
 CASE c_custkey % 9 WHEN 0 THEN 'Service' WHEN 1 THEN 'DTO' WHEN 2 THEN 'Utils' WHEN 3 THEN 'Entity' WHEN 4 THEN 'Controller' WHEN 5 THEN 'VO' ELSE '' END) AS name,
lower(c_mktsegment) AS package,
CASE c_mktsegment WHEN 'BUILDING' THEN 'INTERFACE' WHEN 'MACHINERY' THEN 'MAPPER' WHEN 'HOUSEHOLD' THEN 'ARIES_JOB' ELSE 'CLASS' END AS kind,
CASE c_custkey % 6 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Manager' WHEN 3 THEN 'DAO' WHEN 4 THEN 'Entity' END AS arch_layer,
CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS project_id, c_custkey % 11 = 0 AS is_external FROM customer""",
    "fx_method": """SELECT o.o_orderkey AS method_id, concat('m', CAST(o.o_orderkey % 8 AS VARCHAR(20))) AS name, o.o_custkey AS type_id,
concat(t.fqn, '.m', CAST(o.o_orderkey % 8 AS VARCHAR(20)), '(', CAST(o.o_orderkey AS VARCHAR(20)), ')') AS signature,
CASE o.o_orderstatus WHEN 'F' THEN 'void' WHEN 'O' THEN 'String' ELSE 'long' END AS return_type FROM orders o JOIN fx_type t ON t.type_id = o.o_custkey""",
    "fx_call": """SELECT r.src, r.dst, concat('f', CAST(r.dst % 5 AS VARCHAR(20))) AS via_field,
CASE WHEN td.kind = 'MAPPER' THEN 'DB_CALL'
 WHEN td.kind = 'INTERFACE' AND (td.project_id IS NULL OR ts.project_id IS NULL OR td.project_id <> ts.project_id) THEN 'DUBBO_CALLS' ELSE 'CALLS' END AS rel_type
FROM (SELECT DISTINCT l.l_orderkey AS src, (l.l_orderkey * 31 + l.l_partkey) % n.n AS dst FROM lineitem l CROSS JOIN (SELECT count(*) AS n FROM orders) n WHERE l.l_linenumber <= 3) r
JOIN fx_method ms ON ms.method_id = r.src JOIN fx_type ts ON ts.type_id = ms.type_id JOIN fx_method md ON md.method_id = r.dst JOIN fx_type td ON td.type_id = md.type_id
WHERE r.src <> r.dst""",
    "fx_implements": """SELECT DISTINCT a.type_id AS src, b.type_id AS dst FROM
(SELECT type_id, (type_id * 7 + 3) % n.n AS k FROM fx_type CROSS JOIN (SELECT count(*) AS n FROM customer) n WHERE kind = 'CLASS'
 UNION ALL SELECT type_id, (type_id * 11 + 5) % n.n AS k FROM fx_type CROSS JOIN (SELECT count(*) AS n FROM customer) n WHERE kind = 'CLASS'
 UNION ALL SELECT type_id, (type_id * 13 + 1) % n.n AS k FROM fx_type CROSS JOIN (SELECT count(*) AS n FROM customer) n WHERE kind = 'CLASS') a
JOIN fx_type b ON b.type_id = a.k WHERE b.kind = 'INTERFACE' AND a.type_id <> b.type_id""",
    "fx_depends_on": "SELECT DISTINCT ms.type_id AS src, md.type_id AS dst FROM fx_call c JOIN fx_method ms ON ms.method_id = c.src JOIN fx_method md ON md.method_id = c.dst WHERE ms.type_id <> md.type_id",
    "fx_mapper_table": """SELECT t.type_id AS src, replace(lower(p.p_brand), 'brand#', 't_brand_') AS table_name FROM fx_type t CROSS JOIN (SELECT count(*) AS n FROM part) n
JOIN part p ON p.p_partkey = t.type_id % n.n WHERE t.kind = 'MAPPER'""",
    "fx_endpoint": """SELECT o_orderkey AS method_id, concat('/api/o', CAST(o_orderkey AS VARCHAR(20))) AS path,
CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'PUT' END AS http_method FROM orders WHERE o_orderkey % 5 = 0""",
    "fx_job": """SELECT m.method_id, concat(t.fqn, '.', m.name) AS job_fqn, CASE WHEN m.method_id % 2 = 0 THEN 'scheduled' ELSE 'delayed' END AS job_type,
CASE WHEN m.method_id % 2 = 0 THEN '0 * * * *' END AS cron_expr FROM fx_method m JOIN fx_type t ON t.type_id = m.type_id WHERE t.kind = 'ARIES_JOB' AND m.method_id % 3 = 0""",
    "fx_mq": """SELECT DISTINCT m.method_id, m.type_id, concat('topic_', CAST(e.event_id % 20 AS VARCHAR(20))) AS topic,
CASE WHEN e.event_id % 2 = 0 THEN 'kafka' ELSE 'rocket' END AS mq_type, CASE e.event_type WHEN 'purchase' THEN 'producer' ELSE 'consumer' END AS role
FROM events e CROSS JOIN (SELECT count(*) AS n FROM orders) n JOIN fx_method m ON m.method_id = e.event_id % n.n WHERE e.event_type IN ('purchase', 'click')""",
}
_BASE = ("nation", "customer", "orders", "lineitem", "part", "events")


def oracle(sql: str) -> str:
    """An oracle query over the fixture: its views as CTEs before the query's own (which starts with a CTE or SELECT)."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in FIXTURE.items():
            if name in text and name not in used:
                need(body)
                if name not in used:
                    used.append(name)

    need(sql)
    ctes = ",\n".join(f"{n} AS ({FIXTURE[n]})" for n in FIXTURE if n in used)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{sql[5:]}"
    return f"WITH RECURSIVE {ctes}\n{sql}"


@dataclass(frozen=True)
class Graph:
    """project(project_id, name, path); type(type_id, fqn, name, package, kind, arch_layer, project_id, is_external; project_id
    NULL: not contained in a project); method(method_id, name, type_id, signature, return_type); call(src, dst, via_field,
    rel_type: CALLS, DB_CALL, DUBBO_CALLS); implements(src, dst); depends_on(src, dst); mapper_table(src, table_name);
    endpoint(method_id, path, http_method); job(method_id, job_fqn, job_type, cron_expr); mq(method_id, type_id, topic, mq_type, role)."""

    spark: SparkSession
    project: DataFrame
    type: DataFrame
    method: DataFrame
    call: DataFrame
    implements: DataFrame
    depends_on: DataFrame
    mapper_table: DataFrame
    endpoint: DataFrame
    job: DataFrame
    mq: DataFrame

    @cached_property
    def project_name(self) -> DataFrame:
        """project_id and name, to be broadcast if a count shows that they are few."""
        return small(self.project.select("project_id", F.col("name").alias("project")))

    @property
    def owned(self) -> DataFrame:
        """Methods with their class and its project (NULL if the class is not contained)."""
        t = self.type.select("type_id", "fqn", F.col("name").alias("class_name"), "kind", "arch_layer", "project_id", "is_external", "package")
        return self.method.join(t, "type_id").join(self.project_name, "project_id", "left")

    @property
    def contained(self) -> DataFrame:
        """Types in a project, with its name."""
        return self.type.join(self.project_name, "project_id")

    def calls(self, *rel_types: str) -> DataFrame:
        return self.call.where(F.col("rel_type").isin(*rel_types)) if rel_types else self.call


class Derived(Graph):
    """The graph derived from the tables in sf_dir. Each of its tables is made and stored when it is first asked for, with those it is made of: a query on types
    makes no calls."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        for name, value in (("spark", spark), ("_sf_dir", sf_dir)):
            object.__setattr__(self, name, value)

    def __getattr__(self, name: str) -> DataFrame:  # asked only for what is not there yet
        if f"fx_{name}" not in FIXTURE:
            raise AttributeError(name)
        made = self._made(f"fx_{name}")
        object.__setattr__(self, name, made)
        return made

    def _made(self, name: str) -> DataFrame:
        sql = FIXTURE[name]
        words = set(re.findall(r"\w+", sql))
        views = {n: getattr(self, n.removeprefix("fx_")) for n in FIXTURE if n in words and n != name}
        views |= {t: self.spark.read.parquet(f"{self._sf_dir}/{t}.parquet") for t in _BASE if t in words}
        for n, df in views.items():
            df.createOrReplaceTempView(n)
        df = written(self.spark.sql(sql))  # so that what is counted, and dealt to buckets, is made once
        for n in views:
            self.spark.catalog.dropTempView(n)
        return bucketed(df, "src", "rel_type") if name == "fx_call" else bucketed(df, "src") if name == "fx_depends_on" else df


_open: dict[tuple[str, str], Graph] = {}


def open_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph derived from the tables in sf_dir; its tables are made and stored at the application's first use of each."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Derived(spark, sf_dir)
    return _open[key]
