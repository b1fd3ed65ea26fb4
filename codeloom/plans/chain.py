"""Call-chain queries: what is reached from methods, and the records at the places reached.

Every plan takes a graph and a DataFrame of start methods (source, node) and shares one multi-source
traversal per set of edge types, so a chain of many start methods costs one traversal. The registered
queries start at the method with the most CALLS edges (the smallest id of equals).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import simple_name
from ..operators.traverse import lengths, on_paths, reach, simple_paths
from ..sources.graph import Graph
from ..sources.store import written
from .registry import on_graph

DEPTH = 10
START = "s AS (SELECT src AS node FROM fx_call WHERE rel_type = 'CALLS' GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
START_TYPE = "s AS (SELECT src AS node FROM fx_depends_on GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def start(g: Graph) -> DataFrame:
    top = g.calls("CALLS").groupBy("src").count().orderBy(F.desc("count"), "src").limit(1)
    return top.select(F.col("src").alias("source"), F.col("src").alias("node"))


def start_type(g: Graph) -> DataFrame:
    top = g.depends_on.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1)
    return top.select(F.col("src").alias("source"), F.col("src").alias("node"))


def _walk(kinds: str, depth: int = DEPTH, name: str = "w") -> str:
    return f"""{name}(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.dst, w.d + 1 FROM {name} w JOIN fx_call e ON e.src = w.node WHERE w.d < {depth} AND e.rel_type IN ({kinds}))"""


def _seeds(methods: DataFrame) -> DataFrame:
    return methods.select("source", "node")


def internal_classes(g: Graph, methods: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Classes in a project, not external, that declare a method reached over CALLS and DB_CALL."""
    nodes = reach(g.calls("CALLS", "DB_CALL"), methods, depth).select(F.col("node").alias("type_method")).distinct()
    types = g.method.join(nodes, F.col("method_id") == F.col("type_method"), "left_semi").select("type_id").distinct()
    out = g.contained.where(~F.coalesce("is_external", F.lit(False))).join(types, "type_id", "left_semi")
    return out.select("project", F.col("fqn").alias("class_fqn"), F.col("name").alias("class_name"), F.coalesce("arch_layer", F.lit("Other")).alias("arch_layer")).distinct().orderBy("project", "class_fqn")


@on_graph("trv_04_internal_classes", f"""WITH {START}, {_walk("'CALLS', 'DB_CALL'")}
SELECT DISTINCT p.name AS project, t.fqn AS class_fqn, t.name AS class_name, coalesce(t.arch_layer, 'Other') AS arch_layer
FROM w JOIN fx_method m ON m.method_id = w.node JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id WHERE NOT t.is_external""")
def _trv04(g: Graph) -> DataFrame:
    return internal_classes(g, start(g))


def dubbo_calls(g: Graph, methods: DataFrame, depth: int = DEPTH, cross_project_only: bool = False) -> DataFrame:
    """DUBBO_CALLS of what is reached over CALLS, with the project of an implementation that has the method (if any).

    The condition on projects belongs to the optional match of the interface's project, so by default it removes no
    row; with cross_project_only it does."""
    nodes = reach(g.calls("CALLS"), methods, depth).select(F.col("node").alias("src")).distinct()
    hop = g.calls("DUBBO_CALLS").join(nodes, "src")
    m = g.owned
    caller = m.select(F.col("method_id").alias("src"), F.col("project").alias("caller_project"), F.col("fqn").alias("caller_class"), F.col("name").alias("caller_method"))
    iface = m.where("kind = 'INTERFACE'").select(F.col("method_id").alias("dst"), F.col("type_id").alias("iface"), F.col("fqn").alias("dubbo_interface"), F.col("name").alias("dubbo_method"), F.col("project").alias("own_project"))
    impl = g.implements.join(g.type.where("kind = 'CLASS'").join(g.project_name, "project_id", "left").select(F.col("type_id").alias("src"), "project"), "src")
    impl = impl.select(F.col("dst").alias("iface"), F.col("src").alias("impl"), F.col("project").alias("impl_project"))
    # an implementation counts if it declares the method, or no method at all
    named = g.method.select(F.col("type_id").alias("impl"), F.col("name").alias("dubbo_method"), F.lit(True).alias("named")).distinct()
    declares = g.method.select(F.col("type_id").alias("impl"), F.lit(True).alias("declares")).distinct()
    rows = hop.join(caller, "src").join(iface, "dst").join(impl, "iface", "left")
    rows = rows.join(named, ["impl", "dubbo_method"], "left").join(declares, "impl", "left").where("named OR declares IS NULL")
    other = F.col("impl_project").isNull() | (F.col("caller_project") != F.col("impl_project"))
    if cross_project_only:
        rows = rows.where(other)
    target = F.coalesce("impl_project", F.when(other, F.col("own_project")), F.lit("External"))
    return rows.select("caller_project", "caller_class", "caller_method", "dubbo_interface", "dubbo_method", F.coalesce("via_field", F.lit("")).alias("via_field"), target.alias("target_project")).distinct()


_DUBBO = """SELECT DISTINCT cp.name AS caller_project, ct.fqn AS caller_class, cm.name AS caller_method, it.fqn AS dubbo_interface, im.name AS dubbo_method,
 coalesce(e.via_field, '') AS via_field, coalesce(xp.name, CASE WHEN xp.name IS NULL OR cp.name <> xp.name THEN ip.name END, 'External') AS target_project
FROM (SELECT DISTINCT node FROM w) n JOIN fx_call e ON e.src = n.node AND e.rel_type = 'DUBBO_CALLS'
JOIN fx_method cm ON cm.method_id = e.src JOIN fx_type ct ON ct.type_id = cm.type_id LEFT JOIN fx_project cp ON cp.project_id = ct.project_id
JOIN fx_method im ON im.method_id = e.dst JOIN fx_type it ON it.type_id = im.type_id AND it.kind = 'INTERFACE' LEFT JOIN fx_project ip ON ip.project_id = it.project_id
LEFT JOIN (SELECT i.src, i.dst, t.project_id FROM fx_implements i JOIN fx_type t ON t.type_id = i.src AND t.kind = 'CLASS') x ON x.dst = it.type_id
LEFT JOIN fx_project xp ON xp.project_id = x.project_id LEFT JOIN fx_method xm ON xm.type_id = x.src WHERE (xm.name IS NULL OR xm.name = im.name)"""


@on_graph("trv_05_dubbo_calls", f"""WITH {START}, {_walk("'CALLS'")} {_DUBBO}""")
def _trv05(g: Graph) -> DataFrame:
    return dubbo_calls(g, start(g))


@on_graph("trv_05_dubbo_calls_cross_project", f"""WITH {START}, {_walk("'CALLS'")} {_DUBBO} AND (xp.name IS NULL OR cp.name <> xp.name)""")
def _trv05x(g: Graph) -> DataFrame:
    return dubbo_calls(g, start(g), cross_project_only=True)


def _same_name_impl(g: Graph, iface_methods: DataFrame, any_kind: bool = False) -> DataFrame:
    """(iface_method, impl_method): methods of implementing classes with the name of an interface's method."""
    m = g.method.select(F.col("method_id").alias("iface_method"), F.col("type_id").alias("dst"), "name")
    m = m.join(g.type.where("kind = 'INTERFACE'").select(F.col("type_id").alias("dst")), "dst").join(iface_methods, "iface_method", "left_semi")
    impl = g.implements if any_kind else g.implements.join(g.type.where("kind = 'CLASS'").select(F.col("type_id").alias("src")), "src")
    own = g.method.select(F.col("method_id").alias("impl_method"), F.col("type_id").alias("src"), "name")
    return m.join(impl, "dst").join(own, ["src", "name"]).select("iface_method", "impl_method").distinct()


def tables(g: Graph, methods: DataFrame, include_direct: bool = False) -> DataFrame:
    """Tables behind the interfaces reached over 1-8 CALLS: their implementations' methods, then 1-5 CALLS or DB_CALL with
    a DB_CALL among them, to a mapper. With include_direct also mappers reached without an interface between."""
    one = F.lit(0).cast("long").alias("source")
    called = reach(g.calls("CALLS"), methods, 8, zero=False).select(F.col("node").alias("iface_method")).distinct()
    begin = _same_name_impl(g, called).select(one, F.col("impl_method").alias("node")).distinct()
    if include_direct:
        begin = begin.unionByName(methods.select(one, "node")).distinct()
    state = {"db": F.col("db") | (F.col("rel_type") == "DB_CALL")}
    walk = lengths(g.calls("CALLS", "DB_CALL").select("src", "dst", "rel_type"), begin.withColumn("depth", F.lit(0)).withColumn("db", F.lit(False)), 5, state)
    mapper = walk.where("db AND depth > 0").select(F.col("node").alias("method_id")).distinct().join(g.method.select("method_id", "type_id"), "method_id").select("type_id").distinct()
    out = g.contained.where("kind = 'MAPPER'").join(mapper, "type_id", "left_semi").join(g.mapper_table.withColumnRenamed("src", "type_id"), "type_id", "left")
    return out.select("project", F.col("fqn").alias("mapper_fqn"), F.col("name").alias("mapper_name"), "table_name").distinct().orderBy("project", "mapper_fqn", F.asc_nulls_last("table_name"))


_IMPL = """x AS (SELECT DISTINCT xm.method_id AS node, im.method_id AS iface FROM fx_method im JOIN fx_type it ON it.type_id = im.type_id AND it.kind = 'INTERFACE' JOIN fx_implements i ON i.dst = it.type_id
 JOIN fx_type xt ON xt.type_id = i.src AND xt.kind = 'CLASS' JOIN fx_method xm ON xm.type_id = xt.type_id AND xm.name = im.name)"""


_PROJECT_START = "s AS (SELECT m.method_id AS node FROM fx_method m JOIN fx_type t ON t.type_id = m.type_id WHERE t.project_id = 3)"


@on_graph("trv_06_tables", f"""WITH {_PROJECT_START}, {_walk("'CALLS'", 8)}, {_IMPL},
v(node, d, db) AS (SELECT DISTINCT x.node, 0, false FROM x JOIN w ON w.node = x.iface AND w.d > 0 UNION SELECT e.dst, v.d + 1, v.db OR e.rel_type = 'DB_CALL' FROM v JOIN fx_call e ON e.src = v.node WHERE v.d < 5 AND e.rel_type IN ('CALLS', 'DB_CALL'))
SELECT DISTINCT p.name AS project, t.fqn AS mapper_fqn, t.name AS mapper_name, mt.table_name FROM v JOIN fx_method m ON m.method_id = v.node JOIN fx_type t ON t.type_id = m.type_id AND t.kind = 'MAPPER'
JOIN fx_project p ON p.project_id = t.project_id LEFT JOIN fx_mapper_table mt ON mt.src = t.type_id WHERE v.db AND v.d > 0""")
def _trv06(g: Graph) -> DataFrame:
    """From every method of a project: a single method hardly ever calls an interface that is implemented in front of a mapper."""
    m = g.owned.where("project_id = 3")
    return tables(g, m.select(F.col("method_id").alias("source"), F.col("method_id").alias("node")))


def jobs(g: Graph, methods: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Jobs executed by methods reached over all edge types; the class must be an ARIES_JOB in a project."""
    nodes = reach(g.call, methods, depth).select(F.col("node").alias("method_id")).distinct()
    out = g.job.join(nodes, "method_id", "left_semi").join(g.owned.where("kind = 'ARIES_JOB' AND project IS NOT NULL"), "method_id")
    return out.select("project", F.col("fqn").alias("class_fqn"), "class_name", F.coalesce("job_type", F.lit("unknown")).alias("job_type"), "cron_expr").distinct()


@on_graph("trv_07_jobs", f"""WITH {START}, {_walk("'CALLS', 'DB_CALL', 'DUBBO_CALLS'")}
SELECT DISTINCT p.name AS project, t.fqn AS class_fqn, t.name AS class_name, coalesce(j.job_type, 'unknown') AS job_type, j.cron_expr
FROM w JOIN fx_job j ON j.method_id = w.node JOIN fx_method m ON m.method_id = j.method_id JOIN fx_type t ON t.type_id = m.type_id AND t.kind = 'ARIES_JOB' JOIN fx_project p ON p.project_id = t.project_id""")
def _trv07(g: Graph) -> DataFrame:
    return jobs(g, start(g))


def _mq(g: Graph, nodes: DataFrame, role: str) -> DataFrame:
    out = g.mq.where(F.col("role") == role).drop("type_id").join(nodes, "method_id", "left_semi").join(g.owned.where("project IS NOT NULL"), "method_id")
    return out.select("project", F.col("fqn").alias("class_fqn"), "class_name", "kind", "mq_type", "topic", "role", F.col("name").alias("method")).distinct()


def mq_consumers(g: Graph, methods: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Consumers among what is reached over CALLS and DB_CALL from methods whose class is in a project: the class
    consumes the topic and the topic's method is the one reached."""
    begin = methods.join(g.owned.where("project IS NOT NULL").select(F.col("method_id").alias("node")), "node", "left_semi")
    nodes = reach(g.calls("CALLS", "DB_CALL"), begin, depth).select(F.col("node").alias("method_id")).distinct()
    return _mq(g, nodes, "consumer").where("kind IN ('CLASS', 'MAPPER', 'ARIES_JOB')").drop("kind").distinct()


def mq_producers(g: Graph, methods: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Producers among what is reached over all edge types."""
    nodes = reach(g.call, methods, depth).select(F.col("node").alias("method_id")).distinct()
    return _mq(g, nodes, "producer").drop("kind").distinct()


_MQ = """SELECT DISTINCT p.name AS project, t.fqn AS class_fqn, t.name AS class_name, q.mq_type, q.topic, q.role, m.name AS method
FROM (SELECT DISTINCT node FROM w) w JOIN fx_mq q ON q.method_id = w.node JOIN fx_method m ON m.method_id = q.method_id JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id"""


@on_graph("trv_08_mq_consumers", f"""WITH s0 AS (SELECT src AS node FROM fx_call WHERE rel_type = 'CALLS' GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
s AS (SELECT s0.node FROM s0 JOIN fx_method m ON m.method_id = s0.node JOIN fx_type t ON t.type_id = m.type_id WHERE t.project_id IS NOT NULL), {_walk("'CALLS', 'DB_CALL'")} {_MQ} WHERE q.role = 'consumer' AND t.kind <> 'INTERFACE'""")
def _trv08(g: Graph) -> DataFrame:
    return mq_consumers(g, start(g))


@on_graph("trv_09_mq_producers", f"""WITH {START}, {_walk("'CALLS', 'DB_CALL', 'DUBBO_CALLS'")} {_MQ} WHERE q.role = 'producer'""")
def _trv09(g: Graph) -> DataFrame:
    return mq_producers(g, start(g))


def dependency_graph(g: Graph, starts: DataFrame, depth: int = 3, mode: str = "moderate") -> DataFrame:
    """Edges of DEPENDS_ON paths of at most depth edges from the start classes to a class of their project or of none;
    noise at either end is left out."""
    from ..functions.rules import is_noise

    own = g.type.join(starts.select(F.col("node").alias("type_id")), "type_id").select("project_id")
    ends = g.type.select(F.col("type_id").alias("node"), "project_id")
    ends = ends.where("project_id IS NULL").select("node").union(ends.join(own, "project_id", "left_semi").select("node"))
    edges = on_paths(g.depends_on, starts, ends, depth)
    end = lambda side, n: g.type.select(F.col("type_id").alias(side), F.col("fqn").alias(f"{n}_fqn"), F.col("name").alias(f"{n}_name"))
    out = edges.join(end("src", "from"), "src").join(end("dst", "to"), "dst")
    return out.where(~is_noise(F.col("from_fqn"), F.col("from_name"), mode) & ~is_noise(F.col("to_fqn"), F.col("to_name"), mode)).select("from_fqn", "to_fqn", "depth").distinct()


_NOISE = lambda f, n: f"""(starts_with({f}, 'java.util.') OR starts_with({f}, 'org.slf4j.') OR {n} LIKE '%Utils' OR {n} LIKE '%Util' OR {n} LIKE '%DTO' OR {n} LIKE '%VO')"""


@on_graph("trv_01_dependency_graph", f"""WITH {START_TYPE}, o AS (SELECT t.project_id FROM fx_type t JOIN s ON s.node = t.type_id),
f(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.dst, f.d + 1 FROM f JOIN fx_depends_on e ON e.src = f.node WHERE f.d < 2),
z AS (SELECT t.type_id AS node FROM fx_type t WHERE t.project_id IS NULL OR t.project_id IN (SELECT project_id FROM o)),
b(node, d) AS (SELECT node, 0 FROM z UNION SELECT e.src, b.d + 1 FROM b JOIN fx_depends_on e ON e.dst = b.node WHERE b.d < 2),
f1 AS (SELECT node, min(d) AS d FROM f GROUP BY node), b1 AS (SELECT node, min(d) AS d FROM b GROUP BY node)
SELECT DISTINCT x.fqn AS from_fqn, y.fqn AS to_fqn, f1.d AS depth FROM fx_depends_on e JOIN f1 ON f1.node = e.src JOIN b1 ON b1.node = e.dst JOIN fx_type x ON x.type_id = e.src JOIN fx_type y ON y.type_id = e.dst
WHERE f1.d + 1 + b1.d <= 3 AND NOT {_NOISE('x.fqn', 'x.name')} AND NOT {_NOISE('y.fqn', 'y.name')}""")
def _trv01(g: Graph) -> DataFrame:
    return dependency_graph(g, start_type(g))


@on_graph("trv_02_project_graph", f"""WITH o AS (SELECT project_id FROM fx_type WHERE project_id IS NOT NULL GROUP BY project_id ORDER BY count(*) DESC, project_id LIMIT 1),
s AS (SELECT type_id AS node FROM fx_type WHERE project_id IN (SELECT project_id FROM o)), z AS (SELECT node FROM s UNION SELECT type_id FROM fx_type WHERE project_id IS NULL),
f(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.dst, f.d + 1 FROM f JOIN fx_depends_on e ON e.src = f.node WHERE f.d < 1),
b(node, d) AS (SELECT node, 0 FROM z UNION SELECT e.src, b.d + 1 FROM b JOIN fx_depends_on e ON e.dst = b.node WHERE b.d < 1),
f1 AS (SELECT node, min(d) AS d FROM f GROUP BY node), b1 AS (SELECT node, min(d) AS d FROM b GROUP BY node)
SELECT DISTINCT x.fqn AS from_fqn, y.fqn AS to_fqn FROM fx_depends_on e JOIN f1 ON f1.node = e.src JOIN b1 ON b1.node = e.dst JOIN fx_type x ON x.type_id = e.src JOIN fx_type y ON y.type_id = e.dst WHERE f1.d + 1 + b1.d <= 2""")
def _trv02(g: Graph) -> DataFrame:
    own = g.type.where("project_id IS NOT NULL").groupBy("project_id").count().orderBy(F.desc("count"), "project_id").limit(1)  # one row
    starts = g.type.join(F.broadcast(own), "project_id", "left_semi").select(F.col("type_id").alias("node"))
    ends = starts.union(g.type.where("project_id IS NULL").select("type_id"))
    name = lambda side, n: g.type.select(F.col("type_id").alias(side), F.col("fqn").alias(n))
    return on_paths(g.depends_on, starts, ends, 2).join(name("src", "from_fqn"), "src").join(name("dst", "to_fqn"), "dst").select("from_fqn", "to_fqn").distinct()


def dependents(g: Graph, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth): classes that depend on a start over 1 to depth edges (a start itself only by a cycle)."""
    back = g.depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, starts, depth, zero=False).select("node", "depth")


def impact(g: Graph, starts: DataFrame, depth: int = 3) -> DataFrame:
    from ..functions.rules import risk

    hit = dependents(g, starts, depth).groupBy("depth").agg(F.count("*").alias("n"))
    total = hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return hit.crossJoin(F.broadcast(total)).select(F.col("depth").cast("long").alias("depth"), "n", "total", risk(F.col("total")).alias("risk"))  # total is one row


_BACK = "f(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.src, f.d + 1 FROM f JOIN fx_depends_on e ON e.dst = f.node WHERE f.d < 3), r AS (SELECT node, min(d) AS d FROM f WHERE d > 0 GROUP BY node)"


@on_graph("trv_03_impact", f"""WITH {START_TYPE}, {_BACK}, n AS (SELECT d, count(*) AS n FROM r GROUP BY d)
SELECT CAST(d AS BIGINT) AS depth, n, CAST((SELECT sum(n) FROM n) AS BIGINT) AS total, CASE WHEN (SELECT sum(n) FROM n) = 0 THEN 'none' WHEN (SELECT sum(n) FROM n) < 5 THEN 'low' WHEN (SELECT sum(n) FROM n) < 20 THEN 'medium' ELSE 'high' END AS risk FROM n""")
def _trv03(g: Graph) -> DataFrame:
    return impact(g, start_type(g))


@on_graph("jqa_07_impact_by_level", f"""WITH {START_TYPE}, {_BACK} SELECT CAST(d AS BIGINT) AS level, t.fqn AS class_fqn FROM r JOIN fx_type t ON t.type_id = r.node""")
def _jqa07(g: Graph) -> DataFrame:
    return dependents(g, start_type(g), 3).join(g.type.select(F.col("type_id").alias("node"), F.col("fqn").alias("class_fqn")), "node").select(F.col("depth").cast("long").alias("level"), "class_fqn")


def _children(g: Graph, nodes: DataFrame) -> DataFrame:
    """(src, dst): the methods that the given ones (node) call, and of an interface's method the implementations."""
    calls = g.calls("CALLS").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    return calls.union(_same_name_impl(g, nodes.select(F.col("node").alias("iface_method"))))


def call_tree(g: Graph, methods: DataFrame, depth: int = 4, per_parent: int | None = None, leaves: int = 5) -> DataFrame:
    """The call tree as rows: path (method ids from the root, joined by /), depth, node_type, name.

    A method's children: the methods it calls and, of an interface's method, the implementations (at most per_parent, if given); none
    that is an ancestor. Leaves: its Dubbo calls, and at most `leaves` tables reached over 1-3 CALLS or DB_CALL."""
    nodes = simple_paths(lambda at: _children(g, at), methods, depth, per_parent)
    text = F.concat_ws("/", F.transform("path", lambda x: x.cast("string")))
    m = g.owned
    named = nodes.join(m.select(F.col("method_id").alias("node"), "signature", "kind"), "node").withColumn("at", text)
    own = named.select("at", "depth", F.when(F.col("kind") == "INTERFACE", "interface").otherwise("method").alias("node_type"), F.col("signature").alias("name"))
    dubbo = g.calls("DUBBO_CALLS").join(m.where("kind = 'INTERFACE'").select(F.col("method_id").alias("dst"), F.concat_ws(".", "fqn", "name").alias("name")), "dst")
    dubbo = named.select("at", "depth", F.col("node").alias("src")).join(dubbo, "src").select("at", "depth", F.lit("dubbo_call").alias("node_type"), "name").distinct()
    seeds = named.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth")).distinct()
    to = reach(g.calls("CALLS", "DB_CALL"), seeds, 3, zero=False).select("source", F.col("node").alias("method_id"))
    db = to.join(g.method.select("method_id", "type_id"), "method_id").join(g.mapper_table.withColumnRenamed("src", "type_id"), "type_id").join(g.type.where("kind = 'MAPPER'").select("type_id", "fqn"), "type_id")
    db = db.select("source", F.concat_ws(":", "fqn", "table_name").alias("name")).distinct()
    from pyspark.sql import Window

    db = db.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("name"))).where(F.col("rn") <= leaves)
    db = named.select("at", "depth", F.col("node").alias("source")).join(db, "source").select("at", "depth", F.lit("db_call").alias("node_type"), "name")
    return own.union(dubbo).union(db).withColumnRenamed("at", "path")


_TREE = f"""{_IMPL}, ch AS (SELECT src, dst FROM fx_call WHERE rel_type = 'CALLS' UNION SELECT iface, node FROM x),
kid AS (SELECT src, dst FROM ch),
t(path, ids, node, d) AS (SELECT CAST(node AS VARCHAR), [node], node, 0 FROM s UNION ALL
 SELECT t.path || '/' || CAST(k.dst AS VARCHAR), list_append(t.ids, k.dst), k.dst, t.d + 1 FROM t JOIN kid k ON k.src = t.node WHERE t.d < 4 AND NOT list_contains(t.ids, k.dst))"""


@on_graph("trv_10_call_tree", f"""WITH {START}, {_TREE},
h(source, node, d) AS (SELECT DISTINCT node, node, 0 FROM t UNION SELECT h.source, e.dst, h.d + 1 FROM h JOIN fx_call e ON e.src = h.node WHERE h.d < 3 AND e.rel_type IN ('CALLS', 'DB_CALL')),
db AS (SELECT source, name FROM (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY name) AS rn FROM (SELECT DISTINCT h.source, y.fqn || ':' || mt.table_name AS name FROM h JOIN fx_method m ON m.method_id = h.node
 JOIN fx_type y ON y.type_id = m.type_id AND y.kind = 'MAPPER' JOIN fx_mapper_table mt ON mt.src = y.type_id WHERE h.d > 0)) WHERE rn <= 5)
SELECT path, d AS depth, CASE WHEN y.kind = 'INTERFACE' THEN 'interface' ELSE 'method' END AS node_type, m.signature AS name FROM t JOIN fx_method m ON m.method_id = t.node JOIN fx_type y ON y.type_id = m.type_id
UNION ALL SELECT DISTINCT path, d, 'dubbo_call', y.fqn || '.' || m.name FROM t JOIN fx_call e ON e.src = t.node AND e.rel_type = 'DUBBO_CALLS' JOIN fx_method m ON m.method_id = e.dst JOIN fx_type y ON y.type_id = m.type_id AND y.kind = 'INTERFACE'
UNION ALL SELECT path, d, 'db_call', db.name FROM t JOIN db ON db.source = t.node""")
def _trv10(g: Graph) -> DataFrame:
    return call_tree(g, start(g).select("node"))


@on_graph("trv_23_tree_class_stats", f"""WITH {START}, {_TREE} SELECT y.fqn AS class_fqn, count(*) AS call_count, count(DISTINCT m.name) AS n_methods FROM t JOIN fx_method m ON m.method_id = t.node JOIN fx_type y ON y.type_id = m.type_id GROUP BY y.fqn""")
def _trv23(g: Graph) -> DataFrame:
    nodes = simple_paths(lambda at: _children(g, at), start(g).select("node"), 4).select(F.col("node").alias("method_id"))
    return nodes.join(g.owned, "method_id").groupBy(F.col("fqn").alias("class_fqn")).agg(F.count("*").alias("call_count"), F.countDistinct("name").alias("n_methods")).orderBy(F.desc("call_count"), "class_fqn")


def find_start(g: Graph, wanted: DataFrame) -> DataFrame:
    """For rows (project, class_fqn, method): the signature of the first of: that class's method; a class of that simple name;
    an implementation of an interface of that name. Ties: the smallest signature."""
    m = g.owned.where("project IS NOT NULL").select("project", F.col("name").alias("method"), "fqn", "class_name", "signature", "kind", "type_id")
    wanted = wanted.withColumn("simple", simple_name(F.col("class_fqn")))
    a = wanted.join(m, ["project", "method"]).where("fqn = class_fqn").select("project", "class_fqn", "method", F.lit(1).alias("rank"), "signature")
    b = wanted.join(m, ["project", "method"]).where("class_name = simple").select("project", "class_fqn", "method", F.lit(2).alias("rank"), "signature")
    iface = g.contained.where("kind = 'INTERFACE'").select("project", F.col("fqn").alias("i_fqn"), F.col("name").alias("i_name"), F.col("type_id").alias("dst"))
    impl = wanted.join(iface, "project").where("i_fqn = class_fqn OR i_name = simple").join(g.implements, "dst").join(g.method.select(F.col("type_id").alias("src"), F.col("name").alias("method"), "signature"), ["src", "method"])
    c = impl.select("project", "class_fqn", "method", F.lit(3).alias("rank"), "signature")
    best = a.union(b).union(c).groupBy("project", "class_fqn", "method").agg(F.min(F.struct("rank", "signature")).alias("x"))
    return best.select("project", "class_fqn", "method", F.col("x.rank").cast("long").alias("rank"), F.col("x.signature").alias("signature"))


@on_graph("trv_11_start_methods", """WITH q AS (SELECT DISTINCT p.name AS project, CASE WHEN t.type_id % 2 = 0 THEN t.fqn ELSE 'other.' || t.name END AS class_fqn, 'm' || CAST(t.type_id % 8 AS VARCHAR) AS method FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id),
k AS (SELECT q.*, string_split(q.class_fqn, '.')[-1] AS simple FROM q),
o AS (SELECT p.name AS project, t.fqn, t.name AS class_name, m.name AS method, m.signature FROM fx_method m JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id),
c AS (SELECT k.project, k.class_fqn, k.method, 1 AS rank, o.signature FROM k JOIN o USING (project, method) WHERE o.fqn = k.class_fqn
UNION ALL SELECT k.project, k.class_fqn, k.method, 2, o.signature FROM k JOIN o USING (project, method) WHERE o.class_name = k.simple
UNION ALL SELECT k.project, k.class_fqn, k.method, 3, m.signature FROM k JOIN fx_project p ON p.name = k.project JOIN fx_type i ON i.project_id = p.project_id AND i.kind = 'INTERFACE' AND (i.fqn = k.class_fqn OR i.name = k.simple) JOIN fx_implements x ON x.dst = i.type_id JOIN fx_method m ON m.type_id = x.src AND m.name = k.method)
SELECT project, class_fqn, method, CAST(rank AS BIGINT) AS rank, signature FROM (SELECT *, row_number() OVER (PARTITION BY project, class_fqn, method ORDER BY rank, signature) AS rn FROM c) WHERE rn = 1""")
def _trv11(g: Graph) -> DataFrame:
    t = g.contained
    wanted = t.select("project", F.when(F.col("type_id") % 2 == 0, F.col("fqn")).otherwise(F.concat(F.lit("other."), F.col("name"))).alias("class_fqn"), F.concat(F.lit("m"), (F.col("type_id") % 8).cast("string")).alias("method")).distinct()
    return find_start(g, wanted)


@on_graph("trv_12_implementations", f"WITH {_IMPL} SELECT a.signature AS interface_method, b.signature AS impl_method FROM x JOIN fx_method a ON a.method_id = x.iface JOIN fx_method b ON b.method_id = x.node")
def _trv12(g: Graph) -> DataFrame:
    x = _same_name_impl(g, g.method.select(F.col("method_id").alias("iface_method")))
    sig = lambda c, n: g.method.select(F.col("method_id").alias(c), F.col("signature").alias(n))
    return x.join(sig("iface_method", "interface_method"), "iface_method").join(sig("impl_method", "impl_signature"), "impl_method").select("interface_method", F.col("impl_signature").alias("impl_method"))


def downstream(g: Graph, methods: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node): implementing methods behind the Dubbo calls of what is reached over CALLS."""
    nodes = reach(g.calls("CALLS"), methods, depth).select(F.col("node").alias("src")).distinct()
    called = g.calls("DUBBO_CALLS").join(nodes, "src").select(F.col("dst").alias("m")).distinct()
    # by interface and method name, as a call record has them: every overload of the interface counts
    named = g.method.join(called, F.col("method_id") == F.col("m"), "left_semi").select("type_id", "name").distinct()
    return _same_name_impl(g, g.method.join(named, ["type_id", "name"]).select(F.col("method_id").alias("iface_method"))).select(F.col("impl_method").alias("node")).distinct()


_DOWN = """dn AS (SELECT DISTINCT x.node FROM (SELECT DISTINCT node FROM w) w JOIN fx_call e ON e.src = w.node AND e.rel_type = 'DUBBO_CALLS' JOIN fx_method c ON c.method_id = e.dst
 JOIN fx_method o ON o.type_id = c.type_id AND o.name = c.name JOIN x ON x.iface = o.method_id)"""


@on_graph("trv_13_dubbo_downstream", f"""WITH {START}, {_walk("'CALLS'")}, {_IMPL}, {_DOWN} SELECT m.signature AS impl_signature, p.name AS impl_project FROM dn JOIN fx_method m ON m.method_id = dn.node JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_project p ON p.project_id = t.project_id""")
def _trv13(g: Graph) -> DataFrame:
    return downstream(g, start(g)).join(g.owned, F.col("node") == F.col("method_id")).select(F.col("signature").alias("impl_signature"), F.col("project").alias("impl_project"))


def endpoints(g: Graph, methods: DataFrame) -> DataFrame:
    """Endpoints of the methods, of the interface methods they implement, and of those that call these over Dubbo
    (their own, else their interfaces'). One row per class, method, path and verb: the one with the smallest project."""
    m = g.owned
    ep = g.endpoint
    start_m = m.join(methods.select(F.col("node").alias("method_id")).distinct(), "method_id", "left_semi")
    cols = [F.coalesce("project", F.lit("")).alias("project"), F.col("fqn").alias("class_fqn"), F.col("name").alias("method"), "path", "http_method"]
    own = start_m.join(ep, "method_id").select(*cols)
    up = g.implements.join(g.type.where("kind = 'INTERFACE'").select(F.col("type_id").alias("dst"), F.col("fqn").alias("i_fqn")), "dst")
    im = g.method.select(F.col("type_id").alias("dst"), "name", F.col("method_id").alias("i_method"))
    over = start_m.select(F.col("type_id").alias("src"), "name").join(up, "src").join(im, ["dst", "name"])
    of_iface = over.join(ep.withColumnRenamed("method_id", "i_method"), "i_method").select(F.lit("").alias("project"), F.col("i_fqn").alias("class_fqn"), F.col("name").alias("method"), "path", "http_method")
    caller = g.calls("DUBBO_CALLS").join(over.select(F.col("i_method").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("method_id")).distinct().join(m, "method_id")
    direct = caller.join(ep, "method_id", "left").withColumnsRenamed({"path": "p1", "http_method": "h1"})
    more = up.where(~F.col("i_fqn").contains("java.util")).join(im, "dst").join(ep.withColumnRenamed("method_id", "i_method"), "i_method").select(F.col("src").alias("type_id"), "name", F.col("path").alias("p2"), F.col("http_method").alias("h2"))
    by = direct.join(more, ["type_id", "name"], "left").withColumn("path", F.coalesce("p1", "p2")).withColumn("http_method", F.coalesce("h1", "h2")).where("path IS NOT NULL").select(*cols)
    return own.union(of_iface).union(by).groupBy("class_fqn", "method", "path", "http_method").agg(F.min("project").alias("project"))


@on_graph("trv_14_endpoints", f"""WITH s AS (SELECT method_id AS node FROM fx_method),
up AS (SELECT i.src, i.dst, t.fqn FROM fx_implements i JOIN fx_type t ON t.type_id = i.dst AND t.kind = 'INTERFACE'),
ov AS (SELECT DISTINCT up.fqn, im.method_id, im.name FROM s JOIN fx_method m ON m.method_id = s.node JOIN up ON up.src = m.type_id JOIN fx_method im ON im.type_id = up.dst AND im.name = m.name),
a AS (SELECT coalesce(p.name, '') AS project, t.fqn AS class_fqn, m.name AS method, e.path, e.http_method FROM s JOIN fx_method m ON m.method_id = s.node JOIN fx_endpoint e USING (method_id) JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_project p ON p.project_id = t.project_id
UNION ALL SELECT '', ov.fqn, ov.name, e.path, e.http_method FROM ov JOIN fx_endpoint e USING (method_id)
UNION ALL SELECT coalesce(p.name, ''), t.fqn, m.name, coalesce(e1.path, e2.path), coalesce(e1.http_method, e2.http_method) FROM (SELECT DISTINCT c.src FROM fx_call c JOIN ov ON ov.method_id = c.dst WHERE c.rel_type = 'DUBBO_CALLS') c
 JOIN fx_method m ON m.method_id = c.src JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_project p ON p.project_id = t.project_id LEFT JOIN fx_endpoint e1 ON e1.method_id = m.method_id
 LEFT JOIN (SELECT up.src, im.name, e.path, e.http_method FROM up JOIN fx_method im ON im.type_id = up.dst JOIN fx_endpoint e ON e.method_id = im.method_id WHERE up.fqn NOT LIKE '%java.util%') e2 ON e2.src = t.type_id AND e2.name = m.name)
SELECT class_fqn, method, path, http_method, min(project) AS project FROM a WHERE path IS NOT NULL GROUP BY ALL""")
def _trv14(g: Graph) -> DataFrame:
    return endpoints(g, g.method.select(F.col("method_id").alias("node")))


def _class_starts(g: Graph) -> DataFrame:
    """Methods of the start class, or, if it is an interface, of its implementations too."""
    s = g.calls("CALLS").join(g.method.select(F.col("method_id").alias("src"), "type_id"), "src").join(g.type.where("kind = 'CLASS'").select("type_id"), "type_id").groupBy("type_id").count().orderBy(F.desc("count"), "type_id").limit(1)
    m = g.method.join(s, "type_id", "left_semi")
    return m.select(F.col("method_id").alias("source"), F.col("method_id").alias("node"), F.lit(0).alias("depth"))


_CLASS_START = "s AS (SELECT m.method_id AS node FROM fx_method m WHERE m.type_id = (SELECT m2.type_id FROM fx_call e JOIN fx_method m2 ON m2.method_id = e.src JOIN fx_type t ON t.type_id = m2.type_id AND t.kind = 'CLASS' WHERE e.rel_type = 'CALLS' GROUP BY m2.type_id ORDER BY count(*) DESC, m2.type_id LIMIT 1))"
_LEN = "w(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.dst, w.d + 1 FROM w JOIN fx_call e ON e.src = w.node WHERE w.d < 6)"


_TABLES = "SELECT DISTINCT mt.table_name, t.name AS mapper_name, m.name AS mapper_method, CAST(w.d AS BIGINT) AS call_depth FROM w JOIN fx_method m ON m.method_id = w.node JOIN fx_type t ON t.type_id = m.type_id AND t.kind = 'MAPPER' JOIN fx_mapper_table mt ON mt.src = t.type_id WHERE w.d > 0"
_SERVICES = "SELECT DISTINCT t.fqn AS service_fqn, t.name AS service_name, m.name AS method_name, CAST(w.d AS BIGINT) AS call_depth, w.via AS via_field FROM w JOIN fx_method m ON m.method_id = w.node JOIN fx_type t ON t.type_id = m.type_id WHERE w.via IS NOT NULL AND (t.is_external OR t.project_id IS NULL)"
_VIA = "coalesce(w.via, CASE WHEN e.rel_type = 'DUBBO_CALLS' THEN e.via_field END)"
#: Walks that use no edge twice, by the list of those used.
_TRAIL = f"w(node, d, via, used) AS (SELECT node, 0, CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM s UNION ALL SELECT e.dst, w.d + 1, {_VIA}, list_append(w.used, e.src || '>' || e.dst) FROM w JOIN fx_call e ON e.src = w.node WHERE w.d < 5 AND NOT list_contains(w.used, e.src || '>' || e.dst))"


def class_tables(g: Graph, starts: DataFrame, depth: int, exact: bool = False) -> DataFrame:
    """Tables that mapper methods at any distance from the starts read, with every distance: of walks, or (exact) of trails only."""
    mappers = g.owned.where("kind = 'MAPPER'")
    ends = written(mappers.select(F.col("method_id").alias("node"))) if exact else None
    walk = lengths(g.call.select("src", "dst"), starts, depth, exact=exact, ends=ends).where("depth > 0").select(F.col("node").alias("method_id"), "depth").distinct()
    out = walk.join(mappers, "method_id").join(g.mapper_table.withColumnRenamed("src", "type_id"), "type_id")
    return out.select("table_name", F.col("class_name").alias("mapper_name"), F.col("name").alias("mapper_method"), F.col("depth").cast("long").alias("call_depth")).distinct()


def class_services(g: Graph, starts: DataFrame, depth: int, exact: bool = False) -> DataFrame:
    """Outside services that calls from the starts come to after a remote call, with every distance and the first remote call's field."""
    seeds = starts.withColumn("via", F.lit(None).cast("string"))
    far = g.owned.where("is_external OR project_id IS NULL")
    ends = written(far.select(F.col("method_id").alias("node"))) if exact else None
    walk = lengths(g.call, seeds, depth, {"via": F.coalesce("via", F.when(F.col("rel_type") == "DUBBO_CALLS", F.col("via_field")))}, exact, ends).where("via IS NOT NULL")
    out = walk.select(F.col("node").alias("method_id"), "depth", "via").distinct().join(far, "method_id")
    return out.select(F.col("fqn").alias("service_fqn"), F.col("class_name").alias("service_name"), F.col("name").alias("method_name"), F.col("depth").cast("long").alias("call_depth"), F.col("via").alias("via_field")).distinct()


@on_graph("trv_15_class_tables_all_depths", f"WITH {_CLASS_START}, {_LEN} {_TABLES}")
def _trv15(g: Graph) -> DataFrame:
    return class_tables(g, _class_starts(g), 6)


@on_graph("trv_15_class_tables_by_trails", f"WITH {_CLASS_START}, {_TRAIL} {_TABLES}")
def _trv15_trails(g: Graph) -> DataFrame:
    return class_tables(g, _class_starts(g), 5, exact=True)


@on_graph("trv_16_class_dubbo_services", f"WITH {_CLASS_START}, w(node, d, via) AS (SELECT node, 0, CAST(NULL AS VARCHAR) FROM s UNION SELECT e.dst, w.d + 1, {_VIA} FROM w JOIN fx_call e ON e.src = w.node WHERE w.d < 6) {_SERVICES}")
def _trv16(g: Graph) -> DataFrame:
    return class_services(g, _class_starts(g), 6)


@on_graph("trv_16_class_dubbo_services_by_trails", f"WITH {_CLASS_START}, {_TRAIL} {_SERVICES}")
def _trv16_trails(g: Graph) -> DataFrame:
    return class_services(g, _class_starts(g), 5, exact=True)


@on_graph("trv_17_involved_classes", f"""WITH {_CLASS_START}, {_LEN.replace("w.d < 6", "w.d < 15")} SELECT t.fqn AS class_fqn, p.name AS project, t.arch_layer, CAST(min(w.d) AS BIGINT) AS min_depth FROM w JOIN fx_method m ON m.method_id = w.node JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id WHERE w.d > 0 GROUP BY ALL""")
def _trv17(g: Graph) -> DataFrame:
    seeds = _class_starts(g).select(F.lit(0).cast("long").alias("source"), "node")
    hit = reach(g.call, seeds, 15, zero=False).select(F.col("node").alias("method_id"), "depth").join(g.owned.where("project IS NOT NULL"), "method_id")
    return hit.groupBy(F.col("fqn").alias("class_fqn"), "project", "arch_layer").agg(F.min("depth").cast("long").alias("min_depth"))


@on_graph("trv_18_quick_summary", f"""WITH {_CLASS_START}, {_LEN.replace("w.d < 6", "w.d < 15")}, r AS (SELECT DISTINCT node FROM w WHERE d > 0)
SELECT count(DISTINCT t.type_id) AS n_classes, count(DISTINCT mt.table_name) AS n_tables, count(DISTINCT CASE WHEN t.project_id IS NULL THEN t.type_id END) AS n_external FROM r JOIN fx_method m ON m.method_id = r.node JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_mapper_table mt ON mt.src = t.type_id""")
def _trv18(g: Graph) -> DataFrame:
    seeds = _class_starts(g).select(F.lit(0).cast("long").alias("source"), "node")
    hit = reach(g.call, seeds, 15, zero=False).select(F.col("node").alias("method_id")).join(g.owned, "method_id").select("type_id", "project_id").distinct()
    hit = hit.join(g.mapper_table.withColumnRenamed("src", "type_id"), "type_id", "left")
    return hit.agg(F.countDistinct("type_id").alias("n_classes"), F.countDistinct("table_name").alias("n_tables"), F.countDistinct(F.when(F.col("project_id").isNull(), F.col("type_id"))).alias("n_external"))


def upstream(g: Graph, methods: DataFrame, depth: int = 5) -> DataFrame:
    """(source, node, depth): methods from which the given ones are reached over 1 to depth edges of any type."""
    back = g.call.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, methods, depth, zero=False)


@on_graph("trv_22_upstream", """WITH s AS (SELECT dst AS node FROM fx_call GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), f(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.src, f.d + 1 FROM f JOIN fx_call e ON e.dst = f.node WHERE f.d < 5)
SELECT m.signature, CAST(min(f.d) AS BIGINT) AS depth FROM f JOIN fx_method m ON m.method_id = f.node WHERE f.d > 0 GROUP BY m.signature""")
def _trv22(g: Graph) -> DataFrame:
    top = g.call.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select(F.col("dst").alias("source"), F.col("dst").alias("node"))
    return upstream(g, top).join(g.method, F.col("node") == F.col("method_id")).select("signature", F.col("depth").cast("long").alias("depth"))


def full_chain(g: Graph, methods: DataFrame, depth: int = DEPTH) -> dict[str, DataFrame]:
    """All result sets of a chain: the start methods with their implementations, and for tables, jobs and queues the methods
    behind Dubbo calls too."""
    impl = _same_name_impl(g, methods.select(F.col("node").alias("iface_method"))).select(F.col("impl_method").alias("source"), F.col("impl_method").alias("node"))
    begin = written(methods.select("source", "node").union(impl).distinct())
    down = downstream(g, begin, depth)
    every = written(begin.union(down.select(F.col("node").alias("source"), "node")).distinct())
    return {
        "endpoints": endpoints(g, begin),
        "internal_classes": internal_classes(g, every, depth),
        "dubbo_calls": dubbo_calls(g, begin, depth),
        "tables": tables(g, every),
        "aries_jobs": jobs(g, every, depth),
        "mq_info": mq_consumers(g, every, depth).unionByName(mq_producers(g, every, depth)),
    }


_FULL = f"""{START}, {_IMPL}, b AS (SELECT node FROM s UNION SELECT x.node FROM x JOIN s ON s.node = x.iface),
w(node, d) AS (SELECT node, 0 FROM b UNION SELECT e.dst, w.d + 1 FROM w JOIN fx_call e ON e.src = w.node WHERE w.d < 10 AND e.rel_type = 'CALLS'), {_DOWN}, a AS (SELECT node FROM b UNION SELECT node FROM dn),
c(node, d) AS (SELECT node, 0 FROM a UNION SELECT e.dst, c.d + 1 FROM c JOIN fx_call e ON e.src = c.node WHERE c.d < 10 AND e.rel_type IN ('CALLS', 'DB_CALL')),
j(node, d) AS (SELECT node, 0 FROM a UNION SELECT e.dst, j.d + 1 FROM j JOIN fx_call e ON e.src = j.node WHERE j.d < 10),
a8(node, d) AS (SELECT node, 0 FROM a UNION SELECT e.dst, a8.d + 1 FROM a8 JOIN fx_call e ON e.src = a8.node WHERE a8.d < 8 AND e.rel_type = 'CALLS'),
v(node, d, db) AS (SELECT DISTINCT x.node, 0, false FROM x JOIN a8 ON a8.node = x.iface AND a8.d > 0 UNION SELECT e.dst, v.d + 1, v.db OR e.rel_type = 'DB_CALL' FROM v JOIN fx_call e ON e.src = v.node WHERE v.d < 5 AND e.rel_type IN ('CALLS', 'DB_CALL')),
ac AS (SELECT a.node FROM a JOIN fx_method m ON m.method_id = a.node JOIN fx_type t ON t.type_id = m.type_id WHERE t.project_id IS NOT NULL),
k(node, d) AS (SELECT node, 0 FROM ac UNION SELECT e.dst, k.d + 1 FROM k JOIN fx_call e ON e.src = k.node WHERE k.d < 10 AND e.rel_type IN ('CALLS', 'DB_CALL')),
q AS (SELECT DISTINCT p.name AS project, t.fqn, f.mq_type, f.topic, f.role, m.name AS method FROM fx_mq f JOIN fx_method m ON m.method_id = f.method_id JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id
 WHERE f.role = 'consumer' AND t.kind <> 'INTERFACE' AND f.method_id IN (SELECT node FROM k) OR f.role = 'producer' AND f.method_id IN (SELECT node FROM j)),
r_classes AS (SELECT DISTINCT p.name AS x, t.fqn AS y, coalesce(t.arch_layer, 'Other') AS z FROM c JOIN fx_method m ON m.method_id = c.node JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id WHERE NOT t.is_external),
r_dubbo AS ({_DUBBO}),
r_jobs AS (SELECT DISTINCT p.name AS x, t.fqn AS y, q.job_type AS z, q.cron_expr FROM j JOIN fx_job q ON q.method_id = j.node JOIN fx_method m ON m.method_id = j.node JOIN fx_type t ON t.type_id = m.type_id AND t.kind = 'ARIES_JOB' JOIN fx_project p ON p.project_id = t.project_id),
r_tables AS (SELECT DISTINCT p.name AS x, t.fqn AS y, mt.table_name AS z FROM v JOIN fx_method m ON m.method_id = v.node JOIN fx_type t ON t.type_id = m.type_id AND t.kind = 'MAPPER' JOIN fx_project p ON p.project_id = t.project_id LEFT JOIN fx_mapper_table mt ON mt.src = t.type_id WHERE v.db AND v.d > 0),
up AS (SELECT i.src, i.dst, t.fqn FROM fx_implements i JOIN fx_type t ON t.type_id = i.dst AND t.kind = 'INTERFACE'),
ov AS (SELECT DISTINCT up.fqn, im.method_id, im.name FROM b JOIN fx_method m ON m.method_id = b.node JOIN up ON up.src = m.type_id JOIN fx_method im ON im.type_id = up.dst AND im.name = m.name),
ep AS (SELECT coalesce(p.name, '') AS project, t.fqn, m.name, e.path, e.http_method FROM b JOIN fx_method m ON m.method_id = b.node JOIN fx_endpoint e USING (method_id) JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_project p ON p.project_id = t.project_id
 UNION ALL SELECT '', ov.fqn, ov.name, e.path, e.http_method FROM ov JOIN fx_endpoint e USING (method_id)
 UNION ALL SELECT coalesce(p.name, ''), t.fqn, m.name, coalesce(e1.path, e2.path), coalesce(e1.http_method, e2.http_method) FROM (SELECT DISTINCT z.src FROM fx_call z JOIN ov ON ov.method_id = z.dst WHERE z.rel_type = 'DUBBO_CALLS') z
 JOIN fx_method m ON m.method_id = z.src JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_project p ON p.project_id = t.project_id LEFT JOIN fx_endpoint e1 ON e1.method_id = m.method_id
 LEFT JOIN (SELECT up.src, im.name, e.path, e.http_method FROM up JOIN fx_method im ON im.type_id = up.dst JOIN fx_endpoint e ON e.method_id = im.method_id WHERE up.fqn NOT LIKE '%java.util%') e2 ON e2.src = t.type_id AND e2.name = m.name),
r_endpoints AS (SELECT fqn, name, path, http_method, min(project) AS project FROM ep WHERE path IS NOT NULL GROUP BY ALL)"""


@on_graph("trv_21_full_chain", f"""WITH {_FULL}
SELECT 'internal_classes' AS result, x AS project, y AS one, z AS other FROM r_classes UNION ALL SELECT 'aries_jobs', x, y, z FROM r_jobs UNION ALL SELECT 'tables', x, y, z FROM r_tables UNION ALL SELECT 'endpoints', project, fqn, http_method || ' ' || path FROM r_endpoints
UNION ALL SELECT 'mq_info', project, fqn, role || ' ' || topic FROM q UNION ALL SELECT 'dubbo_calls', target_project, caller_class, dubbo_interface || '.' || dubbo_method FROM r_dubbo""")
def _trv21(g: Graph) -> DataFrame:
    """The rows of all six result sets of a chain."""
    x = full_chain(g, start(g))
    rows = x["internal_classes"].select(F.lit("internal_classes").alias("result"), "project", F.col("class_fqn").alias("one"), F.col("arch_layer").alias("other"))
    rows = rows.union(x["aries_jobs"].select(F.lit("aries_jobs"), "project", "class_fqn", "job_type")).union(x["tables"].select(F.lit("tables"), "project", "mapper_fqn", "table_name"))
    rows = rows.union(x["endpoints"].select(F.lit("endpoints"), "project", "class_fqn", F.concat_ws(" ", "http_method", "path"))).union(x["mq_info"].select(F.lit("mq_info"), "project", "class_fqn", F.concat_ws(" ", "role", "topic")))
    return rows.union(x["dubbo_calls"].select(F.lit("dubbo_calls"), "target_project", "caller_class", F.concat_ws(".", "dubbo_interface", "dubbo_method")))


def call_statistics(sets: dict[str, DataFrame]) -> DataFrame:
    """(name, n, records): the result sets of a chain under the names of the statistics view, each as JSON records."""
    out = None
    for name, of in (("class_stats", "internal_classes"), ("tables", "tables"), ("mq_list", "mq_info"), ("frontend_entries", "endpoints"), ("dubbo_calls", "dubbo_calls")):
        one = records(sets[of]).select(F.lit(name).alias("name"), "n", "records")
        out = one if out is None else out.union(one)
    return out


def records(df: DataFrame) -> DataFrame:
    """(n, records): a result set, bounded by what is reached, as one JSON array in the order of its columns."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(row.alias("r")).agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("r")), ","), F.lit("]")).alias("records"))


def result_json(sets: dict[str, DataFrame], message: str = "") -> DataFrame:
    """(result): all sets of a chain as one nested JSON object (success, message, and an array of records per set)."""
    parts = None
    for name, df in sets.items():
        one = records(df).select(F.concat(F.lit(f'"{name}":'), "records").alias("part"))
        parts = one if parts is None else parts.union(one)
    head = F.lit(f'{{"success":true,"message":{json.dumps(message, ensure_ascii=False)},')
    return parts.agg(F.concat(head, F.array_join(F.sort_array(F.collect_list("part")), ","), F.lit("}")).alias("result"))


@on_graph("agg_11_call_statistics", f"""WITH {_FULL} SELECT 'class_stats' AS name, count(*) AS n FROM r_classes UNION ALL SELECT 'tables', count(*) FROM r_tables UNION ALL SELECT 'mq_list', count(*) FROM q UNION ALL SELECT 'frontend_entries', count(*) FROM r_endpoints UNION ALL SELECT 'dubbo_calls', count(*) FROM r_dubbo""")
def _agg11(g: Graph) -> DataFrame:
    return call_statistics(full_chain(g, start(g))).select("name", F.size(F.from_json("records", "array<map<string,string>>")).cast("long").alias("n"))


@on_graph("agg_09_chain_summary", f"""WITH {_CLASS_START}, {_LEN.replace("w.d < 6", "w.d < 15")}, r AS (SELECT DISTINCT t.type_id, p.name AS project, coalesce(t.arch_layer, 'Other') AS layer FROM w JOIN fx_method m ON m.method_id = w.node JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id WHERE w.d > 0),
n AS (SELECT project, layer, count(*) AS n FROM r GROUP BY ALL) SELECT project, CAST(sum(n) AS BIGINT) AS total_classes, string_agg(layer || '=' || n, ',' ORDER BY layer) AS layers FROM n GROUP BY project""")
def _agg09(g: Graph) -> DataFrame:
    """Per project: the classes of a chain, and how many of each layer."""
    seeds = _class_starts(g).select(F.lit(0).cast("long").alias("source"), "node")
    hit = reach(g.call, seeds, 15, zero=False).select(F.col("node").alias("method_id")).join(g.owned.where("project IS NOT NULL"), "method_id").select("type_id", "project", F.coalesce("arch_layer", F.lit("Other")).alias("layer")).distinct()
    n = hit.groupBy("project", "layer").agg(F.count("*").alias("n"))
    return n.groupBy("project").agg(F.sum("n").alias("total_classes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "n"))), lambda x: F.concat_ws("=", x["layer"], x["n"].cast("string"))), ",").alias("layers"))


@on_graph("trv_23_tree_tables_and_topics", f"""WITH {START}, {_TREE}, z AS (SELECT DISTINCT node FROM t), h(source, node, d) AS (SELECT node, node, 0 FROM z UNION SELECT h.source, e.dst, h.d + 1 FROM h JOIN fx_call e ON e.src = h.node WHERE h.d < 3 AND e.rel_type IN ('CALLS', 'DB_CALL'))
SELECT DISTINCT 'table' AS what, mt.table_name AS name FROM h JOIN fx_method m ON m.method_id = h.node JOIN fx_type y ON y.type_id = m.type_id AND y.kind = 'MAPPER' JOIN fx_mapper_table mt ON mt.src = y.type_id WHERE h.d > 0 UNION SELECT 'topic', f.topic FROM z JOIN fx_mq f ON f.method_id = z.node""")
def _trv23t(g: Graph) -> DataFrame:
    """Tables reached over 1-3 calls from the nodes of a call tree, and the topics of these nodes."""
    nodes = simple_paths(lambda at: _children(g, at), start(g).select("node"), 4).select("node").distinct()
    to = reach(g.calls("CALLS", "DB_CALL"), nodes.select(F.lit(0).cast("long").alias("source"), "node"), 3, zero=False).select(F.col("node").alias("method_id"))
    mapper = to.join(g.owned.where("kind = 'MAPPER'").select("method_id", "type_id"), "method_id").join(g.mapper_table.withColumnRenamed("src", "type_id"), "type_id")
    topic = g.mq.join(nodes.withColumnRenamed("node", "method_id"), "method_id", "left_semi")
    return mapper.select(F.lit("table").alias("what"), F.col("table_name").alias("name")).union(topic.select(F.lit("topic"), "topic")).distinct()


@on_graph("dsg_08_callers_of_tables", "WITH b(t, node, d) AS (SELECT DISTINCT mt.table_name, m.method_id, 0 FROM fx_mapper_table mt JOIN fx_method m ON m.type_id = mt.src UNION SELECT b.t, e.src, b.d + 1 FROM b JOIN fx_call e ON e.dst = b.node WHERE b.d < 3 AND e.rel_type IN ('CALLS', 'DB_CALL')) SELECT DISTINCT b.t AS table_name, p.name AS project FROM b JOIN fx_method m ON m.method_id = b.node JOIN fx_type y ON y.type_id = m.type_id JOIN fx_project p ON p.project_id = y.project_id WHERE b.d > 0")
def _dsg08t(g: Graph) -> DataFrame:
    """Projects with a method from which a table is reached over 1-3 calls."""
    own = g.mapper_table.withColumnRenamed("src", "type_id").join(g.method.select("type_id", "method_id"), "type_id").select(F.col("table_name").alias("source"), F.col("method_id").alias("node")).distinct()
    back = g.calls("CALLS", "DB_CALL").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = reach(back, own, 3, zero=False).select(F.col("source").alias("table_name"), F.col("node").alias("method_id"))
    return hit.join(g.owned.where("project IS NOT NULL").select("method_id", "project"), "method_id").select("table_name", "project").distinct()


@on_graph("dsg_08_url_to_classes", f"WITH s AS (SELECT method_id AS node FROM fx_endpoint WHERE path = '/api/o10'), {_walk(chr(39) + 'CALLS' + chr(39) + ', ' + chr(39) + 'DB_CALL' + chr(39))} SELECT DISTINCT p.name AS project, t.fqn AS class_fqn FROM w JOIN fx_method m ON m.method_id = w.node JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id WHERE NOT t.is_external")
def _dsg08u(g: Graph) -> DataFrame:
    """The classes of the chain behind a URL."""
    at = g.endpoint.where("path = '/api/o10'").select(F.col("method_id").alias("source"), F.col("method_id").alias("node"))
    return internal_classes(g, at).select("project", "class_fqn")
