"""Statistics, structure analytics and the ad-hoc question shapes over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_noise, passes_text_filter, risk
from ..sources.graph import Graph
from ..sources.store import small, written
from .registry import on_graph


def _types(g: Graph, side: str, *cols: str) -> DataFrame:
    """Types renamed to join one end of an edge: the id as `side`, other columns as side_name."""
    return g.type.select(F.col("type_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in cols))


def dependencies(g: Graph) -> DataFrame:
    """DEPENDS_ON with both classes and their projects."""
    p = lambda s: g.project_name.select(F.col("project_id").alias(f"{s}_project_id"), F.col("project").alias(f"{s}_project"))
    d = g.depends_on.join(_types(g, "src", "fqn", "project_id", "package"), "src").join(_types(g, "dst", "fqn", "project_id", "package"), "dst")
    return d.join(p("src"), "src_project_id", "left").join(p("dst"), "dst_project_id", "left")


_DEP = """d AS (SELECT e.src, e.dst, a.fqn AS src_fqn, b.fqn AS dst_fqn, a.package AS src_package, b.package AS dst_package, p.name AS src_project, q.name AS dst_project
 FROM fx_depends_on e JOIN fx_type a ON a.type_id = e.src JOIN fx_type b ON b.type_id = e.dst LEFT JOIN fx_project p ON p.project_id = a.project_id LEFT JOIN fx_project q ON q.project_id = b.project_id)"""
_OWN = """o AS (SELECT m.method_id, m.name AS method, m.signature, m.type_id, t.fqn, t.name AS class_name, t.kind, t.arch_layer, t.package, t.is_external, t.project_id, p.name AS project
 FROM fx_method m JOIN fx_type t ON t.type_id = m.type_id LEFT JOIN fx_project p ON p.project_id = t.project_id)"""


@on_graph("agg_01_global_counts", "SELECT (SELECT count(*) FROM fx_project) AS projects, (SELECT count(*) FROM fx_type) AS types, (SELECT count(*) FROM fx_method) AS methods, (SELECT count(*) FROM fx_call) AS calls")
def _agg01(g: Graph) -> DataFrame:
    parts = [df.agg(F.count("*").alias(n)) for n, df in (("projects", g.project), ("types", g.type), ("methods", g.method), ("calls", g.call))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@on_graph("agg_02_label_counts", "SELECT kind AS label, count(*) AS n FROM fx_type GROUP BY kind UNION ALL SELECT 'Method', count(*) FROM fx_method UNION ALL SELECT 'Project', count(*) FROM fx_project")
def _agg02(g: Graph) -> DataFrame:
    return g.type.groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("n")).union(g.method.agg(F.lit("Method"), F.count("*"))).union(g.project.agg(F.lit("Project"), F.count("*"))).orderBy(F.desc("n"), "label")


@on_graph("agg_02_relationship_counts", "SELECT rel_type, count(*) AS n FROM fx_call GROUP BY rel_type UNION ALL SELECT 'IMPLEMENTS', count(*) FROM fx_implements UNION ALL SELECT 'DEPENDS_ON', count(*) FROM fx_depends_on")
def _agg02r(g: Graph) -> DataFrame:
    out = g.call.groupBy("rel_type").agg(F.count("*").alias("n"))
    for n, df in (("IMPLEMENTS", g.implements), ("DEPENDS_ON", g.depends_on)):
        out = out.union(df.agg(F.lit(n), F.count("*")))
    return out.orderBy(F.desc("n"), "rel_type")


@on_graph("agg_03_project_stats", """SELECT p.name AS project, count(DISTINCT t.type_id) AS n_types, count(DISTINCT m.method_id) AS n_methods, count(DISTINCT c.src || ':' || c.dst) AS n_calls
FROM fx_project p LEFT JOIN fx_type t ON t.project_id = p.project_id LEFT JOIN fx_method m ON m.type_id = t.type_id LEFT JOIN fx_call c ON c.src = m.method_id GROUP BY p.name""")
def _agg03(g: Graph) -> DataFrame:
    """Each measure is aggregated on its own before the join, so no fan-out is counted away."""
    t = g.type.groupBy("project_id").agg(F.count("*").alias("n_types"))
    m = g.owned.groupBy("project_id").agg(F.count("*").alias("n_methods"))
    c = g.call.groupBy(F.col("src").alias("method_id")).agg(F.count("*").alias("k")).join(g.owned.select("method_id", "project_id"), "method_id").groupBy("project_id").agg(F.sum("k").alias("n_calls"))
    out = g.project.join(t, "project_id", "left").join(m, "project_id", "left").join(c, "project_id", "left")
    return out.select(F.col("name").alias("project"), *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_types", "n_methods", "n_calls")))


@on_graph("agg_05_collect_slice", "SELECT project, CAST(len(list(DISTINCT fqn)) AS BIGINT) AS n, list_slice(list_sort(list(DISTINCT fqn)), 1, 3)[1] AS first_fqn FROM (SELECT t.fqn, p.name AS project FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id) GROUP BY project")
def _agg05(g: Graph) -> DataFrame:
    return g.contained.groupBy("project").agg(F.countDistinct("fqn").alias("n"), F.min("fqn").alias("first_fqn"))


@on_graph("agg_06_module_coupling", f"WITH {_DEP} SELECT src_project, dst_project, count(DISTINCT src) AS dependents, count(DISTINCT dst) AS dependencies, count(*) AS total FROM d WHERE src_project <> dst_project GROUP BY ALL")
def _agg06(g: Graph) -> DataFrame:
    d = dependencies(g).where("src_project <> dst_project")
    return d.groupBy("src_project", "dst_project").agg(F.countDistinct("src").alias("dependents"), F.countDistinct("dst").alias("dependencies"), F.count("*").alias("total"))


@on_graph("agg_07_project_pairs_top10", f"WITH {_DEP} SELECT src_project, dst_project, count(*) AS n FROM d WHERE src_project IS NOT NULL AND dst_project IS NOT NULL AND src_project <> dst_project GROUP BY ALL ORDER BY n DESC, src_project, dst_project LIMIT 10")
def _agg07(g: Graph) -> DataFrame:
    d = dependencies(g).where("src_project <> dst_project").groupBy("src_project", "dst_project").agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "src_project", "dst_project").limit(10)


@on_graph("agg_07_calls_per_project_top20", f"WITH {_OWN} SELECT o.project, count(*) AS n FROM fx_call c JOIN o ON o.method_id = c.src WHERE o.project IS NOT NULL AND c.rel_type = 'CALLS' GROUP BY o.project ORDER BY n DESC, o.project LIMIT 20")
def _agg07c(g: Graph) -> DataFrame:
    c = g.calls("CALLS").join(g.owned.where("project IS NOT NULL").select(F.col("method_id").alias("src"), "project"), "src")
    return c.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(20)


@on_graph("agg_08_nested_groups", "SELECT p.name AS project, string_agg(arch_layer || '=' || n, ',' ORDER BY arch_layer) AS layers FROM (SELECT project_id, coalesce(arch_layer, 'Other') AS arch_layer, count(*) AS n FROM fx_type GROUP BY ALL) x JOIN fx_project p ON p.project_id = x.project_id GROUP BY p.name")
def _agg08(g: Graph) -> DataFrame:
    n = g.contained.groupBy("project", F.coalesce("arch_layer", F.lit("Other")).alias("layer")).agg(F.count("*").alias("n"))
    return n.groupBy("project").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("layer", "n"))), lambda x: F.concat_ws("=", x["layer"], x["n"].cast("string")))).alias("layers"))


@on_graph("agg_10_layer_histogram", "SELECT coalesce(arch_layer, 'Other') AS arch_layer, count(*) AS n FROM fx_type GROUP BY ALL")
def _agg10(g: Graph) -> DataFrame:
    return g.type.groupBy(F.coalesce("arch_layer", F.lit("Other")).alias("arch_layer")).agg(F.count("*").alias("n"))


@on_graph("agg_12_risk", "SELECT t.fqn, count(e.src) AS n, CASE WHEN count(e.src) = 0 THEN 'none' WHEN count(e.src) < 5 THEN 'low' WHEN count(e.src) < 20 THEN 'medium' ELSE 'high' END AS risk FROM fx_type t LEFT JOIN fx_depends_on e ON e.dst = t.type_id GROUP BY t.type_id, t.fqn")
def _agg12(g: Graph) -> DataFrame:
    n = g.depends_on.groupBy(F.col("dst").alias("type_id")).agg(F.count("*").alias("n"))
    n = g.type.join(n, "type_id", "left").select("fqn", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return n.select("fqn", "n", risk(F.col("n")).alias("risk"))


@on_graph("agg_14_keep_first", f"WITH {_OWN} SELECT fqn, method, signature FROM (SELECT *, row_number() OVER (PARTITION BY fqn, method ORDER BY method_id) AS rn FROM o) WHERE rn = 1")
def _agg14(g: Graph) -> DataFrame:
    return g.owned.groupBy("fqn", F.col("name").alias("method")).agg(F.min_by("signature", "method_id").alias("signature"))


@on_graph("jqa_02_project_type_counts", "SELECT p.name AS project, count(t.type_id) AS type_count FROM fx_project p LEFT JOIN fx_type t ON t.project_id = p.project_id GROUP BY p.name")
def _jqa02(g: Graph) -> DataFrame:
    t = g.type.groupBy("project_id").agg(F.count("*").alias("k"))
    return g.project.join(t, "project_id", "left").select(F.col("name").alias("project"), F.coalesce("k", F.lit(0).cast("long")).alias("type_count"))


@on_graph("jqa_04_database_schema", "SELECT mt.table_name, t.fqn AS entity, count(m.method_id) AS n_methods FROM fx_mapper_table mt JOIN fx_type t ON t.type_id = mt.src LEFT JOIN fx_method m ON m.type_id = t.type_id GROUP BY mt.table_name, t.type_id, t.fqn")
def _jqa04(g: Graph) -> DataFrame:
    n = g.method.groupBy("type_id").agg(F.count("*").alias("k"))
    return g.mapper_table.withColumnRenamed("src", "type_id").join(g.type, "type_id").join(n, "type_id", "left").select("table_name", F.col("fqn").alias("entity"), F.coalesce("k", F.lit(0).cast("long")).alias("n_methods"))


@on_graph("jqa_05_table_accessors", f"WITH {_OWN} SELECT DISTINCT mt.table_name, c.fqn AS accessor FROM fx_mapper_table mt JOIN fx_method m ON m.type_id = mt.src JOIN fx_call e ON e.dst = m.method_id JOIN o c ON c.method_id = e.src")
def _jqa05(g: Graph) -> DataFrame:
    m = g.mapper_table.withColumnRenamed("src", "type_id").join(g.method.select("type_id", F.col("method_id").alias("dst")), "type_id").select("table_name", "dst")
    return m.join(g.call, "dst").join(g.owned.select(F.col("method_id").alias("src"), F.col("fqn").alias("accessor")), "src").select("table_name", "accessor").distinct()


@on_graph("jqa_06_dependencies", f"WITH {_DEP} SELECT src_fqn AS class_fqn, 'outgoing' AS direction, dst_fqn AS other FROM d UNION ALL SELECT dst_fqn, 'incoming', src_fqn FROM d")
def _jqa06(g: Graph) -> DataFrame:
    d = dependencies(g)
    return d.select(F.col("src_fqn").alias("class_fqn"), F.lit("outgoing").alias("direction"), F.col("dst_fqn").alias("other")).union(d.select("dst_fqn", F.lit("incoming"), "src_fqn"))


@on_graph("jqa_08_similar_classes", """WITH r AS (SELECT src FROM fx_depends_on GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)
SELECT t.fqn, count(*) AS score FROM fx_depends_on a JOIN r ON r.src = a.src JOIN fx_depends_on b ON b.dst = a.dst AND b.src <> a.src JOIN fx_type t ON t.type_id = b.src GROUP BY t.type_id, t.fqn ORDER BY score DESC, t.fqn LIMIT 20""")
def _jqa08(g: Graph) -> DataFrame:
    r = g.depends_on.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("ref"))
    ref = g.depends_on.join(F.broadcast(r), F.col("src") == F.col("ref")).select("ref", "dst")
    shared = g.depends_on.join(ref, "dst").where("src <> ref").groupBy("src").agg(F.count("*").alias("score"))
    return shared.join(_types(g, "src", "fqn"), "src").select(F.col("src_fqn").alias("fqn"), "score").orderBy(F.desc("score"), "fqn").limit(20)


@on_graph("jqa_09_cycles", f"WITH {_DEP} SELECT least(a.src_fqn, a.dst_fqn) AS class1, greatest(a.src_fqn, a.dst_fqn) AS class2 FROM d a JOIN fx_depends_on b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst")
def _jqa09(g: Graph) -> DataFrame:
    back = g.depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = g.depends_on.where("src < dst").join(back, ["src", "dst"]).join(_types(g, "src", "fqn"), "src").join(_types(g, "dst", "fqn"), "dst")
    return both.select(F.least("src_fqn", "dst_fqn").alias("class1"), F.greatest("src_fqn", "dst_fqn").alias("class2"))


@on_graph("jqa_10_package_structure", "SELECT p.name AS project, t.package, count(*) AS type_count FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id GROUP BY ALL")
def _jqa10(g: Graph) -> DataFrame:
    return g.contained.groupBy("project", "package").agg(F.count("*").alias("type_count"))


@on_graph("jqa_11_complexity", """SELECT t.fqn, coalesce(m.n, 0) AS method_count, coalesce(d.n, 0) AS dependency_count, coalesce(m.n, 0) + coalesce(d.n, 0) AS score FROM fx_type t LEFT JOIN (SELECT type_id, count(*) AS n FROM fx_method GROUP BY type_id) m ON m.type_id = t.type_id
LEFT JOIN (SELECT src, count(*) AS n FROM fx_depends_on GROUP BY src) d ON d.src = t.type_id ORDER BY score DESC, t.fqn LIMIT 50""")
def _jqa11(g: Graph) -> DataFrame:
    m = g.method.groupBy("type_id").agg(F.count("*").alias("m"))
    d = g.depends_on.groupBy(F.col("src").alias("type_id")).agg(F.count("*").alias("d"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = g.type.join(m, "type_id", "left").join(d, "type_id", "left")
    return out.select("fqn", z("m").alias("method_count"), z("d").alias("dependency_count"), (z("m") + z("d")).alias("score")).orderBy(F.desc("score"), "fqn").limit(50)


@on_graph("jqa_03_call_graph_levels", """WITH s AS (SELECT src AS node FROM fx_depends_on GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), f(node, d) AS (SELECT node, 0 FROM s UNION SELECT e.dst, f.d + 1 FROM f JOIN fx_depends_on e ON e.src = f.node WHERE f.d < 1), l AS (SELECT node, min(d) AS d FROM f GROUP BY node)
SELECT a.fqn AS from_fqn, b.fqn AS to_fqn, CAST(l.d + 1 AS BIGINT) AS depth FROM fx_depends_on e JOIN l ON l.node = e.src JOIN fx_type a ON a.type_id = e.src JOIN fx_type b ON b.type_id = e.dst""")
def _jqa03(g: Graph) -> DataFrame:
    from ..operators.traverse import reach
    from .chain import start_type

    level = reach(g.depends_on, start_type(g), 1).select(F.col("node").alias("src"), "depth")
    e = g.depends_on.join(level, "src").join(_types(g, "src", "fqn"), "src").join(_types(g, "dst", "fqn"), "dst")
    return e.select(F.col("src_fqn").alias("from_fqn"), F.col("dst_fqn").alias("to_fqn"), (F.col("depth") + 1).cast("long").alias("depth"))


@on_graph("qry_01_interface_implementations_top20", "SELECT i.fqn, count(DISTINCT x.src) AS n, coalesce(string_agg(DISTINCT t.name, ',' ORDER BY t.name), '') AS names FROM fx_type i LEFT JOIN fx_implements x ON x.dst = i.type_id LEFT JOIN fx_type t ON t.type_id = x.src WHERE i.kind = 'INTERFACE' GROUP BY i.type_id, i.fqn ORDER BY n DESC, i.fqn LIMIT 20")
def _qry01(g: Graph) -> DataFrame:
    impl = g.implements.join(_types(g, "src", "name"), "src").groupBy(F.col("dst").alias("type_id")).agg(F.countDistinct("src").alias("k"), F.concat_ws(",", F.sort_array(F.collect_set("src_name"))).alias("names"))
    out = g.type.where("kind = 'INTERFACE'").join(impl, "type_id", "left")
    return out.select("fqn", F.coalesce("k", F.lit(0).cast("long")).alias("n"), F.coalesce("names", F.lit("")).alias("names")).orderBy(F.desc("n"), "fqn").limit(20)


@on_graph("qry_02_implementations_like", "SELECT i.fqn AS interface_fqn, t.fqn AS impl_fqn FROM fx_implements x JOIN fx_type i ON i.type_id = x.dst JOIN fx_type t ON t.type_id = x.src WHERE contains(i.fqn, 'Service')")
def _qry02(g: Graph) -> DataFrame:
    i = _types(g, "dst", "fqn").where(F.col("dst_fqn").contains("Service"))
    return g.implements.join(i, "dst").join(_types(g, "src", "fqn"), "src").select(F.col("dst_fqn").alias("interface_fqn"), F.col("src_fqn").alias("impl_fqn"))


@on_graph("qry_03_interface_methods", f"WITH {_OWN} SELECT fqn, method, signature FROM o WHERE kind = 'INTERFACE'")
def _qry03(g: Graph) -> DataFrame:
    return g.owned.where("kind = 'INTERFACE'").select("fqn", F.col("name").alias("method"), "signature")


def _dubbo(g: Graph) -> DataFrame:
    m = g.owned
    end = lambda s: m.select(F.col("method_id").alias(s), F.col("type_id").alias(f"{s}_type"), F.col("fqn").alias(f"{s}_fqn"), F.col("name").alias(f"{s}_method"), F.col("project").alias(f"{s}_project"))
    return g.calls("DUBBO_CALLS").join(end("src"), "src").join(end("dst"), "dst")


@on_graph("qry_04_dubbo_edges", f"WITH {_OWN} SELECT DISTINCT a.fqn AS caller, b.fqn AS service, c.via_field FROM fx_call c JOIN o a ON a.method_id = c.src JOIN o b ON b.method_id = c.dst WHERE c.rel_type = 'DUBBO_CALLS'")
def _qry04(g: Graph) -> DataFrame:
    return _dubbo(g).select(F.col("src_fqn").alias("caller"), F.col("dst_fqn").alias("service"), "via_field").distinct()


@on_graph("qry_05_dubbo_providers", "SELECT DISTINCT t.fqn AS provider, i.fqn AS service FROM fx_call c JOIN fx_method m ON m.method_id = c.dst JOIN fx_type i ON i.type_id = m.type_id JOIN fx_implements x ON x.dst = i.type_id JOIN fx_type t ON t.type_id = x.src WHERE c.rel_type = 'DUBBO_CALLS'")
def _qry05(g: Graph) -> DataFrame:
    used = g.calls("DUBBO_CALLS").join(g.method.select(F.col("method_id").alias("dst"), "type_id"), "dst").select(F.col("type_id").alias("dst")).distinct()
    return g.implements.join(used, "dst", "left_semi").join(_types(g, "dst", "fqn"), "dst").join(_types(g, "src", "fqn"), "src").select(F.col("src_fqn").alias("provider"), F.col("dst_fqn").alias("service"))


@on_graph("qry_06_services_per_caller", f"WITH {_OWN} SELECT caller, string_agg(via_field || '>' || service, ';' ORDER BY via_field || '>' || service) AS services FROM (SELECT DISTINCT a.fqn AS caller, c.via_field, b.fqn AS service FROM fx_call c JOIN o a ON a.method_id = c.src JOIN o b ON b.method_id = c.dst WHERE c.rel_type = 'DUBBO_CALLS') GROUP BY caller")
def _qry06(g: Graph) -> DataFrame:
    d = _dubbo(g).select(F.col("src_fqn").alias("caller"), F.concat_ws(">", "via_field", "dst_fqn").alias("s"))
    return d.groupBy("caller").agg(F.concat_ws(";", F.sort_array(F.collect_set("s"))).alias("services"))


@on_graph("qry_07_caller_service_provider", f"WITH {_OWN} SELECT DISTINCT a.fqn AS caller, b.fqn AS service, t.fqn AS provider FROM fx_call c JOIN o a ON a.method_id = c.src JOIN o b ON b.method_id = c.dst LEFT JOIN fx_implements x ON x.dst = b.type_id LEFT JOIN fx_type t ON t.type_id = x.src WHERE c.rel_type = 'DUBBO_CALLS'")
def _qry07(g: Graph) -> DataFrame:
    p = g.implements.join(_types(g, "src", "fqn"), "src").select(F.col("dst").alias("dst_type"), F.col("src_fqn").alias("provider"))
    return _dubbo(g).join(p, "dst_type", "left").select(F.col("src_fqn").alias("caller"), F.col("dst_fqn").alias("service"), "provider").distinct()


@on_graph("qry_08_cross_module_dependencies", f"WITH {_DEP} SELECT src_project, src_fqn, dst_project, dst_fqn FROM d WHERE src_project <> dst_project")
def _qry08(g: Graph) -> DataFrame:
    return dependencies(g).where("src_project <> dst_project").select("src_project", "src_fqn", "dst_project", "dst_fqn")


@on_graph("qry_10_module_samples", f"WITH {_DEP}, k AS (SELECT DISTINCT src_project, dst_project, dst_fqn FROM d WHERE src_project <> dst_project) SELECT src_project, dst_project, count(*) AS n, array_to_string(list_slice(list_sort(list(dst_fqn)), 1, 5), ',') AS sample FROM k GROUP BY ALL")
def _qry10(g: Graph) -> DataFrame:
    k = dependencies(g).where("src_project <> dst_project").select("src_project", "dst_project", "dst_fqn").distinct()
    rn = k.withColumn("rn", F.row_number().over(Window.partitionBy("src_project", "dst_project").orderBy("dst_fqn")))
    some = F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("rn") <= 5, F.col("dst_fqn")))))
    return rn.groupBy("src_project", "dst_project").agg(F.count("*").alias("n"), some.alias("sample"))


@on_graph("qry_11_cross_module_inheritance", "SELECT p.name AS src_project, q.name AS dst_project, count(*) AS n FROM fx_implements x JOIN fx_type a ON a.type_id = x.src JOIN fx_type b ON b.type_id = x.dst JOIN fx_project p ON p.project_id = a.project_id JOIN fx_project q ON q.project_id = b.project_id WHERE p.name <> q.name GROUP BY ALL")
def _qry11(g: Graph) -> DataFrame:
    side = lambda s: g.contained.select(F.col("type_id").alias(s), F.col("project").alias(f"{s}_project"))
    return g.implements.join(side("src"), "src").join(side("dst"), "dst").where("src_project <> dst_project").groupBy("src_project", "dst_project").agg(F.count("*").alias("n"))


@on_graph("qry_12_projects", "SELECT name AS project, path FROM fx_project")
def _qry12(g: Graph) -> DataFrame:
    return g.project.select(F.col("name").alias("project"), "path").orderBy("project")


@on_graph("qry_13_project_entity_counts", "SELECT p.name AS project, count(DISTINCT t.package) AS n_packages, count(DISTINCT t.type_id) AS n_types, count(DISTINCT m.method_id) AS n_methods FROM fx_project p LEFT JOIN fx_type t ON t.project_id = p.project_id LEFT JOIN fx_method m ON m.type_id = t.type_id GROUP BY p.name")
def _qry13(g: Graph) -> DataFrame:
    t = g.type.groupBy("project_id").agg(F.countDistinct("package").alias("n_packages"), F.count("*").alias("n_types"))
    m = g.owned.groupBy("project_id").agg(F.count("*").alias("n_methods"))
    out = g.project.join(t, "project_id", "left").join(m, "project_id", "left")
    return out.select(F.col("name").alias("project"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_packages", "n_types", "n_methods")))


@on_graph("qry_14_packages_of", "SELECT DISTINCT p.name AS project, t.package FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id WHERE p.project_id IN (1, 2, 3)")
def _qry14(g: Graph) -> DataFrame:
    return g.contained.where(F.col("project_id").isin(1, 2, 3)).select("project", "package").distinct()


@on_graph("qry_16_entities_under_project", "SELECT p.name AS project, count(DISTINCT t.type_id) + count(DISTINCT m.method_id) AS n FROM fx_project p JOIN fx_type t ON t.project_id = p.project_id LEFT JOIN fx_method m ON m.type_id = t.type_id GROUP BY p.name")
def _qry16(g: Graph) -> DataFrame:
    t = g.contained.groupBy("project").agg(F.count("*").alias("a"))
    m = g.owned.where("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("b"))
    return t.join(m, "project", "left").select("project", (F.col("a") + F.coalesce("b", F.lit(0))).alias("n"))


@on_graph("qry_17_edges_of_project", f"WITH {_OWN} SELECT o.project, c.rel_type, count(*) AS n FROM fx_call c JOIN o ON o.method_id = c.src WHERE o.project IS NOT NULL AND c.rel_type IN ('CALLS', 'DUBBO_CALLS') GROUP BY ALL")
def _qry17(g: Graph) -> DataFrame:
    own = g.owned.where("project IS NOT NULL").select(F.col("method_id").alias("src"), "project")
    return g.calls("CALLS", "DUBBO_CALLS").join(own, "src").groupBy("project", "rel_type").agg(F.count("*").alias("n"))


@on_graph("qry_19_totals", "SELECT (SELECT count(*) FROM fx_project) AS projects, (SELECT count(*) FROM fx_type WHERE project_id IS NOT NULL) AS types, (SELECT count(*) FROM fx_depends_on) AS dependencies")
def _qry19(g: Graph) -> DataFrame:
    parts = (g.project.agg(F.count("*").alias("projects")), g.type.where("project_id IS NOT NULL").agg(F.count("*").alias("types")), g.depends_on.agg(F.count("*").alias("dependencies")))
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # one row each


@on_graph("qry_22_implementers_or_none", "SELECT i.fqn AS interface_fqn, t.fqn AS impl_fqn FROM fx_type i LEFT JOIN fx_implements x ON x.dst = i.type_id LEFT JOIN fx_type t ON t.type_id = x.src WHERE i.kind = 'INTERFACE'")
def _qry22(g: Graph) -> DataFrame:
    impl = g.implements.join(_types(g, "src", "fqn"), "src")
    return g.type.where("kind = 'INTERFACE'").join(impl.select(F.col("dst").alias("type_id"), "src_fqn"), "type_id", "left").select(F.col("fqn").alias("interface_fqn"), F.col("src_fqn").alias("impl_fqn"))


@on_graph("qry_23_callers_by_signature", f"WITH {_OWN} SELECT DISTINCT b.signature AS callee, a.signature AS caller, a.project FROM fx_call c JOIN o a ON a.method_id = c.src JOIN o b ON b.method_id = c.dst WHERE contains(b.signature, 'Controller.m1')")
def _qry23(g: Graph) -> DataFrame:
    b = g.method.where(F.col("signature").contains("Controller.m1")).select(F.col("method_id").alias("dst"), F.col("signature").alias("callee"))
    return g.call.join(b, "dst").join(g.owned.select(F.col("method_id").alias("src"), F.col("signature").alias("caller"), "project"), "src").select("callee", "caller", "project").distinct()


@on_graph("qry_24_callers_and_callees", f"WITH {_OWN} SELECT o.signature, coalesce(x.n, 0) AS n_callers, coalesce(y.n, 0) AS n_callees FROM o LEFT JOIN (SELECT dst, count(*) AS n FROM fx_call GROUP BY dst) x ON x.dst = o.method_id LEFT JOIN (SELECT src, count(*) AS n FROM fx_call GROUP BY src) y ON y.src = o.method_id")
def _qry24(g: Graph) -> DataFrame:
    x = g.call.groupBy(F.col("dst").alias("method_id")).agg(F.count("*").alias("n_callers"))
    y = g.call.groupBy(F.col("src").alias("method_id")).agg(F.count("*").alias("n_callees"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return g.method.join(x, "method_id", "left").join(y, "method_id", "left").select("signature", z("n_callers"), z("n_callees"))


@on_graph("qry_25_kinds_per_project", "SELECT p.name AS project, t.kind, count(*) AS n FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id GROUP BY ALL")
def _qry25(g: Graph) -> DataFrame:
    return g.contained.groupBy("project", "kind").agg(F.count("*").alias("n"))


@on_graph("qry_26_calling_methods_per_project", f"WITH {_OWN} SELECT project, count(*) AS n FROM o WHERE project IS NOT NULL AND method_id IN (SELECT src FROM fx_call WHERE rel_type = 'CALLS') GROUP BY project")
def _qry26(g: Graph) -> DataFrame:
    return g.owned.where("project IS NOT NULL").join(g.calls("CALLS").select(F.col("src").alias("method_id")), "method_id", "left_semi").groupBy("project").agg(F.count("*").alias("n"))


#: Bytes of signatures whose pairs a task makes; a Parquet writer holds a column's texts once up to 1 MB of them, and writes each anew beyond.
SIGNATURE_BYTES = 512 << 10


def dubbo_with_fallback(g: Graph) -> DataFrame:
    """Each Dubbo call's implementation: by IMPLEMENTS, or, only if the interface has none, a class of the interface's project that declares
    a method of the name.

    The second kind are all pairs within a project and a name, so their number grows with the square of a project: both sides are made distinct before they
    meet, and the pairs neither moved nor compared (but for those of interfaces that share their full name). They come by project, name and class, those of few
    signatures from a task, so that a columnar file of them holds each text once."""
    iface = g.owned.where("kind = 'INTERFACE'").select(F.col("method_id").alias("dst"), F.col("type_id").alias("iface"), F.col("fqn").alias("dubbo_interface"), F.col("name").alias("dubbo_method"), "project_id")
    hop = written(g.calls("DUBBO_CALLS").select("dst").distinct().join(iface, "dst").drop("dst").distinct())
    classes = g.type.where("kind = 'CLASS'")
    impl = g.implements.join(classes.select(F.col("type_id").alias("src"), F.col("fqn").alias("impl_fqn")), "src").select(F.col("dst").alias("iface"), F.col("src").alias("impl"), "impl_fqn")
    own = g.method.select(F.col("type_id").alias("impl"), F.col("name").alias("dubbo_method"), F.col("signature").alias("impl_signature"))
    found = hop.join(impl, "iface").join(own, ["impl", "dubbo_method"], "left")
    back = written(classes.where("project_id IS NOT NULL").select(F.col("type_id").alias("impl"), "project_id", F.col("fqn").alias("impl_fqn")).join(own, "impl").select("project_id", "dubbo_method", "impl_fqn", "impl_signature"))
    parts = (back.agg(F.sum(F.octet_length("impl_signature"))).first()[0] or 0) // SIGNATURE_BYTES + 1
    once = Window.partitionBy(*back.columns).orderBy("impl_signature")  # distinct and in order at once; a sort alone would be dropped below the join
    laid = back.repartitionByRange(parts, *back.columns).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    shared = hop.groupBy("dubbo_interface").agg((F.countDistinct("iface") > 1).alias("shared"))
    missed = written(hop.join(impl, "iface", "left_anti").join(shared, "dubbo_interface").drop("iface").distinct())
    cols = ("dubbo_interface", "dubbo_method", "impl_fqn", "impl_signature")
    alone = missed.join(back.select("project_id", "dubbo_method").distinct(), ["project_id", "dubbo_method"], "left_anti").select("dubbo_interface", "dubbo_method", F.lit(None).cast("string"), F.lit(None).cast("string"))
    pairs = lambda side, of: side.join(small(missed.where(of)), ["project_id", "dubbo_method"]).select(*cols)
    return found.select(*cols).union(alone).union(pairs(back, "shared")).distinct().union(pairs(laid, "NOT shared"))


@on_graph("qry_30_dubbo_with_fallback", f"""WITH {_OWN}, h AS (SELECT DISTINCT b.type_id, b.fqn, b.method, b.project_id FROM fx_call c JOIN o b ON b.method_id = c.dst AND b.kind = 'INTERFACE' WHERE c.rel_type = 'DUBBO_CALLS'),
k AS (SELECT x.dst, t.type_id, t.fqn FROM fx_implements x JOIN fx_type t ON t.type_id = x.src AND t.kind = 'CLASS')
SELECT DISTINCT h.fqn AS dubbo_interface, h.method AS dubbo_method, k.fqn AS impl_fqn, m.signature AS impl_signature FROM h JOIN k ON k.dst = h.type_id LEFT JOIN fx_method m ON m.type_id = k.type_id AND m.name = h.method
UNION SELECT DISTINCT h.fqn, h.method, y.fqn, y.signature FROM h LEFT JOIN (SELECT * FROM o WHERE kind = 'CLASS' AND project_id IS NOT NULL) y ON y.project_id = h.project_id AND y.method = h.method WHERE h.type_id NOT IN (SELECT dst FROM k)""")
def _qry30(g: Graph) -> DataFrame:
    return dubbo_with_fallback(g)


@on_graph("qry_28_declaring_classes", f"WITH {_OWN} SELECT DISTINCT fqn, kind, arch_layer FROM o WHERE method = 'm3' AND arch_layer IN ('Service', 'Manager') AND project IS NOT NULL")
def _qry28(g: Graph) -> DataFrame:
    return g.owned.where("name = 'm3' AND project IS NOT NULL").where(F.col("arch_layer").isin("Service", "Manager")).select("fqn", "kind", "arch_layer").distinct()


@on_graph("qry_31_missing_implements", """SELECT DISTINCT a.fqn AS class_fqn, i.fqn AS interface_fqn FROM fx_depends_on d JOIN fx_type a ON a.type_id = d.src AND a.kind = 'CLASS' JOIN fx_type i ON i.type_id = d.dst AND i.kind = 'INTERFACE'
WHERE NOT EXISTS (SELECT 1 FROM fx_implements x WHERE x.src = d.src AND x.dst = d.dst)""")
def _qry31(g: Graph) -> DataFrame:
    want = g.depends_on.join(_types(g, "src", "fqn", "kind").where("src_kind = 'CLASS'"), "src").join(_types(g, "dst", "fqn", "kind").where("dst_kind = 'INTERFACE'"), "dst")
    return want.join(g.implements, ["src", "dst"], "left_anti").select(F.col("src_fqn").alias("class_fqn"), F.col("dst_fqn").alias("interface_fqn")).distinct()


_N = {"loose": "starts_with(fqn, 'java.util.')", "moderate": "starts_with(fqn, 'java.util.') OR starts_with(fqn, 'org.slf4j.') OR name LIKE '%Utils' OR name LIKE '%DTO' OR name LIKE '%VO'"}
_N["strict"] = _N["moderate"] + " OR name LIKE '%Entity'"


@on_graph("flt_02_noise_modes", f"SELECT fqn, false AS noise_none, {_N['loose']} AS noise_loose, ({_N['moderate']}) AS noise_moderate, ({_N['strict']}) AS noise_strict FROM fx_type")
def _flt02(g: Graph) -> DataFrame:
    return g.type.select("fqn", *(is_noise(F.col("fqn"), F.col("name"), m).alias(f"noise_{m}") for m in ("none", "loose", "moderate", "strict")))


@on_graph("flt_03_text_filter", f"SELECT fqn FROM fx_type WHERE NOT (starts_with(fqn, 'java.util.') OR starts_with(fqn, 'org.slf4j.') OR name LIKE '%Utils')")
def _flt03(g: Graph) -> DataFrame:
    return g.type.where(passes_text_filter(F.col("fqn"), F.col("name"))).select("fqn")


@on_graph("flt_01_business_classes", """SELECT fqn FROM fx_type t WHERE kind = 'MAPPER' OR arch_layer = 'Entity' OR (kind = 'INTERFACE' AND contains(fqn, '.api.')) OR type_id IN (SELECT src FROM fx_depends_on) OR type_id IN (SELECT dst FROM fx_depends_on)""")
def _flt01(g: Graph) -> DataFrame:
    """A class stays if it injects, is injected, is a mapper or an entity, or is an interface of an api package."""
    used = g.depends_on.select(F.col("src").alias("type_id")).union(g.depends_on.select("dst")).distinct().withColumn("used", F.lit(True))
    keep = F.col("used").isNotNull() | (F.col("kind") == "MAPPER") | F.coalesce(F.col("arch_layer") == "Entity", F.lit(False)) | ((F.col("kind") == "INTERFACE") & F.col("fqn").contains(".api."))
    return g.type.join(used, "type_id", "left").where(keep).select("fqn")


@on_graph("flt_13_entity_like", "SELECT t.fqn, t.name, count(d.dst) AS field_count FROM fx_type t LEFT JOIN fx_depends_on d ON d.src = t.type_id WHERE t.name LIKE '%Entity' OR t.name LIKE '%Model' GROUP BY t.type_id, t.fqn, t.name")
def _flt13(g: Graph) -> DataFrame:
    """Entity-like types, with the number of types that they depend on."""
    n = g.depends_on.groupBy(F.col("src").alias("type_id")).agg(F.count("*").alias("n"))
    rows = g.type.where(F.col("name").endswith("Entity") | F.col("name").endswith("Model")).join(n, "type_id", "left")
    return rows.select("fqn", "name", F.coalesce("n", F.lit(0).cast("long")).alias("field_count"))


@on_graph("flt_11_uncontained_called", "SELECT DISTINCT t.fqn FROM fx_type t JOIN fx_method m ON m.type_id = t.type_id WHERE t.project_id IS NULL AND m.method_id IN (SELECT dst FROM fx_call)")
def _flt11(g: Graph) -> DataFrame:
    return g.owned.where("project_id IS NULL").join(g.call.select(F.col("dst").alias("method_id")), "method_id", "left_semi").select("fqn").distinct()


@on_graph("prj_07_defaults", "SELECT fqn, coalesce(arch_layer, 'Other') AS arch_layer, coalesce(p.name, 'External') AS project, string_split(fqn, '.')[-1] AS simple FROM fx_type t LEFT JOIN fx_project p ON p.project_id = t.project_id")
def _prj07(g: Graph) -> DataFrame:
    from ..functions.rules import simple_name

    return g.type.join(g.project_name, "project_id", "left").select("fqn", F.coalesce("arch_layer", F.lit("Other")).alias("arch_layer"), F.coalesce("project", F.lit("External")).alias("project"), simple_name(F.col("fqn")).alias("simple"))


@on_graph("trv_19_contained", "SELECT p.name AS project, t.fqn AS entity FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id UNION ALL SELECT p.name, m.signature FROM fx_method m JOIN fx_type t ON t.type_id = m.type_id JOIN fx_project p ON p.project_id = t.project_id")
def _trv19(g: Graph) -> DataFrame:
    return g.contained.select("project", F.col("fqn").alias("entity")).union(g.owned.where("project IS NOT NULL").select("project", "signature"))


def dependency_chain(g: Graph, starts: DataFrame) -> DataFrame:
    """(start, role, fqn) for start types (node): their implementations, the facades and services that these depend on, and what they call over Dubbo."""
    fqn = lambda c, n: g.type.select(F.col("type_id").alias(c), F.col("fqn").alias(n))
    impl = g.implements.join(starts.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("begin"), F.col("src").alias("impl"))
    named = impl.select("begin", F.lit("implementation").alias("role"), F.col("impl").alias("of"))
    facade = F.col("fqn").contains("Facade") | F.col("fqn").contains("Service")
    used = impl.join(g.depends_on.withColumnRenamed("src", "impl"), "impl").join(g.type.where(facade).select(F.col("type_id").alias("dst")), "dst", "left_semi").select("begin", F.lit("facade"), "dst")
    remote = impl.join(_dubbo(g).select(F.col("src_type").alias("impl"), F.col("dst_type").alias("to")).distinct(), "impl").select("begin", F.lit("reference"), "to")
    rows = named.union(used).union(remote).distinct()
    return rows.join(fqn("begin", "start"), "begin").join(fqn("of", "fqn"), "of").select("start", "role", "fqn")


@on_graph("trv_20_dependency_chain", """WITH i AS (SELECT x.dst AS start, x.src AS impl FROM fx_implements x JOIN fx_type t ON t.type_id = x.dst AND t.kind = 'INTERFACE'),
r AS (SELECT start, 'implementation' AS role, impl AS x FROM i UNION SELECT i.start, 'facade', d.dst FROM i JOIN fx_depends_on d ON d.src = i.impl JOIN fx_type t ON t.type_id = d.dst WHERE contains(t.fqn, 'Facade') OR contains(t.fqn, 'Service')
UNION SELECT i.start, 'reference', b.type_id FROM i JOIN fx_method a ON a.type_id = i.impl JOIN fx_call c ON c.src = a.method_id AND c.rel_type = 'DUBBO_CALLS' JOIN fx_method b ON b.method_id = c.dst)
SELECT s.fqn AS start, r.role, t.fqn FROM r JOIN fx_type s ON s.type_id = r.start JOIN fx_type t ON t.type_id = r.x""")
def _trv20(g: Graph) -> DataFrame:
    return dependency_chain(g, g.type.where("kind = 'INTERFACE'").select(F.col("type_id").alias("node")))


@on_graph("dsg_08_service_table_matrix", f"WITH {_OWN} SELECT a.project, mt.table_name, count(*) AS n FROM fx_call c JOIN o a ON a.method_id = c.src JOIN fx_method m ON m.method_id = c.dst JOIN fx_mapper_table mt ON mt.src = m.type_id WHERE c.rel_type = 'DB_CALL' AND a.project IS NOT NULL GROUP BY ALL")
def _dsg08(g: Graph) -> DataFrame:
    to = g.method.select(F.col("method_id").alias("dst"), F.col("type_id").alias("src_type")).join(g.mapper_table.withColumnRenamed("src", "src_type"), "src_type").select("dst", "table_name")
    own = g.owned.where("project IS NOT NULL").select(F.col("method_id").alias("src"), "project")
    return g.calls("DB_CALL").join(own, "src").join(to, "dst").groupBy("project", "table_name").agg(F.count("*").alias("n"))


@on_graph("dsg_02_entities_by_name", "SELECT kind, fqn FROM fx_type WHERE name = 'C10' OR name = 'C9Service'")
def _dsg02(g: Graph) -> DataFrame:
    return g.type.where(F.col("name").isin("C10", "C9Service")).select("kind", "fqn")


@on_graph("dsg_04_callers_callees", f"WITH {_OWN} SELECT a.signature AS caller, b.signature AS callee, c.rel_type FROM fx_call c JOIN o a ON a.method_id = c.src JOIN o b ON b.method_id = c.dst WHERE a.method = 'm1' AND b.method = 'm2'")
def _dsg04(g: Graph) -> DataFrame:
    a = g.method.where("name = 'm1'").select(F.col("method_id").alias("src"), F.col("signature").alias("caller"))
    b = g.method.where("name = 'm2'").select(F.col("method_id").alias("dst"), F.col("signature").alias("callee"))
    return g.call.join(a, "src").join(b, "dst").select("caller", "callee", "rel_type")


@on_graph("api_class_methods", f"WITH {_OWN} SELECT project, fqn, method, signature FROM o WHERE project IS NOT NULL AND class_name LIKE '%Controller'")
def _api(g: Graph) -> DataFrame:
    return g.owned.where("project IS NOT NULL").where(F.col("class_name").endswith("Controller")).select("project", "fqn", F.col("name").alias("method"), "signature").orderBy("fqn", "method", "signature")


@on_graph("agg_13_dependency_totals", """SELECT (SELECT count(*) FROM fx_project) AS project_count, (SELECT count(*) FROM fx_type WHERE project_id IS NOT NULL) AS type_count,
(SELECT count(*) FROM fx_depends_on d JOIN fx_type t ON t.type_id = d.src WHERE t.project_id IS NOT NULL) + (SELECT count(*) FROM fx_call c JOIN fx_method m ON m.method_id = c.src JOIN fx_type t ON t.type_id = m.type_id WHERE c.rel_type = 'CALLS' AND t.project_id IS NOT NULL) AS dependency_count""")
def _agg13(g: Graph) -> DataFrame:
    """Projects, contained types, and edges of several kinds that lead out of these."""
    own = g.contained.select(F.col("type_id").alias("src"))
    methods = g.method.join(g.contained.select("type_id"), "type_id", "left_semi").select(F.col("method_id").alias("src"))
    n = g.depends_on.join(own, "src", "left_semi").select("src").union(g.calls("CALLS").join(methods, "src", "left_semi").select("src")).agg(F.count("*").alias("dependency_count"))
    p, t = g.project.agg(F.count("*").alias("project_count")), g.contained.agg(F.count("*").alias("type_count"))
    return p.join(F.broadcast(t)).join(F.broadcast(n))  # one row each


@on_graph("qry_20_types_and_edges_per_project", "SELECT coalesce(p.name, 'none') AS what, count(*) AS n FROM fx_type t LEFT JOIN fx_project p ON p.project_id = t.project_id GROUP BY ALL UNION ALL SELECT 'DEPENDS_ON', count(*) FROM fx_depends_on UNION ALL SELECT kind, count(*) FROM fx_type GROUP BY kind")
def _qry20(g: Graph) -> DataFrame:
    n = g.type.join(g.project_name, "project_id", "left").groupBy(F.coalesce("project", F.lit("none")).alias("what")).agg(F.count("*").alias("n"))
    return n.union(g.depends_on.agg(F.lit("DEPENDS_ON"), F.count("*"))).union(g.type.groupBy("kind").agg(F.count("*")))


@on_graph("qry_27_dubbo_diagnosis", """SELECT DISTINCT y.fqn AS dubbo_interface, b.name AS dubbo_method, c.via_field, m.signature AS impl_signature, p.name AS impl_project, x.fqn AS impl_class_fqn, q.name AS iface_project
FROM fx_call c JOIN fx_method b ON b.method_id = c.dst JOIN fx_type y ON y.type_id = b.type_id AND y.kind = 'INTERFACE' LEFT JOIN fx_project q ON q.project_id = y.project_id
LEFT JOIN (SELECT i.dst, t.* FROM fx_implements i JOIN fx_type t ON t.type_id = i.src AND t.kind = 'CLASS') x ON x.dst = y.type_id LEFT JOIN fx_method m ON m.type_id = x.type_id AND m.name = b.name LEFT JOIN fx_project p ON p.project_id = x.project_id WHERE c.rel_type = 'DUBBO_CALLS'""")
def _qry27(g: Graph) -> DataFrame:
    """Each Dubbo call's interface with its implementing classes and their methods of that name, null where there are none."""
    project = lambda n: g.project_name.select(F.col("project_id").alias(f"{n}_id"), F.col("project").alias(n))
    iface = g.method.join(g.type.where("kind = 'INTERFACE'").select("type_id", F.col("fqn").alias("dubbo_interface"), F.col("project_id").alias("iface_project_id")), "type_id").select(F.col("method_id").alias("dst"), F.col("type_id").alias("iface"), F.col("name").alias("dubbo_method"), "dubbo_interface", "iface_project_id")
    impl = g.implements.join(g.type.where("kind = 'CLASS'").select(F.col("type_id").alias("src"), F.col("fqn").alias("impl_class_fqn"), F.col("project_id").alias("impl_project_id")), "src").select(F.col("dst").alias("iface"), F.col("src").alias("impl"), "impl_class_fqn", "impl_project_id")
    own = g.method.select(F.col("type_id").alias("impl"), F.col("name").alias("dubbo_method"), F.col("signature").alias("impl_signature"))
    rows = g.calls("DUBBO_CALLS").select("dst", "via_field").distinct().join(iface, "dst").join(impl, "iface", "left").join(own, ["impl", "dubbo_method"], "left")
    rows = rows.join(project("impl_project"), "impl_project_id", "left").join(project("iface_project"), "iface_project_id", "left")
    return rows.select("dubbo_interface", "dubbo_method", "via_field", "impl_signature", "impl_project", "impl_class_fqn", "iface_project").distinct()


@on_graph("qry_29_by_interface_substring", f"""WITH {_OWN} SELECT 'IMPLEMENTS' AS what, p.name AS project, a.fqn AS one, i.fqn AS other FROM fx_implements x JOIN fx_type a ON a.type_id = x.src JOIN fx_type i ON i.type_id = x.dst LEFT JOIN fx_project p ON p.project_id = a.project_id WHERE contains(i.fqn, 'Service')
UNION SELECT 'DUBBO_CALLS', b.project, b.fqn, b.method FROM fx_call c JOIN o b ON b.method_id = c.dst WHERE c.rel_type = 'DUBBO_CALLS' AND contains(b.signature, 'Service')""")
def _qry29(g: Graph) -> DataFrame:
    impl = g.implements.join(_types(g, "dst", "fqn").where(F.col("dst_fqn").contains("Service")), "dst").join(_types(g, "src", "fqn", "project_id").withColumnRenamed("src_project_id", "project_id"), "src").join(g.project_name, "project_id", "left")
    impl = impl.select(F.lit("IMPLEMENTS").alias("what"), "project", F.col("src_fqn").alias("one"), F.col("dst_fqn").alias("other"))
    to = g.owned.where(F.col("signature").contains("Service")).join(g.calls("DUBBO_CALLS").select(F.col("dst").alias("method_id")), "method_id", "left_semi")
    return impl.union(to.select(F.lit("DUBBO_CALLS"), "project", "fqn", "name")).distinct()


def entity(g: Graph, key: str) -> DataFrame:
    """(label, key, name) of the type or method with a full name or signature."""
    t = g.type.where(F.col("fqn") == key).select(F.col("kind").alias("label"), F.col("fqn").alias("key"), "name")
    return t.union(g.method.where(F.col("signature") == key).select(F.lit("Method"), "signature", "name"))


@on_graph("dsg_01_find_entity", "WITH k AS (SELECT fqn AS key FROM fx_type WHERE type_id = 10) SELECT t.kind AS label, t.fqn AS key, t.name FROM fx_type t JOIN k ON k.key = t.fqn UNION ALL SELECT 'Method', m.signature, m.name FROM fx_method m JOIN k ON k.key = m.signature")
def _dsg01(g: Graph) -> DataFrame:
    return entity(g, g.type.where("type_id = 10").first()["fqn"])


@on_graph("dsg_08_service_dependency_matrix", f"WITH {_OWN} SELECT a.project AS from_project, b.project AS to_project, count(*) AS n FROM fx_call c JOIN o a ON a.method_id = c.src JOIN o b ON b.method_id = c.dst WHERE c.rel_type = 'DUBBO_CALLS' AND a.project IS NOT NULL AND b.project IS NOT NULL GROUP BY ALL")
def _dsg08d(g: Graph) -> DataFrame:
    return _dubbo(g).where("src_project IS NOT NULL AND dst_project IS NOT NULL").groupBy(F.col("src_project").alias("from_project"), F.col("dst_project").alias("to_project")).agg(F.count("*").alias("n"))


@on_graph("prj_05_unwind", "SELECT p.name AS project, label, count(*) AS n FROM (SELECT project_id, unnest([kind, coalesce(arch_layer, 'Other')]) AS label FROM fx_type) t JOIN fx_project p ON p.project_id = t.project_id GROUP BY ALL")
def _prj05(g: Graph) -> DataFrame:
    """A row per label of a type: its kind and its layer."""
    rows = g.contained.select("project", F.explode(F.array("kind", F.coalesce("arch_layer", F.lit("Other")))).alias("label"))
    return rows.groupBy("project", "label").agg(F.count("*").alias("n"))
