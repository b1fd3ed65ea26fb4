"""Java sources rendered from the driver's tables: a program given as relations (plain SQL, for Spark and DuckDB alike), and its text.

The relations say what the extraction must find; the text is what it reads. The text holds what trips readers up: brackets, quotes and comment marks in
literals, text blocks, literals of 100 KB, comments of all kinds, generics, lambdas, anonymous and nested types, several declarators, names
written in full, imported, or of the own package, and constants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

_ID = "CAST({} AS VARCHAR(20))"
_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'INTERFACE' WHEN 'MACHINERY' THEN 'MAPPER' WHEN 'HOUSEHOLD' THEN 'ARIES_JOB' ELSE 'CLASS' END"
_CLASSES = "CASE c_custkey % 8 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Impl' WHEN 3 THEN 'Dto' WHEN 4 THEN 'Manager' WHEN 5 THEN 'Dao' WHEN 6 THEN 'Entity' ELSE 'Helper' END"
_ROLE = f"CASE c_mktsegment WHEN 'BUILDING' THEN 'Api' WHEN 'MACHINERY' THEN CASE WHEN c_custkey % 3 = 0 THEN 'Store' ELSE 'Mapper' END WHEN 'HOUSEHOLD' THEN 'Job' ELSE {_CLASSES} END"
_MODULE = "CASE WHEN path LIKE 'src/%' THEN project ELSE split_part(path, '/', 1) END"
_NO = "CAST(NULL AS VARCHAR(20))"
#: The layer of a type, from its kind and role.
LAYER = "CASE WHEN kind = 'MAPPER' THEN 'Mapper' WHEN role IN ('Controller', 'Service', 'Manager', 'Entity', 'Helper') THEN role WHEN role = 'Dao' THEN 'DAO' ELSE 'Other' END"

#: The program's relations, each after those it needs.
PROGRAM: dict[str, str] = {
    # every tenth class holds a nested one; mappers called Store are told by their annotation alone
    "jx_top": f"""SELECT c_custkey AS id, {_KIND} AS kind, {_ROLE} AS role, concat('T', {_ID.format('c_custkey')}, {_ROLE}) AS name, concat('com.acme.', lower(c_mktsegment)) AS package, n_name AS project,
concat(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('mod', {_ID.format('c_custkey % 3')}, '/') END, 'src/main/java/com/acme/', lower(c_mktsegment), '/T', {_ID.format('c_custkey')}, {_ROLE}, '.java') AS path
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "jx_type": f"""SELECT id, id AS file_id, kind, role, name, package, concat(package, '.', name) AS fqn, project, path, {_MODULE} AS module FROM jx_top
UNION ALL SELECT id + 1000000000, id, 'CLASS', 'Inner', concat(name, 'Inner'), package, concat(package, '.', name, 'Inner'), project, path, {_MODULE} FROM jx_top WHERE kind = 'CLASS' AND id % 10 IN (0, 1)""",
    # types that use queues have a template of each kind
    "jx_queue": "SELECT * FROM jx_type WHERE role = 'Service' AND id % 5 IN (0, 1)",
    "jx_field": f"""SELECT o.id, o.file_id, o.fqn AS class_fqn, o.project, o.field, t.id AS target, t.fqn AS type_fqn, t.kind AS target_kind, t.project AS target_project,
CASE WHEN t.kind = 'MAPPER' THEN 'Resource' WHEN o.id % 2 = 0 THEN 'Reference' ELSE 'Autowired' END AS injection_type,
CASE WHEN t.package = o.package THEN 'own' WHEN o.id % 3 = 0 THEN 'dotted' ELSE 'imported' END AS style
FROM (SELECT t.*, 'f1' AS field, (id * 7 + 3) % n.n AS k FROM jx_type t CROSS JOIN (SELECT count(*) AS n FROM customer) n WHERE kind IN ('CLASS', 'ARIES_JOB') AND role NOT IN ('Dto', 'Entity')
 UNION ALL SELECT t.*, 'f2', (id * 11 + 5) % n.n FROM jx_type t CROSS JOIN (SELECT count(*) AS n FROM customer) n WHERE kind IN ('CLASS', 'ARIES_JOB') AND role NOT IN ('Dto', 'Entity', 'Inner')
 UNION ALL SELECT t.*, 'g1', (id * 7 + 3) % n.n FROM jx_type t CROSS JOIN (SELECT count(*) AS n FROM customer) n WHERE kind IN ('CLASS', 'ARIES_JOB') AND role NOT IN ('Dto', 'Entity', 'Inner') AND id % 6 = 0) o
JOIN jx_type t ON t.id = o.k AND t.kind IN ('INTERFACE', 'MAPPER')
UNION ALL SELECT id, file_id, fqn, project, 'kt', CAST(NULL AS BIGINT), 'org.springframework.kafka.core.KafkaTemplate', {_NO}, {_NO}, 'Resource', 'imported' FROM jx_queue
UNION ALL SELECT id, file_id, fqn, project, 'rt', CAST(NULL AS BIGINT), 'org.apache.rocketmq.spring.core.RocketMQTemplate', {_NO}, {_NO}, 'Autowired', 'dotted' FROM jx_queue""",
    # a Store of even number says its table by a parameter
    "jx_method": """SELECT DISTINCT t.id, t.fqn AS class_fqn, t.kind, t.role, t.project, o.o_orderkey % 8 AS k, concat('m', CAST(o.o_orderkey % 8 AS VARCHAR(20))) AS name,
concat(t.fqn, '.m', CAST(o.o_orderkey % 8 AS VARCHAR(20)), CASE WHEN o.o_orderstatus = 'O' AND t.role = 'Store' AND t.id % 2 = 0 THEN concat('(Row', CAST(t.id % 5 AS VARCHAR(20)), 'DO)') WHEN o.o_orderstatus = 'F' THEN '()' WHEN o.o_orderstatus = 'O' THEN '(String)' ELSE '(int,List)' END) AS signature,
CASE WHEN o.o_orderstatus = 'O' AND t.role = 'Store' AND t.id % 2 = 0 THEN concat('final Row', CAST(t.id % 5 AS VARCHAR(20)), 'DO row') WHEN o.o_orderstatus = 'F' THEN '' WHEN o.o_orderstatus = 'O' THEN '@Param("s, )") String s' ELSE 'int[] n, List<Map<String, Long>> xs' END AS params
FROM orders o JOIN jx_type t ON t.id = o.o_custkey
UNION ALL SELECT id, fqn, kind, role, project, 0, 'm0', concat(fqn, '.m0()'), '' FROM jx_type WHERE role = 'Inner'""",
    "jx_impl": """SELECT t.id, t.fqn, i.fqn AS up FROM jx_type t CROSS JOIN (SELECT count(*) AS n FROM customer) n JOIN jx_type i ON i.id = (t.id * 13 + 1) % n.n AND i.kind = 'INTERFACE' WHERE t.role = 'Impl'
UNION ALL SELECT id, fqn, 'com.lib.Ready' FROM jx_type WHERE role = 'Impl' AND id % 5 = 0""",
    "jx_extends": """SELECT t.id, t.file_id, t.fqn, p.fqn AS up, p.package = t.package AS own FROM jx_type t CROSS JOIN (SELECT count(*) AS n FROM customer) n JOIN jx_type p ON p.id = (t.id * 5 + 2) % n.n AND p.kind = 'CLASS' AND p.id <> t.id WHERE t.role = 'Manager'
UNION ALL SELECT id, file_id, fqn, concat('com.lib.Base', CAST(id % 7 AS VARCHAR(20))), FALSE FROM jx_type WHERE role IN ('Impl', 'Dao') AND id % 3 = 0""",
    # what the load keeps
    "jx_business": """SELECT t.*, EXISTS (SELECT 1 FROM jx_field f WHERE f.id = t.id) AS has_injection FROM jx_type t
WHERE t.kind = 'MAPPER' OR t.role IN ('Impl', 'Entity') OR t.id IN (SELECT id FROM jx_field) OR t.id IN (SELECT target FROM jx_field WHERE target IS NOT NULL)""",
    "jx_call": """SELECT m.signature AS caller, m.project, f.type_fqn AS callee_fqn, concat('m', CAST((m.k + CASE f.field WHEN 'f1' THEN 1 ELSE 3 END) % 8 AS VARCHAR(20))) AS callee, f.field AS via_field, f.injection_type AS call_type, f.target_kind, f.target_project
FROM jx_method m JOIN jx_field f ON f.id = m.id AND f.field IN ('f1', 'f2') WHERE m.kind IN ('CLASS', 'ARIES_JOB')
UNION ALL SELECT m.signature, m.project, m.class_fqn, concat('m', CAST((m.k + 2) % 8 AS VARCHAR(20))), NULL, 'Internal', m.kind, m.project FROM jx_method m WHERE m.kind IN ('CLASS', 'ARIES_JOB') AND m.id IN (SELECT id FROM jx_field)
UNION ALL SELECT m.signature, m.project, m.class_fqn, 'ping', NULL, 'Internal', m.kind, m.project FROM jx_method m WHERE m.kind IN ('CLASS', 'ARIES_JOB') AND m.id IN (SELECT id FROM jx_field)""",
    "jx_edge": """SELECT DISTINCT c.caller AS src, coalesce(m.signature, concat(c.callee_fqn, '.', c.callee, '(...)')) AS dst,
CASE WHEN c.target_kind = 'MAPPER' THEN 'DB_CALL' WHEN c.call_type = 'Reference' AND c.project <> c.target_project THEN 'DUBBO_CALLS' ELSE 'CALLS' END AS rel_type, c.via_field,
CASE WHEN c.call_type = 'Reference' AND c.project = c.target_project THEN 'Internal' ELSE c.call_type END AS call_type
FROM jx_call c LEFT JOIN jx_method m ON m.class_fqn = c.callee_fqn AND m.name = c.callee""",
    "jx_route": """SELECT m.signature, m.id, r.path, r.verb FROM jx_method m JOIN (SELECT 1 AS k, '/t/a' AS path, 'POST' AS verb UNION ALL SELECT 1, '/b', 'POST' UNION ALL SELECT 2, '/api/**', 'GET' UNION ALL SELECT 3, '/p{id}', 'PUT'
 UNION ALL SELECT 4, '', 'DELETE' UNION ALL SELECT 5, '/r', 'POST' UNION ALL SELECT 6, '/x/y', 'PATCH') r ON r.k = m.k WHERE m.role = 'Controller'""",
    "jx_listen": """SELECT m.signature, m.class_fqn, CASE m.k WHEN 5 THEN concat('topic_', CAST(m.id % 10 AS VARCHAR(20))) WHEN 6 THEN 'q1' ELSE concat('rk_', CAST(m.id % 4 AS VARCHAR(20))) END AS topic, CASE m.k WHEN 5 THEN 'kafka' WHEN 6 THEN 'rabbit' ELSE 'rocket' END AS mq_type,
CASE m.k WHEN 5 THEN concat('g', CAST(m.id % 3 AS VARCHAR(20))) WHEN 7 THEN 'the group' END AS grp FROM jx_method m JOIN jx_queue q ON q.id = m.id WHERE m.k IN (5, 6, 7)
UNION ALL SELECT m.signature, m.class_fqn, concat('q2/', CAST(m.id % 4 AS VARCHAR(20))), 'rabbit', NULL FROM jx_method m JOIN jx_queue q ON q.id = m.id WHERE m.k = 6""",
    "jx_send": """SELECT m.signature, CASE m.k WHEN 3 THEN concat('topic_', CAST(m.id % 10 AS VARCHAR(20))) ELSE concat('rk_', CAST(m.id % 4 AS VARCHAR(20))) END AS topic, CASE m.k WHEN 3 THEN 'kafka' ELSE 'rocket' END AS mq_type FROM jx_method m JOIN jx_queue q ON q.id = m.id WHERE m.k IN (3, 4)""",
    # annotations of types and methods, but for the routes
    "jx_note": """SELECT 'Type' AS label, fqn AS owner, CASE role WHEN 'Controller' THEN 'RestController' WHEN 'Service' THEN 'Service' WHEN 'Impl' THEN 'DubboService' WHEN 'Job' THEN 'AriesCronJobListener' WHEN 'Dao' THEN 'Repository' WHEN 'Entity' THEN 'Entity' ELSE 'Mapper' END AS name
FROM jx_type WHERE role IN ('Controller', 'Service', 'Impl', 'Job', 'Dao', 'Entity', 'Store')
UNION ALL SELECT 'Type', fqn, 'RequestMapping' FROM jx_type WHERE role = 'Controller'
UNION ALL SELECT DISTINCT 'Method', signature, CASE verb WHEN 'POST' THEN CASE path WHEN '/r' THEN 'RequestMapping' ELSE 'PostMapping' END WHEN 'GET' THEN 'GetMapping' WHEN 'PUT' THEN 'PutMapping' WHEN 'DELETE' THEN 'DeleteMapping' ELSE 'PatchMapping' END FROM jx_route
UNION ALL SELECT DISTINCT 'Method', signature, CASE mq_type WHEN 'kafka' THEN 'KafkaListener' WHEN 'rabbit' THEN 'RabbitListener' ELSE 'RocketMQMessageListener' END FROM jx_listen
UNION ALL SELECT 'Method', signature, 'Scheduled' FROM jx_method WHERE kind = 'ARIES_JOB' AND k = 0
UNION ALL SELECT 'Field', concat(class_fqn, '.', field), CASE injection_type WHEN 'Reference' THEN 'DubboReference' ELSE injection_type END FROM jx_field
UNION ALL SELECT 'Parameter', concat(signature, '#0'), 'Param' FROM jx_method WHERE params LIKE '@Param%'""",
}
_BASE = ("nation", "customer", "orders")
_READ = ("jx_top", "jx_type", "jx_queue", "jx_field", "jx_impl", "jx_extends")
#: Those of them that others are often made of: written, so that each is made once.
_OFTEN = ("jx_type", "jx_field")
#: Types for which the rendered sources have one file.
PER_FILE = 4000


def program_sql(sql: str) -> str:
    """An oracle query over the program: its relations as CTEs before the query's own."""
    ctes = ",\n".join(f"{n} AS ({body})" for n, body in PROGRAM.items())
    return f"WITH RECURSIVE {ctes},\n{sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH RECURSIVE {ctes}\n{sql}"


def _told(sql: str, n: int) -> str:
    """A relation with the number of customers in place of a join with it, beside which Spark would hold every type against every other one (jx_extends)."""
    return re.sub(r"\bn\.n\b", str(max(n, 1)), sql.replace("CROSS JOIN (SELECT count(*) AS n FROM customer) n", ""))


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    for t in _BASE:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    n = spark.table("customer").count()
    out = {}
    for name in _READ:
        df = spark.sql(_told(PROGRAM[name], n))
        out[name] = written(df) if name in _OFTEN else df
        out[name].createOrReplaceTempView(name)
    return out


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _number(c: str | Column, modulo: int) -> Column:
    return ((F.col(c) if isinstance(c, str) else c) % modulo).cast("string")


def _fields(r: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(id, fields): the declarations of each type; (file_id, path): what they have imported."""
    f = r["jx_field"]
    note = F.when(F.col("injection_type") == "Reference", 'DubboReference(check = false, note = "{;\\"/*")').otherwise(F.col("injection_type"))
    kind = F.when(F.col("style") == "dotted", F.col("type_fqn")).otherwise(F.element_at(F.split("type_fqn", "\\."), -1))
    second = f.where("field = 'g1'").select("id", F.lit("f1").alias("field"), F.lit(", g1 = null, unused2").alias("more"))  # further declarators
    one = f.where("field <> 'g1'").join(second, ["id", "field"], "left")
    one = one.withColumn("text", _text("  @", note, "\n  private /* ; */ ", kind, " ", F.col("field"), F.coalesce("more", F.lit("")), ";\n"))
    imported = f.where("style = 'imported'").select("file_id", F.col("type_fqn").alias("path"))
    return one.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("text")), "").alias("fields"), F.collect_set("field").alias("has")), imported


def _body(k: Column) -> Column:
    call = lambda name, shift: F.when(F.col(f"has_{name}"), _text(f"    {name}.m", _number(k + shift, 8), "(1);\n")).otherwise("")
    own = _text("    if (size() > 0 && a < contains(\"*/\")) { this.m", _number(k + 2, 8), "(); }\n")
    queue = F.when(F.col("has_kt") & (k == 3), '    kt.send(TOPIC, "/*");\n').when(F.col("has_rt") & (k == 4), _text('    this.rt.sendAsync("rk_', _number("id", 4), ':tag:x", new Object() { });\n')).otherwise("")
    odd = "    String s1 = \"} f1.m7(\" + '\"' + '\\''; // f2.m9(1) \"\n    String s2 = \"\"\"\n      \" f1.m6(1); /* {{ \\\"\"\" \"\"\";\n"
    late = "    xs.forEach(x -> { Supplier<Map<String, int[]>> g = HashMap<String, int[]>::new; });\n    Runnable r = new Runnable() { @Override public void run() { isEmpty(); } };\n    ping(new Thing<Long>(2), \"/**\"); super.m1();\n    return null; /** f1.m5(1) */\n  }\n"
    return F.when(F.col("kind").isin("INTERFACE", "MAPPER"), ";\n").otherwise(_text(" throws E {\n", odd, call("f1", 1), call("f2", 3), own, queue, late))


#: Parameter lists that a method of a number may have, by its order's status; and its least number (a remainder of 8).
_LISTS, _LEAST = 3, -7


def _declared(spark: SparkSession) -> DataFrame:
    """(id, methods): the methods that orders give a type (jx_method), as the bits of a number: one for each number and parameter list. Their texts, which are
    long, are made where they are put together, and never moved."""
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    bit = ((F.col("o_orderkey") % 8 - _LEAST) * _LISTS + status).cast("int")
    return spark.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("methods"))


def _methods() -> Column:
    """The text of a type's methods, from its columns and the bits in `methods`."""
    control, queue = F.col("role") == "Controller", F.col("has_kt")
    row = F.concat(F.lit("final Row"), _number("id", 5), F.lit("DO row"))

    def one(bit: Column) -> Column:
        k, of = F.floor(bit / _LISTS).cast("long") + _LEAST, bit % _LISTS
        note = (
            F.when(control & (k == 1), '  @PostMapping(path = {"/t" + "/a", "/b"}, produces = "no/path")\n')
            .when(control & (k == 2), '  @GetMapping("/api/**")\n')
            .when(control & (k == 3), '  @org.web.PutMapping(consumes = X.Y, value = "/p{id}")\n')
            .when(control & (k == 4), "  @DeleteMapping\n")
            .when(control & (k == 5), '  @RequestMapping(value = "/r", method = RequestMethod.GET)\n')
            .when(control & (k == 6), '  @PatchMapping("/x/y") // "/no"\n')
            .when((F.col("kind") == "ARIES_JOB") & (k == 0), '  @Scheduled("0 * * * *")\n')
            .when(queue & (k == 5), _text('  @KafkaListener(topics = TOPIC, groupId = "g', _number("id", 3), '")\n'))
            .when(queue & (k == 6), _text('  @RabbitListener(queues = {"q1", "q2/', _number("id", 4), '"})\n'))
            .when(queue & (k == 7), _text('  @RocketMQMessageListener(topic = "rk_', _number("id", 4), '", consumerGroup = Names.GROUP)\n'))
            .otherwise("")
        )
        head = F.when(F.col("kind").isin("INTERFACE", "MAPPER"), "  String ").otherwise("  public <R extends List<R>> Map<String, R[]> ")
        params = F.when((of == 1) & (F.col("role") == "Store") & (F.col("id") % 2 == 0), row).when(of == 0, "").when(of == 1, '@Param("s, )") String s').otherwise("int[] n, List<Map<String, Long>> xs")
        return _text(note, head, "m", k.cast("string"), "(", params, ")", _body(k))

    there = F.filter(F.sequence(F.lit(0), F.lit(15 * _LISTS - 1)), lambda b: F.call_function("shiftright", F.col("methods"), b).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.array_join(F.sort_array(F.transform(there, one)), "")


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path, content: a Java file per top type."""
    r = relations(spark, sf_dir)
    fields, imported = _fields(r)
    up = r["jx_impl"].groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("up")), ", ").alias("ups"))
    parent = r["jx_extends"].select("id", F.element_at(F.split("up", "\\."), -1).alias("parent"))
    t = r["jx_type"].join(fields, "id", "left").join(_declared(spark), "id", "left").join(up, "id", "left").join(parent, "id", "left")
    for c in ("f1", "f2", "kt", "rt"):
        t = t.withColumn(f"has_{c}", F.coalesce(F.array_contains("has", c), F.lit(False)))
    t = t.withColumn("methods", F.when(F.col("role") == "Inner", F.lit(1 << -_LEAST * _LISTS)).otherwise(F.coalesce("methods", F.lit(0))).cast("long"))  # an inner type has m0()
    t = written(t.withColumn("fields", F.coalesce("fields", F.lit(""))).drop("has"))
    top = t.where("role <> 'Inner'").count()
    row = F.concat(F.lit("Row"), _number("id", 5), F.lit("DO"))
    store = t.where("role = 'Store'").select("file_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("com.acme.entity."), row)).otherwise(F.concat(F.lit("com.acme.domain.Line"), _number("id", 5), F.lit("Entity"))).alias("path"))
    imported = imported.union(r["jx_extends"].where("NOT own").select("file_id", "up")).union(store).distinct()
    imports = imported.groupBy(F.col("file_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(_text("import ", F.col("path"), ";\n"))), "").alias("imports"))
    inner = t.where("role = 'Inner'").select(F.col("file_id").alias("id"), _text("  static class ", F.col("name"), "<X> {\n", F.col("fields"), _methods(), "  }\n").alias("inner"))
    t = t.where("role <> 'Inner'").join(imports, "id", "left").join(inner, "id", "left").withColumn("imports", F.coalesce("imports", F.lit("")))
    t = t.repartition(max(spark.sparkContext.defaultParallelism, top // PER_FILE), "id")  # many files, as each is parsed by one task at most
    t = t.withColumn("methods", _methods())
    role = F.when(F.col("role") == "Controller", '@RestController @RequestMapping("/x/**")\n').when(F.col("role") == "Service", "@Service\n").when(F.col("role") == "Impl", "@DubboService(version = \"1\")\n").when(F.col("role") == "Job", "@AriesCronJobListener\n").when(F.col("role") == "Dao", "@Repository\n").when(F.col("role") == "Entity", "@Entity\n").when(F.col("role") == "Store", "@Mapper\n").otherwise("")
    word = F.when(F.col("kind").isin("INTERFACE", "MAPPER"), "interface ").otherwise("class ")
    extra = _text("  static final String TOPIC = \"topic_", _number("id", 10), '";\n  static final String GROUP = "the group";\n')
    long = F.when(F.col("id") % 500 == 0, F.concat(F.lit('  String BIG = "'), F.repeat(F.lit("x\\\\{\\\"/*"), 13000), F.lit('";\n'))).otherwise("")
    constants = F.when(F.col("kind") == "CLASS", F.concat(extra, long)).otherwise("")
    head = _text("/* class Fake { */\npackage ", F.col("package"), ";\nimport java.util.*;\nimport static com.lib.Help.ping;\nimport static com.lib.Extra.*;\n", F.col("imports"), "// class Fake2 { \"\n", role, "public ", word, F.col("name"))
    ends = _text(F.coalesce(_text(" extends ", F.col("parent")), F.lit("")), F.coalesce(_text(" implements ", F.col("ups")), F.lit("")))
    text = _text(head, ends, " {\n", constants, F.col("fields"), F.coalesce("inner", F.lit("")), F.when(F.col("kind") == "CLASS", "  enum Level { LOW(1) { int x() { return 0; } }, HIGH; int m3() { return 1; } }\n").otherwise(""), F.col("methods"), "}\n")
    return t.select("project", "path", text.alias("content"))
