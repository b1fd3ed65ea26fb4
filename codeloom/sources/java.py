"""Facts from Java sources (files: path, content, project) as typed tables.

A task reads each file once (`lexer`: a linear scanner and a reader of declarations), and gives a row per type with what it declares as nested
columns. All else is Spark's: members, calls, routes, jobs, queues and constants are exploded from these rows, names are resolved
by lookups in the file's imports, and calls by joins with the fields of their class. A file without a class or
interface gives a row in `errors`, never a failed task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.rules import architecture_layer, http_method, simple_name, table_name, visibility
from .files import is_java_source
from .lexer import read
from .store import ship, written

# Annotations and names that decide what a declaration is.
INJECTING = ("Reference", "DubboReference", "Resource", "Autowired")
ROUTES = ("RequestMapping", "PostMapping", "GetMapping", "PutMapping", "DeleteMapping", "PatchMapping", "MobileAPI")
JOBS = ("Scheduled", "AriesCronJobListener", "XxlJob")
LISTENERS = ("KafkaListener", "RocketMQMessageListener", "RabbitListener")
SENDING = ("send", "sendDelay", "sendAsync", "convertAndSend")
PRIMITIVE = ("int", "long", "short", "byte", "float", "double", "boolean", "char", "void")
LANG = ("String", "Object", "Integer", "Long", "Boolean", "Double", "Float", "Byte", "Short", "Character")
# Names of library methods, which without a qualifier are no calls of a class's own methods.
LIBRARY = """
stream collect map filter forEach reduce flatMap
orElse orElseGet ifPresent isPresent get of empty
equals hashCode toString clone finalize
wait notify notifyAll getClass
findFirst findAny anyMatch allMatch noneMatch
sorted distinct limit skip peek count
max min sum average toArray
join split replace substring trim toLowerCase toUpperCase
contains startsWith endsWith indexOf lastIndexOf
add remove clear size isEmpty iterator
put putAll containsKey containsValue keySet values entrySet
equalsIgnoreCase compareTo compareToIgnoreCase
""".split()
#: Rows that a task holds before it gives them on.
_AT_ONCE = 64

_NOTES = "array<struct<name string, args array<struct<name string, literal boolean, value string>>>>"
_PARSED = f"""project string, file_path string, package string, imports array<string>, imported map<string, string>, whole array<string>,
constants array<struct<name string, value string>>, failed string, name string, kind string, annotations {_NOTES}, modifiers array<string>,
extends array<string>, implements array<string>, fields array<struct<name string, type string, value string, annotations {_NOTES}, modifiers array<string>>>,
methods array<struct<name string, return_type string, parameters array<struct<type string, name string, annotations {_NOTES}>>,
annotations {_NOTES}, modifiers array<string>, calls array<struct<qualifier string, callee string, literal boolean, argument string>>>>"""


def _rows(project: str, path: str, text: str) -> list[dict]:
    """A row per type of a file; one without a type's columns if there is none or the text cannot be read."""
    row = {"project": project, "file_path": path}
    try:
        r = read(text)
    except (RecursionError, IndexError) as e:  # annotations in annotations in annotations
        return [{**row, "failed": type(e).__name__}]
    imported: dict[str, str] = {}
    for name, _ in r.imports:
        if not name.endswith(".*"):
            imported.setdefault(name.rsplit(".", 1)[-1], name)
    row |= {"package": r.package, "imports": [n for n, _ in r.imports], "imported": list(imported.items()), "whole": [n[:-1] for n, static in r.imports if n.endswith(".*") and not static]}
    return [{**row, "constants": [] if i else r.constants(), **t} for i, t in enumerate(r.types)] or [row]


def parsed(files: DataFrame) -> DataFrame:
    """A row per type declared in the Java files among `files`, of any kind and depth (_PARSED); constants on a file's first row only."""
    ship(files.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(_PARSED.replace("\n", " ")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in it:
            for project, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held += _rows(project, path, text)
                if len(held) >= _AT_ONCE:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    src = files.where(is_java_source(F.col("path"))).select("project", F.col("path").alias("file_path"), F.coalesce("content", F.lit("")).alias("text"))
    return src.mapInArrow(run, _PARSED)


@dataclass(frozen=True)
class Facts:
    """types, methods, fields, calls, endpoints, jobs, listeners, sends, tables and errors, one DataFrame each; declared: every type as it was parsed,
    with its full name (`wider` reads annotations, parameters and all members from it); source: the parsed rows."""

    types: DataFrame
    methods: DataFrame
    fields: DataFrame
    calls: DataFrame
    endpoints: DataFrame
    jobs: DataFrame
    listeners: DataFrame
    sends: DataFrame
    tables: DataFrame
    errors: DataFrame
    declared: DataFrame
    source: DataFrame


def names(annotations: str | Column) -> Column:
    return F.transform(annotations, lambda a: a["name"])


def full_name(bare: Column, package: Column, imported: Column, whole: Column) -> Column:
    """A type's full name: as written if dotted, a primitive, of java.lang, imported, of the file's package, or (in no package) of the
    first package that is imported whole."""
    first = F.get(whole, F.lit(0))
    own = F.when(package != "", F.concat_ws(".", package, bare)).when(first.isNotNull(), F.concat(first, bare)).otherwise(bare)
    return F.when(bare.contains(".") | bare.isin(*PRIMITIVE), bare).when(bare.isin(*LANG), F.concat(F.lit("java.lang."), bare)).otherwise(F.coalesce(F.try_element_at(imported, bare), own))


def _resolved(bare: Column) -> Column:
    return full_name(bare, F.col("package"), F.col("imported"), F.col("whole"))


def module(path: Column, project: Column) -> Column:
    """The module of a file: the first part of its path, or the project if that is src."""
    first = F.element_at(F.split(path, "/"), 1)
    return F.when(first == "src", project).otherwise(first)


def _declared(src: DataFrame) -> DataFrame:
    """The classes and interfaces (records are classes) with full name and what their annotations make of them."""
    t = src.where("kind IN ('class', 'interface', 'record')")
    notes = names("annotations")
    fqn = F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    dubbo = F.array_contains(notes, "DubboService") | F.array_contains(notes, "Service") & F.exists("imports", lambda i: i.contains("dubbo"))
    is_interface = F.col("kind") == "interface"
    mapper = F.array_contains(notes, "Mapper") | is_interface & (F.col("name").endswith("Mapper") | F.lower("package").contains("mapper"))
    return t.select("*", fqn.alias("fqn"), is_interface.alias("is_interface"), dubbo.alias("is_dubbo_service"), mapper.alias("is_mapper"))


def _types(t: DataFrame) -> DataFrame:
    notes = names("annotations")
    job = F.arrays_overlap(notes, F.array(F.lit("AriesCronJobListener"), F.lit("AriesJob")))
    kind = F.when(F.col("is_mapper"), "MAPPER").when(job, "ARIES_JOB").when(F.col("is_interface"), "INTERFACE").otherwise("CLASS")
    layer = architecture_layer(F.col("name"), F.col("package"), notes, F.col("is_mapper"), F.col("is_dubbo_service"), F.col("implements"))
    up = [F.transform(c, _resolved).alias(c) for c in ("extends", "implements")]
    return t.select("project", module(F.col("file_path"), F.col("project")).alias("module"), "fqn", kind.alias("kind"), "name", "package", layer.alias("arch_layer"), visibility(F.col("modifiers")).alias("visibility"), "file_path", "is_dubbo_service", "is_mapper", *up)


def _methods(t: DataFrame) -> DataFrame:
    """A row per method, with its signature (simple names of its parameters' types)."""
    m = t.select("project", "file_path", "fqn", "package", "imported", "whole", F.explode("methods").alias("m"))
    types = F.transform("m.parameters", lambda p: simple_name(p["type"]))
    m = m.select("*", "m.name", "m.return_type", types.alias("parameters"), F.col("m.annotations").alias("notes"), F.col("m.modifiers").alias("modifiers"), F.col("m.calls").alias("invoked"))
    return m.withColumn("signature", F.concat(F.concat_ws(".", "fqn", "name"), F.lit("("), F.concat_ws(",", "parameters"), F.lit(")"))).drop("m")


def _fields(t: DataFrame) -> DataFrame:
    """A row per injected field and declarator."""
    f = t.select("fqn", "project", "package", "imported", "whole", F.explode("fields").alias("f"))
    injecting = F.get(F.filter(names("f.annotations"), lambda a: a.isin(*INJECTING)), F.lit(0))
    f = f.withColumn("injection_type", injecting).where("injection_type IS NOT NULL")
    return f.select("project", F.col("fqn").alias("class_fqn"), "f.name", _resolved(F.col("f.type")).alias("type_fqn"), F.when(F.col("injection_type") == "DubboReference", "Reference").otherwise(F.col("injection_type")).alias("injection_type"))


def _calls(m: DataFrame, fields: DataFrame, constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, sends): only types that own an injected field are searched for calls; what sends to a queue is no call. The fields of a class travel with its
    methods, so calls, of which there are many more, are not moved to meet them."""
    own = fields.groupBy(F.col("class_fqn").alias("fqn")).agg(F.collect_set(F.struct("name", "type_fqn", "injection_type")).alias("own"))

    def told(m: DataFrame) -> DataFrame:
        c = m.select("project", "file_path", "fqn", "signature", "invoked").join(own, "fqn").select("project", "file_path", "fqn", "signature", "own", F.explode("invoked").alias("c"))
        c = c.select("project", "file_path", "fqn", "signature", "c.*", F.explode_outer(F.filter("own", lambda x: x["name"] == F.col("c.qualifier"))).alias("o"))
        return c.select("*", F.col("o.type_fqn").alias("target"), "o.injection_type").drop("o")

    maybe = told(m.where(F.exists("invoked", lambda c: c["callee"].isin(*SENDING)))).where(F.col("target").isNotNull() & F.col("callee").isin(*SENDING))  # few of all calls
    c = told(m)
    kind = F.lower(simple_name(F.col("target")))
    inner = F.col("target").isNull() & (F.col("qualifier").isNull() | (F.col("qualifier") == "this")) & ~F.col("callee").isin(*LIBRARY)
    sender = F.coalesce((F.col("callee") == "send") & kind.contains("kafka") | F.col("callee").isin(*SENDING) & kind.contains("rocket"), F.lit(False))
    sent = maybe.where(sender).withColumn("constant", F.when(~F.col("literal"), simple_name(F.col("argument")))).join(constants, ["file_path", "constant"], "left")
    topic = F.when(F.col("literal"), F.col("argument")).otherwise(F.coalesce("value", "constant"))
    kafka = F.lower("target").contains("kafka")
    sent = sent.select("project", "fqn", "signature", F.when(kafka, topic).otherwise(F.element_at(F.split(topic, ":"), 1)).alias("topic"), F.when(kafka, "kafka").otherwise("rocket").alias("mq_type")).where("topic IS NOT NULL").distinct()
    calls = c.where(F.col("target").isNotNull() & ~sender | inner)
    known = F.col("target").isNotNull()
    calls = calls.select("project", F.col("fqn").alias("caller_fqn"), F.col("signature").alias("caller"), F.coalesce("target", "fqn").alias("callee_fqn"), F.col("callee").alias("callee_name"), F.when(known, F.col("qualifier")).alias("via_field"), F.coalesce("injection_type", F.lit("Internal")).alias("call_type"))
    return calls.distinct(), sent


def _values(note: Column, *attributes: str) -> Column:
    """The values (literal, value) of an annotation's attributes; "" is the one without a name."""
    return F.filter(note["args"], lambda x: x["name"].isin(*attributes))


def _marked(m: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """A row per annotation (a) of a method that is among the wanted."""
    return m.withColumn("a", F.explode(F.filter("notes", lambda x: x["name"].isin(*wanted))))


def _endpoints(m: DataFrame) -> DataFrame:
    route = _marked(m, ROUTES).select("project", "signature", "a")
    paths = F.transform(F.filter(_values(F.col("a"), "", "path", "value"), lambda x: x["literal"]), lambda x: x["value"])
    route = route.select("project", "signature", F.explode(F.when(F.size(paths) > 0, paths).otherwise(F.array(F.lit("")))).alias("path"), http_method(F.col("a.name")).alias("http_method"))
    return route.select(F.concat("path", F.lit("#"), simple_name(F.col("signature"))).alias("id"), "project", "signature", "path", "http_method")


def _jobs(m: DataFrame) -> DataFrame:
    """A method is a job by the first such annotation; a lone unnamed value is its expression."""
    first = F.get(F.filter("notes", lambda x: x["name"].isin(*JOBS)), F.lit(0))
    job = m.withColumn("a", first).where("a IS NOT NULL")
    cron = F.when((F.size("a.args") == 1) & (F.col("a.args")[0]["name"] == "") & F.col("a.args")[0]["literal"], F.nullif(F.col("a.args")[0]["value"], F.lit("")))
    return job.select("project", "fqn", "signature", F.concat_ws(".", "fqn", "name").alias("job_fqn"), F.when(F.col("a.name") == "Scheduled", "scheduled").otherwise("listener").alias("job_type"), cron.alias("cron_expr"))


def _listeners(m: DataFrame, constants: DataFrame) -> DataFrame:
    """A row per listening method and topic: a literal, a constant's value, or the constant's name. Listeners without a topic are none."""
    a = _marked(m, LISTENERS).select("project", "file_path", "fqn", "signature", "a")
    value = lambda *attributes: F.get(_values(F.col("a"), *attributes), F.lit(0))
    a = a.select("*", F.explode(_values(F.col("a"), "topics", "topic", "queues", "queue", "")).alias("t"), value("groupId", "consumerGroup").alias("g"))
    for name, x in (("topic", "t"), ("group", "g")):
        told = constants.select("file_path", F.col("constant").alias(f"{x}_name"), F.col("value").alias(f"{x}_value"))
        a = a.withColumn(f"{x}_name", F.when(~F.col(f"{x}.literal"), simple_name(F.col(f"{x}.value")))).join(told, ["file_path", f"{x}_name"], "left")
        a = a.withColumn(name, F.when(F.col(f"{x}.literal"), F.col(f"{x}.value")).otherwise(F.coalesce(f"{x}_value", f"{x}_name")))
    kind = F.when(F.col("a.name").startswith("Kafka"), "kafka").when(F.col("a.name").startswith("Rocket"), "rocket").otherwise("rabbit")
    return a.select("project", "file_path", "fqn", "signature", "topic", kind.alias("mq_type"), F.nullif("group", F.lit("")).alias("group"))


def extract(files: DataFrame) -> Facts:
    """The facts of the Java files among `files` (path, content, project); tests and pruned folders are left out."""
    src = written(parsed(files))  # one parse serves every table below
    return _facts(src, _methods(_declared(src)))


def by_method(facts: Facts) -> Facts:
    """The same facts, made of methods that are written as rows: for a load, which reads them several times."""
    return _facts(facts.source, written(_methods(facts.declared).drop("package", "imported", "whole")))


def _facts(src: DataFrame, m: DataFrame) -> Facts:
    error = F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("kinds") > 0, "no class or interface").otherwise("no type declaration")
    plain = src.groupBy("project", "file_path").agg(F.max("failed").alias("failed"), F.count("name").alias("kinds"), F.max(F.coalesce(F.col("kind").isin("class", "interface", "record"), F.lit(False))).alias("any"))
    errors = plain.where("NOT any").select("project", "file_path", error.alias("error"))
    t = _declared(src)
    methods = m.select("project", F.col("fqn").alias("class_fqn"), "name", "signature", "return_type", "parameters", names("notes").alias("annotations"), visibility(F.col("modifiers")).alias("visibility"))
    constants = src.select("file_path", F.explode("constants").alias("k")).groupBy("file_path", F.col("k.name").alias("constant")).agg(F.min("k.value").alias("value"))
    fields = _fields(t)
    calls, sends = _calls(m, fields, constants)
    types = _types(t)
    tables = types.where("is_mapper").select("fqn", table_name(F.col("name")).alias("table_name"))
    return Facts(types, methods, fields, calls, _endpoints(m), _jobs(m), _listeners(m, constants), sends, tables, errors, t, src)


def business_types(facts: Facts) -> DataFrame:
    """Types that take part in the business: they inject, are injected, are mappers, Dubbo services or entities, or are interfaces of an api package."""
    injects = facts.fields.select(F.col("class_fqn").alias("fqn")).distinct().withColumn("has_injection", F.lit(True))
    used = facts.fields.select(F.col("type_fqn").alias("fqn")).distinct().withColumn("injected", F.lit(True))
    t = facts.types.join(injects, "fqn", "left").join(used, "fqn", "left").withColumn("has_injection", F.coalesce("has_injection", F.lit(False)))
    return t.where(F.col("has_injection") | F.col("injected").isNotNull() | F.col("is_mapper") | F.col("is_dubbo_service") | (F.col("arch_layer") == "Entity") | (F.col("kind") == "INTERFACE") & F.col("fqn").contains(".api.")).drop("injected")


def call_edges(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs): each call to every overload of its name in the class called; a class or method that is not there gives a stub of
    an external interface. DB_CALL to mappers, DUBBO_CALLS to references in another project or outside, else CALLS."""
    m = facts.methods.select(F.col("class_fqn").alias("callee_fqn"), F.col("name").alias("callee_name"), F.col("signature").alias("found"))
    own = facts.types.select(F.col("fqn").alias("callee_fqn"), F.col("project").alias("callee_project"), "is_mapper")
    c = facts.calls.join(m, ["callee_fqn", "callee_name"], "left").join(own, "callee_fqn", "left")
    dst = F.coalesce("found", F.concat(F.concat_ws(".", "callee_fqn", "callee_name"), F.lit("(...)")))
    far = (F.col("call_type") == "Reference") & (F.col("callee_project").isNull() | (F.col("callee_project") != F.col("project")))
    kind = F.when(F.coalesce("is_mapper", F.lit(False)), "DB_CALL").when(far, "DUBBO_CALLS").otherwise("CALLS")
    edges = c.select(F.col("caller").alias("src"), dst.alias("dst"), kind.alias("rel_type"), "via_field", F.when((F.col("call_type") == "Reference") & ~far, "Internal").otherwise(F.col("call_type")).alias("call_type"))
    edges = edges.groupBy("src", "rel_type", "dst").agg(F.max(F.struct("via_field", "call_type")).alias("x")).select("src", "dst", "rel_type", "x.via_field", "x.call_type")  # one per pair
    stubs = facts.calls.select("callee_fqn").distinct().join(own, "callee_fqn", "left").where("callee_project IS NULL").select(F.col("callee_fqn").alias("fqn"), simple_name(F.col("callee_fqn")).alias("name"), F.lit("INTERFACE").alias("kind"), F.lit(True).alias("is_external")).distinct()
    return edges, stubs
