"""The load: facts of source files become tables of nodes and typed edges, in the order in which one needs the other.

Only business types are loaded, and what they declare. Every edge names its ends by label and key; an edge whose
ends are not there is dropped, but for calls, parents and interfaces, which make stubs. All steps are joins on keys (full names and
signatures), so the load of many projects is one job; no step runs row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import simple_name
from ..operators.traverse import Levels, reach
from .durable import GraphStore
from .graph import Graph
from .java import INJECTING, Facts, business_types, call_edges, full_name, parsed
from .store import bucketed, small, written

#: Columns of edges that only some types have.
_MORE = ("via_field", "call_type", "field_name", "group")


@dataclass(frozen=True)
class Loaded:
    """project(name, path); type(fqn, kind, name, ..., project, is_external: true for stubs of calls); method(signature, name, class_fqn, return_type,
    visibility); field(signature, name, class_fqn, type_fqn, injection_type); table(name); endpoint(id, path, http_method, service_name);
    job(fqn, name, job_type, cron_expr, class_fqn); topic(name, mq_type, group); edge(src_label, src, rel_type, dst_label, dst, via_field,
    call_type, field_name, group)."""

    project: DataFrame
    type: DataFrame
    method: DataFrame
    field: DataFrame
    table: DataFrame
    endpoint: DataFrame
    job: DataFrame
    topic: DataFrame
    edge: DataFrame


def _edge(df: DataFrame, src_label: str | Column, src: str, rel_type: str | Column, dst_label: str | Column, dst: str) -> DataFrame:
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    more = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in _MORE]
    return df.select(of(src_label).alias("src_label"), F.col(src).alias("src"), of(rel_type).alias("rel_type"), of(dst_label).alias("dst_label"), F.col(dst).alias("dst"), *more)


def load(facts: Facts, projects: DataFrame, packages: bool = False, rabbit_as_rocket: bool = True, once: bool = False) -> Loaded:
    """The graph of facts; projects: name, path. With packages, CONTAINS edges also lead from a package to its types.

    Consumers of Rabbit queues are written with the edge of Rocket, as the graph's readers expect, or with one of their own (MQ_RABBIT_CONSUMER). A topic has
    the group of its first listener, in the order of project, file and method. A type that two files declare is taken once (the smallest project and path). Facts without business types give empty tables.

    What several tables are made of is written, so that it is taken out of the parsed rows once. once: the edges will be read once (to be saved), and are not."""
    types = written(business_types(facts).groupBy("fqn").agg(F.min_by(F.struct(*[c for c in facts.types.columns if c != "fqn"], "has_injection"), F.struct("project", "file_path")).alias("x")).select("fqn", "x.*"))
    key = types.select(F.col("fqn").alias("class_fqn"), F.col("kind").alias("class_kind"))
    of_types = lambda df, c="class_fqn": df.join(key.withColumnRenamed("class_fqn", c), c)
    # a signature is of one class, by which the rows lie already
    methods = written(of_types(facts.methods.select("class_fqn", "name", "signature", "return_type", "visibility")).dropDuplicates(["class_fqn", "signature"]))
    fields = written(of_types(facts.fields).withColumn("signature", F.concat_ws(".", "class_fqn", "name")).dropDuplicates(["class_fqn", "name"]))
    signatures = methods.select("signature")
    edges = []
    unique = [  # one of each as they are made
        _edge(types, "Project", "project", "CONTAINS", F.col("kind"), "fqn"),
        _edge(methods, F.col("class_kind"), "class_fqn", "DECLARES", "Method", "signature"),
        _edge(fields, F.col("class_kind"), "class_fqn", "DECLARES", "Field", "signature"),
        _edge(fields.withColumn("field_name", F.col("name")), F.col("class_kind"), "class_fqn", "HAS_FIELD", "Field", "signature"),
    ]
    if packages:
        unique.append(_edge(types, "Package", "package", "CONTAINS", F.col("kind"), "fqn"))
    tables = of_types(facts.tables, "fqn")
    edges.append(_edge(tables, F.col("class_kind"), "fqn", "MAPPER_FOR_TABLE", "Table", "table_name"))
    endpoints = written(facts.endpoints.join(signatures, "signature", "left_semi"))
    edges.append(_edge(endpoints, "Method", "signature", "EXPOSES", "RpcEndpoint", "id"))
    jobs = written(facts.jobs.join(signatures, "signature", "left_semi"))
    edges.append(_edge(jobs, "Method", "signature", "EXECUTES_JOB", "Job", "job_fqn"))
    listen = written(of_types(facts.listeners.withColumnRenamed("fqn", "class_fqn")).withColumn("key", F.concat_ws(":", "mq_type", "topic")))
    own = F.when(F.col("mq_type") == "kafka", "KAFKA") if rabbit_as_rocket else F.when(F.col("mq_type").isin("kafka", "rabbit"), F.upper("mq_type"))
    kind = lambda role: F.concat(F.lit("MQ_"), own.otherwise("ROCKET"), F.lit(f"_{role}"))
    edges.append(_edge(listen, F.col("class_kind"), "class_fqn", kind("CONSUMER"), "MQ_TOPIC", "key"))
    edges.append(_edge(listen.drop("group").join(signatures, "signature", "left_semi"), "MQ_TOPIC", "key", "MQ_CONSUMES_METHOD", "Method", "signature"))
    sends = written(of_types(facts.sends, "fqn").withColumn("key", F.concat_ws(":", "mq_type", "topic")))
    edges.append(_edge(sends, "Method", "signature", kind("PRODUCER"), "MQ_TOPIC", "key"))
    remote = fields.where("injection_type = 'Reference'").withColumn("field_name", F.col("name")).join(key.select(F.col("class_fqn").alias("type_fqn"), F.col("class_kind").alias("to_kind")), "type_fqn")
    unique.append(_edge(remote.groupBy("class_kind", "class_fqn", "to_kind", "type_fqn").agg(F.max("field_name").alias("field_name")), F.col("class_kind"), "class_fqn", "DUBBO_DEPENDS", F.col("to_kind"), "type_fqn"))
    up = lambda c: types.select("fqn", "kind", "is_dubbo_service", F.explode(F.array_distinct(c)).alias("up"))
    kinds = key.select(F.col("class_fqn").alias("up"), F.col("class_kind").alias("up_kind"))
    unique.append(_edge(up("implements").where("is_dubbo_service").join(kinds, "up"), F.col("kind"), "fqn", "DUBBO_PROVIDES", F.col("up_kind"), "up"))

    calls = written(facts.calls.join(types.select(F.col("fqn").alias("caller_fqn")), "caller_fqn", "left_semi"))
    called, stubs = call_edges(replace(facts, types=types, methods=methods, calls=calls))
    called = written(called)
    unique.append(_edge(called, "Method", "src", F.col("rel_type"), "Method", "dst"))
    made = called.where(F.col("dst").endswith("(...)")).select(F.col("dst").alias("signature")).distinct()
    made = made.withColumn("long", F.regexp_extract("signature", r"^(.*)\(", 1)).select("signature", simple_name(F.col("long")).alias("name"), F.regexp_replace("long", r"\.[^.]*$", "").alias("class_fqn"))
    stub = lambda c, kind, known: up(c).join(known, "up", "left_anti").select(F.col("up").alias("fqn"), F.lit(kind).alias("kind")).distinct()
    stubs = stubs.join(types.select("fqn"), "fqn", "left_anti").select("fqn", "kind", "name", "is_external")
    parents = stub("extends", "CLASS", kinds.where("up_kind = 'CLASS'"))
    interfaces = stub("implements", "INTERFACE", kinds.select("up").union(stubs.select("fqn")).union(parents.select("fqn")))
    every = types.unionByName(stubs, allowMissingColumns=True).unionByName(parents, allowMissingColumns=True).unionByName(interfaces, allowMissingColumns=True)
    every = written(every.dropDuplicates(["kind", "fqn"]))
    label = every.groupBy(F.col("fqn").alias("up")).agg(F.min_by("kind", F.struct(F.col("file_path").isNull(), "kind")).alias("up_kind"))
    unique.append(_edge(up("extends"), F.col("kind"), "fqn", "EXTENDS", "CLASS", "up"))
    unique.append(_edge(up("implements").join(label, "up"), F.col("kind"), "fqn", "IMPLEMENTS", F.col("up_kind"), "up"))
    owner = label.select(F.col("up").alias("class_fqn"), F.col("up_kind").alias("class_kind"))
    unique.append(_edge(made.join(owner, "class_fqn"), F.col("class_kind"), "class_fqn", "DECLARES", "Method", "signature"))
    edge = reduce(DataFrame.unionByName, [reduce(DataFrame.unionByName, edges).dropDuplicates(["src_label", "src", "rel_type", "dst_label", "dst"]), *unique])
    return Loaded(
        projects,
        every,
        methods.select("signature", "name", "class_fqn", "return_type", "visibility").unionByName(made, allowMissingColumns=True),
        fields.select("signature", "name", "class_fqn", "type_fqn", "injection_type"),
        tables.select(F.col("table_name").alias("name")).distinct(),
        endpoints.select("id", "path", "http_method", F.regexp_replace(F.regexp_replace("signature", r"\(.*", ""), r"\.[^.]*$", "").alias("service_name")).dropDuplicates(["id"]),
        jobs.select(F.col("job_fqn").alias("fqn"), simple_name(F.col("job_fqn")).alias("name"), "job_type", "cron_expr", F.col("fqn").alias("class_fqn")).dropDuplicates(["fqn"]),
        _topics(listen, sends),
        edge if once else written(edge, "rel_type"),
    )


def _topics(listen: DataFrame, sends: DataFrame) -> DataFrame:
    heard = listen.groupBy(F.col("topic").alias("name"), "mq_type").agg(F.min_by("group", F.struct("project", "file_path", "signature")).alias("group"))
    return heard.unionByName(sends.select(F.col("topic").alias("name"), "mq_type").distinct().join(heard, ["name", "mq_type"], "left_anti"), allowMissingColumns=True)


def topics(facts: Facts) -> DataFrame:
    """The topics of a load alone: nothing else of it is made."""
    own = written(business_types(facts).select("fqn").distinct())
    of_types = lambda df: df.join(own, "fqn", "left_semi")
    return _topics(written(of_types(facts.listeners)), of_types(facts.sends))


#: The tables of a loaded graph and the column each is dealt by, and further columns that are looked up.
STORED = {"project": "name", "type": "fqn", "method": "signature", "field": "signature", "table": "name", "endpoint": "id", "job": "fqn", "topic": "name", "edge": "src"}
LOOKED_UP = {"type": ("name", "file_path", "project"), "method": ("class_fqn", "name"), "field": ("class_fqn", "type_fqn"), "endpoint": ("path",), "job": ("class_fqn",), "edge": ("dst",)}


def save(store: GraphStore, loaded: Loaded) -> int:
    """Writes a loaded graph as the store's next version: all its tables, or none, are seen."""
    return store.commit({name: (getattr(loaded, name), by) for name, by in STORED.items()}, LOOKED_UP)


def stored(store: GraphStore) -> Loaded:
    """The graph as of the store's version."""
    return Loaded(*(store.read(name) for name in STORED))


def save_project(store: GraphStore, loaded: Loaded) -> int:
    """Adds a project's graph to what is stored: rows of keys that are there already are replaced, but a stub never replaces what was read from a
    file. The edges of both stay, one of each. One version."""
    if not store.version:
        return save(store, loaded)
    old, tables = stored(store), {}
    for name, by in STORED.items():
        have, new = getattr(old, name), getattr(loaded, name)
        if name == "edge":
            rows = have.unionByName(new).dropDuplicates(["src_label", "src", "rel_type", "dst_label", "dst"])
        else:
            key = [by, "kind"] if name == "type" else [by, "mq_type"] if name == "topic" else [by]
            if name in ("type", "method"):  # stubs have no file, and no return type
                told = "file_path" if name == "type" else "return_type"
                new = new.join(have.where(F.col(told).isNotNull()).select(by), by, "left_anti").unionByName(new.where(F.col(told).isNotNull())).dropDuplicates(key)
                if name == "type":
                    have = have.join(new.where(F.col(told).isNotNull()).select(by), by, "left_anti")
            rows = have.join(new.select(key), key, "left_anti").unionByName(new)
        tables[name] = (rows.select(have.columns), by)
    return store.commit(tables, LOOKED_UP)


def as_graph(loaded: Loaded) -> Graph:
    """The loaded tables in the shape that the query plans take; ids are 64-bit hashes of names, signatures and project names."""
    of = lambda c: F.xxhash64(c)
    e = lambda *kinds: loaded.edge.where(F.col("rel_type").isin(*kinds))
    spark = loaded.type.sparkSession
    method = loaded.method.select(of("signature").alias("method_id"), "name", of("class_fqn").alias("type_id"), "signature", "return_type", "class_fqn")
    call = e("CALLS", "DB_CALL", "DUBBO_CALLS").select(of("src").alias("src"), of("dst").alias("dst"), "via_field", "rel_type")
    ends = call.join(method.select(F.col("method_id").alias("src"), F.col("type_id").alias("a")), "src").join(method.select(F.col("method_id").alias("dst"), F.col("type_id").alias("b")), "dst")
    topic = e("MQ_CONSUMES_METHOD").select(F.col("dst").alias("signature"), F.col("src").alias("key"), F.lit("consumer").alias("role")).union(e("MQ_KAFKA_PRODUCER", "MQ_ROCKET_PRODUCER").select("src", "dst", F.lit("producer")))
    made = {
        "project": loaded.project.select(of("name").alias("project_id"), "name", "path"),
        "type": loaded.type.select(of("fqn").alias("type_id"), "fqn", "name", "package", "kind", "arch_layer", F.when(F.col("project").isNotNull(), of("project")).alias("project_id"), F.coalesce("is_external", F.lit(False)).alias("is_external")),
        "method": method.drop("class_fqn"),
        "call": call,
        "implements": e("IMPLEMENTS").select(of("src").alias("src"), of("dst").alias("dst")),
        "depends_on": ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(),
        "mapper_table": e("MAPPER_FOR_TABLE").select(of("src").alias("src"), F.col("dst").alias("table_name")),
        "endpoint": e("EXPOSES").select(of("src").alias("method_id"), F.col("dst").alias("id")).join(loaded.endpoint, "id").select("method_id", "path", "http_method"),
        "job": e("EXECUTES_JOB").select(of("src").alias("method_id"), F.col("dst").alias("fqn")).join(loaded.job, "fqn").select("method_id", F.col("fqn").alias("job_fqn"), "job_type", "cron_expr"),
        "mq": topic.join(loaded.method.select("signature", "class_fqn"), "signature").select(of("signature").alias("method_id"), of("class_fqn").alias("type_id"), F.substring_index("key", ":", -1).alias("topic"), F.substring_index("key", ":", 1).alias("mq_type"), "role"),
    }
    return Graph(spark, **{k: bucketed(v, "src", "rel_type") if k == "call" else bucketed(v, "src") if k == "depends_on" else written(v) for k, v in made.items()})


def scan_report(loaded: Loaded) -> DataFrame:
    """(project, total_classes, total_methods, report): the report is JSON of modules, their packages and classes with method counts."""
    n = loaded.method.where(~F.col("signature").endswith("(...)")).groupBy(F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("method_count"))
    c = loaded.type.where("file_path IS NOT NULL").join(n, "fqn", "left").withColumn("method_count", F.coalesce("method_count", F.lit(0).cast("long")))
    one = F.struct("fqn", "name", "kind", "file_path", "is_mapper", F.coalesce("arch_layer", F.lit("Other")).alias("arch_layer"), "method_count")
    p = c.groupBy("project", "module", "package").agg(F.sort_array(F.collect_list(one)).alias("classes"), F.sum("method_count").alias("n"))
    m = p.groupBy("project", "module").agg(F.sum(F.size("classes")).alias("total_classes"), F.count("*").alias("total_packages"), F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("package", "classes")))).alias("packages"))
    r = m.groupBy("project").agg(F.sum("total_classes").alias("total_classes"), F.sum("n").alias("total_methods"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("module", F.struct("total_classes", "total_packages", F.to_json("packages").alias("packages")))))).alias("modules"))
    return r.select("project", "total_classes", "total_methods", F.to_json("modules").alias("report"))


def requested(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that define a wanted class, wanted classes that no file defines); files: project, path, content; wanted: fqn.

    A quick look at the text alone: its package and the names after class, interface and enum. A class in several files: the first path."""
    package = F.regexp_extract("content", r"package\s+([\w.]+)\s*;", 1)
    name = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(?:class|interface|enum)\s+(\w+)"), F.lit(1))))
    has = files.select("project", "path", package.alias("package"), name.alias("name")).where("package <> ''").withColumn("fqn", F.concat_ws(".", "package", "name"))
    has = written(has.join(wanted.select("fqn").distinct(), "fqn", "left_semi").groupBy("fqn").agg(F.min(F.struct("project", "path")).alias("x")).select("fqn", "x.*"))
    return files.join(has.select("project", "path").distinct(), ["project", "path"], "left_semi"), wanted.select("fqn").distinct().join(has, "fqn", "left_anti")


def definitions(files: DataFrame) -> DataFrame:
    """(fqn, project, path): the file that defines each class, by a quick look at its text; of several the first."""
    package = F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    name = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(?:class|interface|enum|record)\s+(\w+)"), F.lit(1))))
    rows = files.select("project", "path", package.alias("package"), name.alias("name"))
    rows = rows.withColumn("fqn", F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")))
    return rows.groupBy("fqn").agg(F.min(F.struct("project", "path")).alias("x")).select("fqn", "x.*")


def references(declared: DataFrame) -> DataFrame:
    """(project, path, fqn): the parents, interfaces and types of injected fields that each file names; declared: rows of `java.parsed`."""
    injecting = F.filter("fields", lambda f: F.exists(f["annotations"], lambda a: a["name"].isin(*INJECTING)))
    bare = F.explode(F.array_distinct(F.concat("extends", "implements", F.transform(injecting, lambda f: f["type"]))))
    rows = declared.where("kind IN ('class', 'interface', 'record')").select("project", F.col("file_path").alias("path"), "package", "imported", "whole", bare.alias("bare"))
    return rows.select("project", "path", full_name(F.col("bare"), F.col("package"), F.col("imported"), F.col("whole")).alias("fqn")).distinct()


#: Bytes of sources that a scan to a fixpoint parses at once.
AT_ONCE = 1 << 30


def scan_closure(files: DataFrame, roots: DataFrame, scanned: DataFrame | None = None, rounds: int = 100, at_once: int = AT_ONCE, defined: DataFrame | None = None) -> DataFrame:
    """(fqn, depth, project, path): every class that a scan from the roots (fqn) asks for, in the round in which it does, with the file that defines it (null:
    none does). A scan reads a class's file, and asks for what the file names, until nothing new is asked for.

    scanned (fqn): the memo of former scans, whose classes are not asked for again; the result's names, added to it, are the
    next memo. Files are searched for definitions once (not at all if `defined` gives those of `definitions`, written), and each is parsed once: all together if they hold at most `at_once` bytes (then the rounds are
    joins of names alone), else each in the round that first needs it. A round holds new names only."""
    where = written(definitions(files)) if defined is None else defined
    first = roots.select("fqn").distinct()
    if scanned is not None:
        first = first.join(scanned.select("fqn"), "fqn", "left_anti")
    if files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0] <= at_once:
        named = references(parsed(files))
        if scanned is not None:
            named = named.join(scanned.select("fqn"), "fqn", "left_anti")
        edges = where.join(named.select("project", "path", F.col("fqn").alias("dst")), ["project", "path"]).select(F.col("fqn").alias("src"), "dst")
        asked = reach(written(edges), first.select(F.lit(0).cast("long").alias("source"), F.col("fqn").alias("node")), rounds)
        return asked.select(F.col("node").alias("fqn"), "depth").join(where, "fqn", "left").select("fqn", "depth", "project", "path")
    asked, read_ = Levels(first), None
    frontier = asked.add(first, 0)
    for depth in range(1, rounds + 1):
        need = where.join(small(frontier), "fqn", "left_semi").select("project", "path").distinct()
        if read_ is None:
            read_ = Levels(need)
            need = read_.add(need, depth)
        else:
            need = read_.add(need.join(read_.all().select("project", "path"), ["project", "path"], "left_anti"), depth)
        if not read_.last:
            break
        named = references(parsed(files.join(small(need), ["project", "path"], "left_semi"))).select("fqn").distinct()
        named = named.join(asked.all().select("fqn"), "fqn", "left_anti")
        if scanned is not None:
            named = named.join(scanned.select("fqn"), "fqn", "left_anti")
        frontier = asked.add(named, depth)
        if not asked.last:
            break
    return asked.all().join(where, "fqn", "left").select("fqn", "depth", "project", "path")


def pending(facts_types: DataFrame, known: DataFrame) -> DataFrame:
    """Full names that types refer to (parents and interfaces) and that are neither among them nor in known (fqn): what a scan has still to read."""
    refs = facts_types.select(F.explode(F.concat("extends", "implements")).alias("fqn")).distinct()
    return refs.join(facts_types.select("fqn"), "fqn", "left_anti").join(known.select("fqn"), "fqn", "left_anti")


def implementers(files: DataFrame, interface: str) -> DataFrame:
    """(project, path, fqn): files whose text says that a class implements the interface (by its simple name), with their first class."""
    fqn = F.concat_ws(".", F.nullif(F.regexp_extract("content", r"package\s+([\w.]+)\s*;", 1), F.lit("")), F.regexp_extract("content", r"\bclass\s+(\w+)", 1))
    return files.where(F.col("content").rlike(rf"\bimplements\s+[^{{]*\b{interface}\b")).select("project", "path", fqn.alias("fqn"))


def to_scan(projects: DataFrame, scanned: DataFrame, force: bool = False) -> DataFrame:
    """Projects (name) that are not scanned yet; all of them if forced."""
    return projects if force else projects.join(scanned.select("name"), "name", "left_anti")
