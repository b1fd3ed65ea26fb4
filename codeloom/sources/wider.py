"""Wider facts of the same parse: annotations with their attributes, parameters, every member and call, and the generic graph of entities made of them.

`extract` keeps what a call graph needs; here everything that a file declares becomes an entity, and references are edges by name, whether or
not what they name is there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import simple_name, table_name
from .java import Facts, full_name


def _resolved(c: str) -> Column:
    return full_name(F.col(c), F.col("package"), F.col("imported"), F.col("whole"))


def attributes(note: Column) -> Column:
    """An annotation's attributes as a map; several values of one are joined by commas, and the one without a name is `value`."""
    named = lambda x: F.when(x["name"] == "", "value").otherwise(x["name"])
    values = lambda k: F.array_join(F.transform(F.filter(note["args"], lambda x: named(x) == k), lambda x: x["value"]), ",")
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(note["args"], named)), lambda k: F.struct(k, values(k))))


def methods(facts: Facts) -> DataFrame:
    """Every method: fqn (of its class), signature, name, return_type, parameters (type, name, annotations), annotations, modifiers, calls."""
    m = facts.declared.select("project", "file_path", "fqn", "package", "imported", "whole", F.explode("methods").alias("m"))
    types = F.transform("m.parameters", lambda p: simple_name(p["type"]))
    m = m.select("*", "m.*", F.concat(F.concat_ws(".", "fqn", "m.name"), F.lit("("), F.concat_ws(",", types), F.lit(")")).alias("signature")).drop("m")
    return m.dropDuplicates(["signature"])


def fields(facts: Facts) -> DataFrame:
    """Every field, a row per declarator: fqn (of its class), key, name, type_fqn, annotations, modifiers."""
    f = facts.declared.select("project", "file_path", "fqn", "package", "imported", "whole", F.explode("fields").alias("f")).select("*", "f.*").drop("f")
    return f.withColumn("type_fqn", _resolved("type")).withColumn("key", F.concat_ws(".", "fqn", "name")).dropDuplicates(["key"])


def parameters(facts: Facts) -> DataFrame:
    """Every parameter: key (signature#position), signature, position, name, type_fqn, annotations."""
    p = methods(facts).select("project", "file_path", "fqn", "package", "imported", "whole", "signature", F.posexplode("parameters").alias("position", "p")).select("*", "p.*").drop("p")
    return p.withColumn("type_fqn", _resolved("type")).withColumn("key", F.concat("signature", F.lit("#"), F.col("position").cast("string")))


def annotated(facts: Facts) -> DataFrame:
    """Every use of an annotation: label (Type, Field, Method, Parameter), owner (its key), fqn (of the class it is in), name, attributes (map)."""
    parts = [("Type", facts.declared, "fqn"), ("Field", fields(facts), "key"), ("Method", methods(facts), "signature"), ("Parameter", parameters(facts), "key")]
    rows = [df.select(F.lit(label).alias("label"), F.col(key).alias("owner"), "fqn", F.explode("annotations").alias("a")) for label, df, key in parts]
    return reduce(DataFrame.unionByName, rows).select("label", "owner", "fqn", F.col("a.name").alias("name"), attributes(F.col("a")).alias("attributes"))


def depends_on(facts: Facts) -> DataFrame:
    """(src, dst): a class depends on what its calls say by their text: the qualifier as it is written, else what the called name is
    imported as (static imports are imports; of names imported whole nothing is known)."""
    c = methods(facts).select("fqn", "imported", F.explode("calls").alias("c"))
    text = F.when(F.col("c.qualifier") == "this", F.lit(None)).otherwise(F.col("c.qualifier"))
    return c.select(F.col("fqn").alias("src"), F.coalesce(text, F.try_element_at("imported", F.col("c.callee"))).alias("dst")).where("dst IS NOT NULL").distinct()


def inferred_tables(facts: Facts) -> DataFrame:
    """(fqn, table_name) of each mapper by its strongest evidence: its name, then the first entity among its methods' parameters, then the
    first entity among its imports. Entities lie in packages of domain or entity; their endings DO and Entity go."""
    m = facts.declared.where("is_mapper")
    entity = lambda c: F.lower(c).contains("domain") | F.lower(c).contains("entity")
    bare = lambda c: table_name(F.regexp_replace(simple_name(c), "(?:DO|Entity)$", ""))
    named = m.where(F.col("name").endswith("Mapper")).select("fqn", F.lit(1).alias("rank"), F.lit(0).alias("place"), table_name(F.col("name")).alias("table_name"))
    p = m.select("fqn", "package", "imported", "whole", F.posexplode(F.flatten(F.transform("methods", lambda x: F.transform(x["parameters"], lambda y: y["type"])))).alias("place", "type"))
    p = p.where(simple_name(F.col("type")).rlike("^[A-Z]")).withColumn("type_fqn", _resolved("type")).where(entity(F.col("type_fqn")))
    given = p.select("fqn", F.lit(2), "place", bare(F.col("type_fqn")))
    i = m.select("fqn", F.posexplode("imports").alias("place", "path")).where(entity(F.col("path")) & ~(F.lower("path").contains("mapper") & ~F.lower("path").contains("domain.db") & ~F.lower("path").contains("entity")))
    evidence = named.union(given).union(i.where(~F.col("path").endswith("*")).select("fqn", F.lit(3), "place", bare(F.col("path"))))
    return evidence.groupBy("fqn").agg(F.min_by("table_name", F.struct("rank", "place")).alias("table_name"))


@dataclass(frozen=True)
class Entities:
    """node(label, key, name, fqn: the class it belongs to, file_path, attributes); edge(src_label, src, rel_type, dst_label, dst, fqn, attributes)."""

    node: DataFrame
    edge: DataFrame


def entities(facts: Facts) -> Entities:
    """Packages, types, fields, methods, parameters, annotations, topics and tables, one each, and the edges between them, one for each pair and
    type. Ends of edges need not be there: a class may extend, return or call what no file declares."""
    none = F.lit(None).cast("map<string,string>")
    t, m, f, p, a = facts.declared, methods(facts), fields(facts), parameters(facts), annotated(facts)

    def node(df: DataFrame, label: str, key: str, name: Column, more: Column = none) -> DataFrame:
        has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(label).alias("label"), F.col(key).alias("key"), name.alias("name"), has("fqn").alias("fqn"), has("file_path").alias("file_path"), more.alias("attributes"))

    def edge(df: DataFrame, src_label: str | Column, src: str, rel_type: str, dst_label: str, dst: str | Column, more: Column = none) -> DataFrame:
        fqn = F.col("fqn") if "fqn" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(src_label).alias("src_label") if isinstance(src_label, str) else src_label.alias("src_label"), F.col(src).alias("src"), F.lit(rel_type).alias("rel_type"), F.lit(dst_label).alias("dst_label"), (F.col(dst) if isinstance(dst, str) else dst).alias("dst"), fqn.alias("fqn"), more.alias("attributes"))

    of = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    topic = lambda df: df.withColumn("topic_key", F.concat_ws(":", "mq_type", "topic"))
    listen, send = topic(facts.listeners), topic(facts.sends)
    tables = inferred_tables(facts)
    nodes = [
        node(t.where("package <> ''").select("package").distinct(), "Package", "package", F.col("package")),
        node(t, "Type", "fqn", F.col("name"), of(kind=F.col("kind"), modifiers=F.concat_ws(",", "modifiers"))),
        node(f, "Field", "key", F.col("name"), of(type=F.col("type_fqn"), modifiers=F.concat_ws(",", "modifiers"))),
        node(m, "Method", "signature", F.col("name"), of(return_type=F.col("return_type"), modifiers=F.concat_ws(",", "modifiers"))),
        node(p, "Parameter", "key", F.col("name"), of(type=F.col("type_fqn"), position=F.col("position").cast("string"))),
        node(a.select("name").distinct(), "Annotation", "name", F.col("name")),
        node(listen.select("topic_key", "topic").union(send.select("topic_key", "topic")).distinct(), "MQTopic", "topic_key", F.col("topic")),
        node(tables.select("table_name").distinct(), "Table", "table_name", F.col("table_name")),
    ]
    up = lambda c: t.select("fqn", "package", "imported", "whole", F.explode(c).alias("up")).withColumn("dst", _resolved("up"))
    returned = m.where("return_type <> 'void'").withColumn("dst", _resolved("return_type"))
    remote = facts.fields.where("injection_type = 'Reference'").withColumnRenamed("class_fqn", "fqn")
    edges = [
        edge(t.where("package <> ''"), "Package", "package", "CONTAINS", "Type", "fqn"),
        edge(up("extends"), "Type", "fqn", "EXTENDS", "Type", "dst"),
        edge(up("implements"), "Type", "fqn", "IMPLEMENTS", "Type", "dst"),
        edge(f, "Type", "fqn", "DECLARES", "Field", "key"),
        edge(m, "Type", "fqn", "DECLARES", "Method", "signature"),
        edge(p, "Method", "signature", "HAS_PARAMETER", "Parameter", "key"),
        edge(returned, "Method", "signature", "RETURNS", "Type", "dst"),
        edge(a, F.col("label"), "owner", "ANNOTATED_BY", "Annotation", "name", F.col("attributes")),
        edge(depends_on(facts).withColumn("fqn", F.col("src")), "Type", "src", "DEPENDS_ON", "Type", "dst"),
        edge(remote, "Type", "fqn", "DUBBO_CALLS", "Type", "type_fqn", of(field_name=F.col("name"))),
        edge(up("implements").join(t.where("is_dubbo_service").select("fqn"), "fqn", "left_semi"), "Type", "fqn", "DUBBO_PROVIDES", "Type", "dst"),
        edge(listen, "Method", "signature", "LISTENS_TO_MQ", "MQTopic", "topic_key"),
        edge(send, "Method", "signature", "SENDS_TO_MQ", "MQTopic", "topic_key"),
        edge(tables, "Type", "fqn", "MAPPER_FOR_TABLE", "Table", "table_name"),
    ]
    one = reduce(DataFrame.unionByName, nodes).dropDuplicates(["label", "key"])
    return Entities(one, reduce(DataFrame.unionByName, edges).dropDuplicates(["src_label", "src", "rel_type", "dst_label", "dst"]))


def merged(old: Entities, new: Entities) -> Entities:
    """old with what new adds: classes that old has already, and all that belongs to them, stay as they were scanned first; what belongs to no class
    (packages, annotations, topics, tables) is added if it is not there."""
    known = old.node.where("label = 'Type'").select("fqn").distinct()

    def more(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
        return a.unionByName(b.join(known, "fqn", "left_anti").join(a.select(key), key, "left_anti").select(a.columns))

    return Entities(more(old.node, new.node, ["label", "key"]), more(old.edge, new.edge, ["src_label", "src", "rel_type", "dst_label", "dst"]))
