"""Every query over the graph and the tables against its SQL in DuckDB, and traversals on a small graph by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom import plans
from codeloom.operators.traverse import lengths, on_paths, reach, simple_paths
from codeloom.plans import relational
from codeloom.plans.relational import dubbo_with_fallback
from codeloom.sources.graph import Graph
from codeloom.streaming.ingest import current, ingest

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    rel = duck.sql(plans.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)


EDGES = [(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (6, 6)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, "f", "CALLS") for a, b in EDGES], "src bigint, dst bigint, via_field string, rel_type string")


def _seed(spark, *nodes):
    return spark.createDataFrame([(n, n) for n in nodes], "source bigint, node bigint")


def test_reach(spark, edges):
    got = lambda zero, depth: {(r.source, r.node): r.depth for r in reach(edges, _seed(spark, 1, 6), depth, zero).collect()}
    assert got(True, 10) == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 2, (1, 5): 3, (6, 6): 0}
    assert got(False, 10) == {(1, 1): 3, (1, 2): 1, (1, 3): 2, (1, 4): 2, (1, 5): 3, (6, 6): 1}
    assert got(True, 1) == {(1, 1): 0, (1, 2): 1, (6, 6): 0}


def test_levels_do_not_exchange_edges(spark, sf_dir):
    """Joined with a frontier too large to broadcast, the stored edges are read as they lie: the one exchange is the frontier's."""
    from codeloom.sources.graph import open_graph

    g = open_graph(spark, sf_dir)
    plan = lambda edges: spark.range(100).select(F.col("id").alias("src")).hint("merge").join(edges, "src")._jdf.queryExecution().executedPlan().toString()
    assert plan(g.calls("CALLS")).count("Exchange hashpartitioning") == 1
    assert plan(g.depends_on).count("Exchange hashpartitioning") == 1
    shuffled = g.calls("CALLS").select("dst", F.col("src").alias("src")).repartition(3)
    assert plan(shuffled).count("Exchange") >= 2


def test_lengths_keep_every_depth(spark, edges):
    seeds = _seed(spark, 1).withColumn("depth", F.lit(0))
    got = {(r.node, r.depth) for r in lengths(edges.select("src", "dst"), seeds, 5).collect()}
    assert {(2, 1), (2, 4), (1, 0), (1, 3), (5, 3)} <= got and (2, 2) not in got


def test_simple_paths_repeat_no_ancestor(spark, edges):
    got = {tuple(r.path) for r in simple_paths(edges, _seed(spark, 1).select("node"), 9, 80).collect()}
    assert got == {(1,), (1, 2), (1, 2, 3), (1, 2, 4), (1, 2, 4, 5)}
    assert {tuple(r.path) for r in simple_paths(edges, _seed(spark, 2).select("node"), 1, 1).collect()} == {(2,), (2, 3)}


def test_trees_keep_every_child_of_a_hub(spark, monkeypatch):
    """A method that calls 100 others: all are in the tree, and in the class statistics."""
    from types import SimpleNamespace

    from codeloom.plans import chain

    call = spark.createDataFrame([(0, i) for i in range(1, 101)], "src bigint, dst bigint")
    owned = spark.range(101).select(F.col("id").alias("method_id"), F.lit(1).cast("long").alias("type_id"), F.lit("a.A").alias("fqn"), F.concat(F.lit("m"), "id").alias("name"), F.col("id").cast("string").alias("signature"), F.lit("CLASS").alias("kind"))
    none = spark.createDataFrame([], "type_id bigint, src bigint, dst bigint, table_name string, fqn string, kind string")
    g = SimpleNamespace(calls=lambda *k: call.where(F.lit("CALLS" in k)), method=owned, owned=owned, mapper_table=none.select("src", "table_name"), type=none.select("type_id", "fqn", "kind"))
    monkeypatch.setattr(chain, "_same_name_impl", lambda g, m: none.select("src", "dst"))
    monkeypatch.setattr(chain, "start", lambda g: spark.createDataFrame([(0,)], "node bigint"))
    assert chain.call_tree(g, chain.start(g)).count() == 101
    assert [(r.call_count, r.n_methods) for r in chain._trv23(g).collect()] == [(101, 101)]


def test_results_as_json(spark):
    import json

    from codeloom.plans import chain

    sets = {"tables": spark.createDataFrame([("p", None), ("a", 't"1')], "project string, table_name string"), "endpoints": spark.createDataFrame([], "path string")}
    got = json.loads(chain.result_json(sets, 'found "it"').first()["result"])
    assert got == {"success": True, "message": 'found "it"', "tables": [{"project": "a", "table_name": 't"1'}, {"project": "p", "table_name": None}], "endpoints": []}


def test_search_says_what_it_cuts(spark):
    from codeloom.plans.texts import search

    files = spark.createDataFrame([("p/a.txt", "x\nhit\ny\nHIT"), ("p/b.txt", "hit\n" * 600), ("q/c.txt", "hit"), ("p/d.md", "hit")], "path string, content string")
    got = {r.file: r for r in search(files, "hit", "p", "*.txt", 3, 1).collect()}
    assert sorted(got) == ["a.txt", "b.txt"] and [m.line_number for m in got["a.txt"].matches] == [2, 4] and len(got["b.txt"].matches) == 1
    assert got["a.txt"].truncated and got["a.txt"].full_content and got["b.txt"].full_content is None and got["a.txt"].matches[0].before == "x"
    assert not search(files, "hit", "q").first().truncated and search(files, "none").collect() == []


def test_on_paths(spark, edges):
    one = lambda n: _seed(spark, n).select("node")
    assert {(r.src, r.dst) for r in on_paths(edges, one(1), one(5), 3).collect()} == {(1, 2), (2, 4), (4, 5)}
    assert on_paths(edges, one(1), one(5), 2).collect() == []


def _moved(spark):
    """Rows that the application's stages have shuffled."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_a_project_are_not_moved(spark):
    """Interfaces without an implementation meet every class of their project that has the method; one full name may be that of two interfaces."""
    types = [(i, f"a.I{i}", "INTERFACE", 1) for i in range(300)] + [(1000 + i, f"a.C{i}", "CLASS", 1) for i in range(300)] + [(300, "a.I0", "INTERFACE", 2), (301, "a.I0", "INTERFACE", 1), (2000, "b.C", "CLASS", 2)]
    methods = [(i, "m", i, f"{f}.m()") for i, f, _, _ in types] + [(5000, "m", 0, "a.I0.m(int)")]
    graph = Graph(
        spark,
        spark.createDataFrame([(1, "one", "/1"), (2, "two", "/2")], "project_id long, name string, path string"),
        spark.createDataFrame([(i, f, f[2:], "a", k, None, p, False) for i, f, k, p in types], "type_id long, fqn string, name string, package string, kind string, arch_layer string, project_id long, is_external boolean"),
        spark.createDataFrame(methods, "method_id long, name string, type_id long, signature string"),
        spark.createDataFrame([(2000, i, "f", "DUBBO_CALLS") for i in [*range(302), 5000]], "src long, dst long, via_field string, rel_type string"),
        spark.createDataFrame([(1007, 7)], "src long, dst long"),
        *[None] * 5,
    )
    before = _moved(spark)
    df = dubbo_with_fallback(graph)
    got = [tuple(r) for r in df.collect()]
    assert _moved(spark) - before < 30000
    want = {(f"a.I{i}", "m", f"a.C{c}", f"a.C{c}.m()") for i in range(300) for c in range(300) if i != 7} | {("a.I7", "m", "a.C7", "a.C7.m()"), ("a.I0", "m", "b.C", "b.C.m()")}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_come_by_project_and_name(spark, monkeypatch):
    """The rows of a task turn to another project and name only once, and hold few signatures, so that a file of them holds each text once."""
    monkeypatch.setattr(relational, "SIGNATURE_BYTES", 2000)
    types = [(i, f"p{i % 2}.I{i}", "INTERFACE", i % 2) for i in range(20)] + [(100 + i, f"p{i % 2}.C{i}", "CLASS", i % 2) for i in range(200)]
    methods = [(4 * i + m, f"m{m}", i, f"{f}.m{m}()") for i, f, _, _ in types for m in range(4)]
    graph = Graph(
        spark,
        spark.createDataFrame([(0, "zero", "/0"), (1, "one", "/1")], "project_id long, name string, path string"),
        spark.createDataFrame([(i, f, f[3:], f[:2], k, None, p, False) for i, f, k, p in types], "type_id long, fqn string, name string, package string, kind string, arch_layer string, project_id long, is_external boolean"),
        spark.createDataFrame(methods, "method_id long, name string, type_id long, signature string"),
        spark.createDataFrame([(400, i, "f", "DUBBO_CALLS") for i in range(80)], "src long, dst long, via_field string, rel_type string"),
        spark.createDataFrame([], "src long, dst long"),
        *[None] * 5,
    )
    got = dubbo_with_fallback(graph).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted((f"p{i % 2}.I{i}", f"m{m}", f"p{i % 2}.C{c}", f"p{i % 2}.C{c}.m{m}()") for i in range(20) for c in range(200) if i % 2 == c % 2 for m in range(4))
    for part in {r.part for r in got}:
        rows = [r for r in got if r.part == part]
        turns = [(r.impl_fqn[:2], r.dubbo_method) for r in rows]
        assert 1 + sum(a != b for a, b in zip(turns, turns[1:])) == len(set(turns))
        assert sum(map(len, {r.impl_signature for r in rows})) < 4000


def test_ingest_replaces_files(spark, tmp_path):
    drop, store, ck = (str(tmp_path / x) for x in ("drop", "store", "ck"))
    row = lambda name, at: ("p", "src/A.java", f"package a;\npublic class {name} {{ void do{name}() {{ }} }}", at)
    for names in (["A"], ["B"]):
        rows = [row(n, None) for n in names]
        spark.createDataFrame(rows, "project string, path string, content string, modified_time timestamp").withColumn("modified_time", F.current_timestamp()).write.mode("append").parquet(drop)
        q = ingest(spark, drop, store, ck)
        assert q.awaitTermination(120)
        assert [r.name for r in current(spark, f"{store}/types").collect()] == names
        assert [r.name for r in current(spark, f"{store}/methods").collect()] == [f"do{n}" for n in names]
