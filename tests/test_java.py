"""The Java reader on ordinary and hard texts, wider facts, and scans to a fixpoint."""

import subprocess
import sys
import time
from pathlib import Path

import pytest

from codeloom.sources import java, load, wider
from codeloom.sources.lexer import read

FILES = "project string, path string, content string"

HARD = '''package a.b;
import x.Y; import static q.R.go; import static q.S.*;
@RequestMapping("/api/**") public class C<T extends Comparable<T> & java.io.Serializable> extends Base<Map<String, List<T>>> implements I<T>, J {
  private final Map<String, List<int[]>> m = new HashMap<String, List<int[]>>(), n;
  static final String TOP = "a" + "b /* ", Q = """
     text "block" // no { "" \\""" still
     """;
  @Autowired Svc svc;
  @GetMapping(value = {"/api/**", "/b"}, produces = X.Y, n = 3) public <R> List<R> get(final @Param("x, )") Map<String, R> p, int[] xs, String... more) throws E, F { // svc.c()
     /* "svc.no(" */ String s = "a /* b"; char c = '"'; char d = '\\''; int z = a < b ? f(1) : svc.h(TOP);
     list.stream().map(x -> svc.go(x)).filter(Foo::bar); this.svc.call("t:x", 1); super.get(null);
     new Z<Q>(k()) { @Override public int inner() { return svc.deep(); } };
     if (a > foo(1)) { bar(); } class Local { void lo() { in1(); } } synchronized (x) { } return a.b.c(2); }
  abstract void none();
  C() { ctor(); }
  enum E { A(1) { void q() {} class InEnum { } }, B; int e() { return x(); } }
  record P(int a, String b) { int s() { return a; } }
  @interface Note { String value() default "x{"; }
}'''


def test_declarations_of_a_hard_file():
    r = read(HARD)
    assert (r.package, r.imports) == ("a.b", [("x.Y", False), ("q.R.go", True), ("q.S.*", True)])
    types = {t["name"]: t for t in r.types}
    assert {n: t["kind"] for n, t in types.items()} == {"C": "class", "Local": "class", "E": "enum", "InEnum": "class", "P": "record", "Note": "annotation"}
    c = types["C"]
    assert (c["extends"], c["implements"]) == (["Base"], ["I", "J"])
    assert [(f["name"], f["type"], f["value"]) for f in c["fields"]] == [("m", "Map", None), ("n", "Map", None), ("TOP", "String", "ab /* "), ("Q", "String", '\n     text "block" // no { "" \\""" still\n     '), ("svc", "Svc", None)]
    get, none = c["methods"]
    assert (get["name"], get["return_type"], [(p["type"], p["name"]) for p in get["parameters"]]) == ("get", "List", [("Map", "p"), ("int", "xs"), ("String", "more")])
    assert get["annotations"][0]["args"] == [{"name": "value", "literal": True, "value": "/api/**"}, {"name": "value", "literal": True, "value": "/b"}, {"name": "produces", "literal": False, "value": "X.Y"}, {"name": "n", "literal": False, "value": "3"}]
    assert [(x["qualifier"], x["callee"], x["argument"]) for x in get["calls"]] == [
        (None, "f", "1"), ("svc", "h", "TOP"), ("list", "stream", None), (None, "map", "x"), ("svc", "go", "x"), (None, "filter", "Foo"), ("svc", "call", "t:x"),
        (None, "k", None), ("svc", "deep", None), (None, "foo", "1"), (None, "bar", None), ("a.b", "c", "2"),
    ]
    assert none["calls"] == [] and types["Local"]["methods"][0]["calls"][0]["callee"] == "in1"


BIG = {
    "a literal": 'class A { String s = "' + "x\\\\\\\"" * 250000 + '"; void f() { g("' + "y" * 1000000 + '"); } }',
    "an annotation": '@X("' + "z" * 1000000 + '") class A { @GetMapping({' + ",".join('"/a"' for _ in range(100000)) + "}) void f(){} }",
    "a comment": "/*" + "*" * 1000000 + "/ class A {}",
    "brackets": "class A { void f() { " + "f(" * 100000,
    "open": "{" * 300000 + "class A {}",
    "names": "class A { void f() { " + "a." * 300000 + "b(); } }",
    "types in types": "class A {" * 20000,
    "less than": "class A { int x = " + "a<" * 100000 + "; }",
    "annotations in annotations": "class A {} " + "@A(" * 100000,
    "quotes": "class A {} " + '"' * 500001,
}


@pytest.mark.parametrize("name", BIG)
def test_large_and_broken_texts_take_linear_time(name):
    start = time.time()
    try:
        assert read(BIG[name]).types
    except RecursionError:
        assert name == "annotations in annotations"
    assert time.time() - start < 8


def test_extraction_of_hard_and_large_files(spark):
    rows = [("p", f"src/{i}.java", t) for i, t in enumerate(BIG.values())] + [("p", "src/C.java", HARD), ("p", "src/Empty.java", ""), ("p", "src/Null.java", None)]
    f = java.extract(spark.createDataFrame(rows, FILES))
    assert {(r.callee_name, r.via_field) for r in f.calls.where("caller_fqn = 'a.b.C'").collect()} == {("h", "svc"), ("go", "svc"), ("call", "svc"), ("deep", "svc"), ("f", None), ("k", None), ("foo", None), ("bar", None)}
    assert {r.path for r in f.endpoints.where("signature LIKE 'a.b%'").collect()} == {"/api/**", "/b"}
    assert {r.file_path: r.error for r in f.errors.collect()} == {"src/8.java": "RecursionError", "src/Empty.java": "no type declaration", "src/Null.java": "no type declaration"}


def test_library_on_the_driver_only(tmp_path):
    """Executors get what they need, wherever the driver has it from."""
    script = tmp_path / "run.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from codeloom.sources import java
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([("p", "src/A.java", "package a; class A {{ void f() {{}} }}")], "project string, path string, content string")
print("found", [r.signature for r in java.extract(df).methods.collect()])
"""
    )
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=200, check=True)
    assert "found ['a.A.f()']" in out.stdout


SMALL = {
    "A": 'package p;\nimport q.B;\nimport r.*;\nimport static s.T.shut;\n@Tag(name = "n", list = {"x", "y"}) public class A extends Up<B> implements D {\n @Resource private B b;\n @Deprecated int n;\n String f(@Nullable B b, int k) { other.go(); shut(); b.x(); open(); return null; }\n}',
    "B": "package q;\nimport z.C;\npublic interface B { C make(C c); }",
    "D": "package p;\npublic interface D { }",
    "Old": "package p;\nimport q.B;\n@Mapper public interface OldStore { int put(int n, com.acme.domain.OrderItemDO o); }",
    "New": "package p;\nimport com.acme.mapper.domain.X;\nimport com.acme.entity.UserEntity;\n@Mapper public interface NewStore { int put(int n); }",
    "Last": "package p;\npublic interface UserLogMapper { int put(com.acme.entity.Other o); }",
    "Bare": "package p;\n@Mapper public interface Bare { }",
}


@pytest.fixture(scope="module")
def small(spark):
    return java.extract(spark.createDataFrame([("p", f"src/{n}.java", t) for n, t in SMALL.items()], FILES))


def test_wider_facts(small):
    notes = {(r.label, r.owner, r.name): r.attributes for r in wider.annotated(small).where("fqn = 'p.A'").collect()}
    assert notes == {("Type", "p.A", "Tag"): {"name": "n", "list": "x,y"}, ("Field", "p.A.b", "Resource"): {}, ("Field", "p.A.n", "Deprecated"): {}, ("Parameter", "p.A.f(B,int)#0", "Nullable"): {}}
    assert {(r.dst) for r in wider.depends_on(small).where("src = 'p.A'").collect()} == {"other", "s.T.shut", "b"}
    assert {r.fqn: r.table_name for r in wider.inferred_tables(small).collect()} == {"p.OldStore": "order_item", "p.NewStore": "user", "p.UserLogMapper": "user_log"}
    assert [(r.position, r.name, r.type_fqn) for r in wider.parameters(small).where("fqn = 'p.A'").orderBy("position").collect()] == [(0, "b", "q.B"), (1, "k", "int")]


def test_entities(small):
    e = wider.entities(small)
    edges = {(r.rel_type, r.src, r.dst) for r in e.edge.collect()}
    assert {
        ("CONTAINS", "p", "p.A"), ("EXTENDS", "p.A", "p.Up"), ("IMPLEMENTS", "p.A", "p.D"), ("DECLARES", "p.A", "p.A.n"), ("DECLARES", "p.A", "p.A.f(B,int)"), ("HAS_PARAMETER", "p.A.f(B,int)", "p.A.f(B,int)#1"),
        ("RETURNS", "p.A.f(B,int)", "java.lang.String"), ("RETURNS", "q.B.make(C)", "z.C"), ("ANNOTATED_BY", "p.A", "Tag"), ("DEPENDS_ON", "p.A", "s.T.shut"), ("MAPPER_FOR_TABLE", "p.NewStore", "user"),
    } <= edges
    keys = [(r.label, r.key) for r in e.node.collect()]
    assert len(keys) == len(set(keys)) and {("Annotation", "Mapper"), ("Package", "p"), ("Table", "user_log")} <= set(keys)


def test_a_second_scan_leaves_what_is_there(spark, small):
    first = wider.entities(java.extract(spark.createDataFrame([("p", "src/D.java", "package p;\npublic interface D { void gone(); }")], FILES)))
    both = wider.merged(first, wider.entities(small))
    keys = {(r.label, r.key) for r in both.node.collect()}
    assert ("Method", "p.D.gone()") in keys and ("Type", "p.A") in keys and both.node.where("key = 'p.D'").count() == 1 and both.node.where("label = 'Package' AND key = 'p'").count() == 1


@pytest.mark.parametrize("at_once", [0, 1 << 30])
def test_scan_closure(spark, at_once):
    scan = lambda *a: load.scan_closure(*a, at_once=at_once)
    src = {"A": "package p; import q.B; class A extends Base { @Resource B b; }", "B": "package q; class B implements I, p.A { }", "I": "package q; interface I extends Far { }", "X": "package p; class X extends A { }", "Base": "package p; class Base { @Autowired q.Gone g; }"}
    files = spark.createDataFrame([("p", f"src/{n}.java", t) for n, t in src.items()], FILES)
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "fqn string")
    got = {r.fqn: (r.depth, r.path) for r in scan(files, names("p.A")).collect()}
    assert got == {"p.A": (0, "src/A.java"), "q.B": (1, "src/B.java"), "p.Base": (1, "src/Base.java"), "q.I": (2, "src/I.java"), "q.Gone": (2, None), "q.Far": (3, None)}
    again = {r.fqn for r in scan(files, names("p.X", "p.A"), names("p.A", "p.Base")).collect()}
    assert again == {"p.X"}  # what it names is scanned already
    assert scan(files, names()).collect() == []


def test_rabbit_has_an_edge_of_its_own_if_asked(spark):
    rows = [("p", "src/M.java", 'package a; class M { @Resource R r; @RabbitListener(queues = "q") void f() { } }')]
    f, projects = java.extract(spark.createDataFrame(rows, FILES)), spark.createDataFrame([("p", "/p")], "name string, path string")
    kinds = lambda **kw: {r.rel_type for r in load.load(f, projects, **kw).edge.where("rel_type LIKE 'MQ%CONSUMER'").collect()}
    assert kinds() == {"MQ_ROCKET_CONSUMER"} and kinds(rabbit_as_rocket=False) == {"MQ_RABBIT_CONSUMER"}
