"""The rendered program: what is made for a query, and how."""

from codeloom.plans import extracted
from codeloom.sources import lexer
from codeloom.sources.program import PROGRAM, relations, render


def test_relations_hold_no_pairs_of_all_types(spark, sf_dir):
    """Beside the join with the number of customers, jx_extends held every manager against every class."""
    for name, df in relations(spark, sf_dir).items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_relations_are_those_of_the_sql(spark, sf_dir):
    got = relations(spark, sf_dir)
    for name in ("jx_impl", "jx_extends", "jx_field"):
        want = spark.sql(PROGRAM[name])
        assert want.exceptAll(got[name]).isEmpty() and got[name].exceptAll(want).isEmpty(), name


def test_facts_load_no_graph(spark, sf_dir, monkeypatch):
    def never(*_, **__):
        raise AssertionError("the graph is loaded")

    monkeypatch.setattr(extracted.ld, "load", never)
    assert extracted._ext04(spark, sf_dir).count()


def test_texts_are_parsed_by_many_tasks(spark, sf_dir):
    """AQE once left the texts to as few tasks as their rows, well compressed, seemed to need."""
    assert render(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_skipped_text_at_the_end_gives_no_token():
    for text in ("class A { } // {", "class A { } /* { ", "class A { }   \n", "class A { }"):
        assert lexer.read(text).word[:4] == ["class", "A", "{", "}"] and lexer.read(text).n == 4
    assert lexer.read("/" + "*" * 200_000).n == 0


def test_a_query_on_types_makes_no_calls(spark, sf_dir, monkeypatch):
    """Every table of the graph was made, whatever a query read; calls and dependencies twice, as they were counted before they were written."""
    from codeloom.sources import graph

    made = []
    monkeypatch.setattr(graph, "written", lambda df, _old=graph.written: made.append(df.columns) or _old(df))
    g = graph.Derived(spark, sf_dir)
    assert g.type.count() and "signature" not in {c for columns in made for c in columns} and len(made) == 1
    assert g.depends_on.count() and len(made) == 4  # type, method, call, depends_on


def test_facts_write_no_texts(spark, sf_dir, monkeypatch):
    """The texts were written for any query on facts, and read back by few tasks."""
    made = []
    monkeypatch.setattr(extracted, "written", lambda df, _old=extracted.written: made.append(df.columns) or _old(df))
    for kept in (extracted._files, extracted._facts, extracted._rendered):
        monkeypatch.delitem(kept, (spark.sparkContext.applicationId, sf_dir), raising=False)
    assert extracted._ext04(spark, sf_dir).count() and not made


def _read(r):
    return r.package, r.imports, [{k: v for k, v in t.items() if k != "at"} for t in r.types], r.constants()


def test_bodies_that_repeat_are_read_once(monkeypatch):
    """Every token of every body was found and walked."""
    body = "{" + ' if (a) { x.go("}"); } // }\n String s = "v";' * 200 + " }"
    text = f"package p; class A {{ void m() {body} int n() throws E, p.F {body} A(int i) {body} }}"
    assert lexer.read(text).n < 50
    made = []
    monkeypatch.setattr(lexer._Bodies, "__missing__", lambda self, text: made.append(text))
    want = lexer.Reader(text, whole=True)
    want.file()
    assert _read(lexer.read(text)) == _read(want) and len(want.types[0]["methods"][0]["calls"]) == 200
    assert not made


def test_bodies_are_read_as_in_whole_texts():
    for text in (
        "record P(int x) { void f() { g(); } }",
        "class A { void f() { class B { void h() { k(); } } if (x) { y.z(); } } }",
        'class A { X x = new X(1) { void f() { String s = "v"; g(); } }; String t = "a" + new Y() { int k() { return 1; } }; }',
        "enum E { LOW(1) { int x() { return y(); } }; int m() { return z(1); } }",
        "class A { void f() { g( } void h() { k(); } }",
        "class A { void f() /* { */ { if (a) { b(); } } void g() throws E { c(d()); }",
        "class A { @B(x = f() { g(); }) void h() { k(); } }",
        'class A { void f() { s("}", \'}\', """ } "{" """); /* } */ t(); } }',
        "class A { < ) void f() { g(); } ( { void h() { k(); } }",
    ):
        want = lexer.Reader(text, whole=True)
        want.file()
        for _ in range(2):
            assert _read(lexer.read(text)) == _read(want), text


def test_methods_that_repeat_are_one_token(monkeypatch):
    """Only bodies were remembered: what stands before each was split into tokens and read anew."""
    one = '@A(x = {"(", ")"}) public <T> Map<T, int[]> m(@B final String s, int... n) throws E, p.F { if (a) { x.go("}"); } String c = "v"; }\n'
    text = f"package p; class A {{ void first() {{ }}\n{one * 50} }}"
    want = lexer.Reader(text, whole=True)
    want.file()
    assert _read(lexer.read(text)) == _read(want) and len(want.types[0]["methods"]) == 51
    assert lexer.read(text).n < 100
    monkeypatch.setattr(lexer._Heads, "__missing__", lambda *_: 1 / 0)
    assert _read(lexer.read(text)) == _read(want)


def test_methods_are_read_as_in_whole_texts():
    for text in (
        "class A { void a() { } static { if (x) { y(); } void f() { g(); } } void h() { k(); } }",
        "class A { void a() { } int x = 1; void h() { k(); } @B void i() { j(); } A(int i) { l(); } }",
        "class A { void a() { } X x = new X() { void f() { g(); } void h() { k(); } }; void i() { j(); } }",
        "class A { void a() { b(); class B { void f() { g(); } void h() { k(); } } c(); } void i() { j(); } }",
        "class A { void a() { } ( void f() { g(); } void h() { k(); } }",
        "class A { void a() { } } void f() { g(); } class B { void h() { k(); } }",
        "enum E { X { void f() { g(); } void h() { k(); } }; void i() { j(); } void l() { m(); } }",
        "class A { void a() { } interface I { default void f() { g(); } } record R(int x) { void h() { k(); } void i() { j(); } } }",
        'class A { void a() { } @B(String s = "v") void f() { g(); } @C(x = "class") void h() { k(); } \0 void i() { j(); } }',
    ):
        want = lexer.Reader(text, whole=True)
        want.file()
        for _ in range(2):
            assert _read(lexer.read(text)) == _read(want), text


def test_scan_closure_reads_what_it_asks_for(spark, sf_dir, monkeypatch):
    """The facts of all sources were made to find three roots, which the scan's look at the texts finds."""

    def never(*_, **__):
        raise AssertionError("facts are made")

    monkeypatch.setattr(extracted.java, "extract", never)
    monkeypatch.delitem(extracted._facts, (spark.sparkContext.applicationId, sf_dir), raising=False)
    assert extracted._chg07(spark, sf_dir).count() > 3


def test_topics_load_no_graph(spark, sf_dir, monkeypatch):
    """All tables of the graph were made and saved for its topics."""

    def never(*_, **__):
        raise AssertionError("the graph is loaded")

    monkeypatch.setattr(extracted.ld, "load", never)
    monkeypatch.delitem(extracted._loaded, (spark.sparkContext.applicationId, sf_dir), raising=False)
    alone = extracted._snk11(spark, sf_dir)
    monkeypatch.undo()
    loaded = extracted.loaded(spark, sf_dir).topic.select("name", "mq_type", "group")
    assert alone.exceptAll(loaded).isEmpty() and loaded.exceptAll(alone).isEmpty() and alone.count()


def test_edges_that_are_saved_once_are_not_written_before(spark, sf_dir, monkeypatch):
    """The edges were written to be written again, and what they are made of was taken out of the parsed rows by each table anew."""
    from codeloom.sources import load as ld

    facts, made = extracted.extracted(spark, sf_dir), []
    monkeypatch.setattr(ld, "written", lambda df, *by, _old=ld.written: made.append(df.columns) or _old(df, *by))
    one = ld.load(facts, facts.types.select("project").distinct(), once=True)
    assert not [c for c in made if "rel_type" in c and "src_label" in c] and len([c for c in made if "topic" in c]) == 2
    two = ld.load(facts, facts.types.select("project").distinct())
    edge = ld.written(one.edge)  # as a save does
    assert edge.exceptAll(two.edge).isEmpty() and two.edge.exceptAll(edge).isEmpty()
