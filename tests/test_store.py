"""The durable graph store, incremental merges, git as a data source, options in layers."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.functions.options import from_environment, layered
from codeloom.sources import files, java, load
from codeloom.sources.durable import Conflict, GraphStore
from codeloom.sources.git import register
from codeloom.sources.store import bucketed
from codeloom.streaming.ingest import current, ingest_git, merge_batch

FILES = "project string, path string, content string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "g")
    a, b = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, n int"), spark.createDataFrame([("e", "x")], "src string, dst string")
    store = GraphStore(spark, path, parts=4)
    assert store.version == 0 and store.tables == []
    store.commit({"node": (a, "k"), "edge": (b, "src")}, {"node": ("n",)})
    held = GraphStore(spark, path)
    store.commit({"node": (a.limit(0), "k")})
    assert held.version == 1 and held.read("node").count() == 3  # a reader keeps its version
    again = GraphStore(spark, path)
    assert again.version == 2 and again.read("node").count() == 0 and rows(again.read("edge")) == [("e", "x")]
    assert GraphStore(spark, path, version=1).seek("node", "k", "y").collect() == [("y", 2)] and held.seek("node", "n", 1).collect() == [("x", 1)]
    with pytest.raises(Conflict):
        held.commit({"node": (a, "k")})
    assert GraphStore(spark, path).version == 2


def test_a_load_that_dies_leaves_the_old_graph(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    facts = lambda name: java.extract(spark.createDataFrame([("p", f"src/{name}.java", f"package a; @DubboService class {name} {{ @Resource Q q; void f() {{ q.x(); }} }}")], FILES))
    projects = spark.createDataFrame([("p", "/p")], "name string, path string")
    load.save(GraphStore(spark, path), load.load(facts("Old"), projects))
    store, real, seen = GraphStore(spark, path), GraphStore._write, []

    def dies(self, name, *args):
        seen.append(name)
        if len(seen) == 3:
            raise RuntimeError("killed")
        return real(self, name, *args)

    with monkeypatch.context() as m:
        m.setattr(GraphStore, "_write", dies)
        with pytest.raises(RuntimeError):
            load.save(store, load.load(facts("New"), projects))
    after = load.stored(GraphStore(spark, path))
    assert [r.name for r in after.type.where("file_path IS NOT NULL").collect()] == ["Old"] and after.edge.where("src LIKE 'a.New%'").isEmpty()
    assert GraphStore(spark, path).expire(1) > 0  # what the dead load left
    load.save_project(GraphStore(spark, path), load.load(facts("New"), projects))
    both = load.stored(GraphStore(spark, path))
    assert {r.name for r in both.type.where("file_path IS NOT NULL").collect()} == {"Old", "New"} and both.project.count() == 1
    assert {r.src for r in both.edge.where("rel_type = 'CALLS'").collect()} == {"a.Old.f()", "a.New.f()"}


def test_a_second_project_resolves_stubs(spark, tmp_path):
    path = str(tmp_path / "g")
    one = java.extract(spark.createDataFrame([("p", "src/A.java", "package a; class A { @Reference b.B b; void f() { b.go(); } }")], FILES))
    two = java.extract(spark.createDataFrame([("q", "src/B.java", "package b; @DubboService public class B { public void go() { } }")], FILES))
    project = lambda n: spark.createDataFrame([(n, f"/{n}")], "name string, path string")
    load.save(GraphStore(spark, path), load.load(one, project("p")))
    assert load.stored(GraphStore(spark, path)).type.where("fqn = 'b.B'").first().is_external
    load.save_project(GraphStore(spark, path), load.load(two, project("q")))
    load.save_project(GraphStore(spark, path), load.load(one, project("p")))  # the stub does not come back
    got = load.stored(GraphStore(spark, path))
    assert [(r.kind, r.is_external) for r in got.type.where("fqn = 'b.B'").collect()] == [("CLASS", None)] and {r.name for r in got.project.collect()} == {"p", "q"}


def _read(df):
    """(files, row groups' rows) that a scan of a collected query read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), {}
    todo = [plan]
    while todo:
        x = todo.pop()
        if "FileScan" in x.simpleString(25) or x.nodeName().startswith("Scan "):
            for m in ("numFiles", "numOutputRows"):
                out[m] = x.metrics().apply(m).value()
        kids = x.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_a_lookup_reads_one_row_group_of_many(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("fqn"), F.sha2(F.col("id").cast("string"), 512).alias("signature"), F.col("id"))
    store = GraphStore(spark, str(tmp_path / "g"), parts=4)
    store.commit({"type": (df, "fqn")}, {"type": ("signature",)})
    key, other = df.where("id = 777").first()[:2]
    by_key = _read(store.seek("type", "fqn", key))
    assert by_key["numFiles"] == 1 and 0 < by_key["numOutputRows"] < n / 20
    by_other = _read(store.seek("type", "signature", other))
    assert by_other["numOutputRows"] < n / 4  # row groups whose Bloom filter knows it
    assert store.seek("type", "signature", other).first().id == 777 and _read(store.seek("type", "fqn", "nothing"))["numOutputRows"] < n / 20


def test_a_batch_of_one_file_writes_one_part(spark, tmp_path):
    path = str(tmp_path / "s")
    batch = lambda *files: spark.createDataFrame([("p", f"src/{n}.java", t) for n, t in files], FILES).withColumn("modified_time", F.current_timestamp())
    text = lambda n, m: f"package a; class {n} {{ void {m}() {{ }} }}"
    merge_batch(batch(*((f"C{i}", text(f"C{i}", "old")) for i in range(40))), 0, path)
    before = GraphStore(spark, path)
    merge_batch(batch(("C7", text("C7", "fresh"))), 1, path)
    after = GraphStore(spark, path)
    for t in ("types", "methods"):
        a, b = before.manifest["tables"][t]["parts"], after.manifest["tables"][t]["parts"]
        assert len(a) > 5 and sum(a.get(k) != b.get(k) for k in {*a, *b}) == 1
    assert {r.name for r in current(spark, f"{path}/methods").where("class_fqn = 'a.C7'").collect()} == {"fresh"} and current(spark, f"{path}/methods").count() == 40
    merge_batch(batch(("C7", text("C7", "twice"))), 1, path)  # the same batch again
    assert GraphStore(spark, path).version == after.version
    merge_batch(batch(("C7", None)), 2, path)  # the file went
    assert current(spark, f"{path}/types").count() == 39
    for i in range(3, 7):
        merge_batch(batch(("C1", text("C1", f"m{i}"))), i, path)
    left = GraphStore(spark, path)
    assert len(left.versions()) == 3 and left.read("types").count() == 39


def test_buckets_have_one_file_each(spark):
    df = spark.range(0, 4000, 1, 40).selectExpr("id % 500 AS src", "id AS dst", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS kind")
    t = bucketed(df, "src", "kind")
    files = [r[0] for r in t.select(F.input_file_name()).distinct().collect()]
    assert len(files) <= 16 and t.count() == 4000
    plan = t.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.fixture()
def repo(tmp_path):
    where = tmp_path / "demo"
    (where / "src").mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(where), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", "-b", "main", str(where)], check=True)
    for n in "ABC":
        (where / f"src/{n}.java").write_text(f"package a; class {n} {{ void f() {{ }} }}")
    (where / "x.txt").write_text("text")
    git("add", ".")
    git("commit", "-qm", "one")
    return where, git


def test_git_as_a_source(spark, repo):
    where, _ = repo
    register(spark)
    df = spark.read.format("git").option("repo", str(where)).option("blobs", 2).load()
    assert {r.path for r in df.collect()} == {"src/A.java", "src/B.java", "src/C.java", "x.txt"} and df.rdd.getNumPartitions() == 2
    some = df.where(F.col("path").endswith(".java") & (F.col("size") > 0)).select("path", "content")
    assert {r.path: r.content for r in some.collect()}["src/B.java"].startswith("package a; class B") and some.rdd.getNumPartitions() == 2
    assert df.where("path = 'x.txt'").first().content == "text" and df.where("path = 'x.txt'").rdd.getNumPartitions() == 1


def test_commits_as_a_stream(spark, repo, tmp_path):
    where, git = repo
    store, ck = str(tmp_path / "store"), str(tmp_path / "ck")
    run = lambda: ingest_git(spark, str(where), "demo", store, ck).awaitTermination(120)
    assert run()
    assert {r.name for r in current(spark, f"{store}/types").collect()} == {"A", "B", "C"}
    (where / "src/B.java").write_text("package a; class B { void g() { } }")
    git("rm", "-q", "src/C.java")
    git("commit", "-qam", "two")
    assert run()
    assert {(r.class_fqn, r.name) for r in current(spark, f"{store}/methods").collect()} == {("a.A", "f"), ("a.B", "g")}
    version = GraphStore(spark, store).version
    assert run() and GraphStore(spark, store).version == version  # no commit, no batch


def test_repositories_are_cloned_and_deleted(repo, tmp_path):
    where, git = repo
    base = tmp_path / "clones"
    base.mkdir()
    to = files.clone_repository(str(where), str(base), "main")
    assert to == str(base / "demo") and (base / "demo/src/A.java").exists()
    (where / "src/D.java").write_text("class D {}")
    git("add", ".")
    git("commit", "-qm", "more")
    assert files.clone_repository(f"{where}/", str(base)) == to and (base / "demo/src/D.java").exists()
    (base / "linked").symlink_to(where)
    (base / "plain").mkdir()
    for bad in ("..", "../demo", "", ".", "linked", "demo/src"):
        with pytest.raises(ValueError, match="repository"):
            files.delete_repository(bad, str(base))
    assert not files.delete_repository("plain", str(base)) and files.delete_repository("demo", str(base)) and not (base / "demo").exists() and (where / ".git").exists()


def test_options_in_layers():
    defaults = {"scan": {"exclude": ["target"], "depth": 10, "deep": {"a": 1, "b": 2}}, "name": "x"}
    file = {"scan": {"exclude": ["build"], "deep": {"b": 3}}, "list": [1, 2]}
    env = from_environment({"APP_SCAN__DEPTH": "4", "APP_LIST": "3,4", "OTHER": "no"}, "APP")
    got = layered(defaults, file, None, env, {"name": None, "scan": {"deep": {"c": {"d": 5}}}})
    assert got["scan"]["exclude"] == ("build",) and got["scan"]["depth"] == "4" and dict(got["scan"]["deep"]) == {"a": 1, "b": 3, "c": got["scan"]["deep"]["c"]} and got["list"] == ("3", "4") and got["name"] is None
    with pytest.raises(TypeError):
        got["scan"]["depth"] = 1
    assert defaults["scan"]["deep"] == {"a": 1, "b": 2}  # layers stay as they are
