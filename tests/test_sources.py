"""Files, git, merges and Java facts on small inputs."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.functions import rules
from codeloom.sources import files, java, load, merge

JAVA = {
    "shop-service/src/main/java/com/acme/web/OrderController.java": """package com.acme.web;
import com.acme.api.OrderService;
import org.springframework.beans.factory.annotation.Autowired;
/* a comment with class Fake { */
@RestController
public class OrderController {
    @Autowired
    private OrderService orderService;
    @PostMapping(path = {"/a", "/b"})
    public String create(String id, int n) {
        this.check(id);
        list.stream();
        return orderService.place(id);
    }
    @GetMapping("/c")
    public String show(String id) { return orderService.find(id, 1); } // orderService.gone(id)
    private void check(String id) { }
}""",
    "shop-api/src/main/java/com/acme/api/OrderService.java": "package com.acme.api;\npublic interface OrderService {\n    String place(String id);\n    String find(String id, int n);\n    String find(Long id);\n}",
    "shop-service/src/main/java/com/acme/impl/OrderServiceImpl.java": """package com.acme.impl;
import com.acme.api.OrderService;
import com.acme.dao.ChatroomNobleMapper;
import com.pay.PayApi;
@DubboService
public class OrderServiceImpl implements OrderService {
    @Resource
    private ChatroomNobleMapper mapper;
    @DubboReference(check = false)
    private PayApi pay;
    public String place(String id) { mapper.insert(id); return pay.charge(id); }
    public String find(String id, int n) { return mapper.select(id); }
}""",
    "shop-service/src/main/java/com/acme/dao/ChatroomNobleMapper.java": "package com.acme.dao;\n@Mapper\npublic interface ChatroomNobleMapper {\n    int insert(String id);\n    String select(String id);\n}",
    "shop-service/src/main/java/com/acme/job/JobTask.java": """package com.acme.job;
@AriesCronJobListener
public class JobTask {
    @Scheduled("0 * * * *")
    public void run() { }
    @Scheduled(cron = "1 * * * *")
    public void other() { }
}""",
    "shop-service/src/main/java/com/acme/mq/Mq.java": """package com.acme.mq;
public class Mq {
    private static final String TOPIC_X = "x-topic";
    @Resource
    private KafkaTemplate kafkaTemplate;
    @Resource
    private RocketMQTemplate rocketMQTemplate;
    @KafkaListener(topics = "one", groupId = "g")
    public void a(String s) { kafkaTemplate.send(TOPIC_X, s); }
    @KafkaListener(topics = TOPIC_X)
    public void b(String s) { rocketMQTemplate.send("t:tag", s); }
}""",
    "shop-service/src/main/java/com/acme/PlainDto.java": "package com.acme;\npublic class PlainDto { private int x; }",
    "shop-service/src/main/java/com/acme/Color.java": "package com.acme;\npublic enum Color { RED }",
    "shop-service/src/main/java/com/acme/Broken.java": "package com.acme;\npublic clas Broken {",
    "shop-service/src/test/java/com/acme/OrderTest.java": "package com.acme;\npublic class OrderTest { }",
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(p.split("/")[0], p, t) for p, t in JAVA.items()]
    return java.extract(spark.createDataFrame(rows, "project string, path string, content string"))


def test_types(facts):
    got = {r.name: r for r in facts.types.collect()}
    assert {n: (r.kind, r.arch_layer) for n, r in got.items()} == {
        "OrderController": ("CLASS", "Controller"), "OrderService": ("INTERFACE", "Other"), "OrderServiceImpl": ("CLASS", "Other"),
        "ChatroomNobleMapper": ("MAPPER", "Mapper"), "JobTask": ("ARIES_JOB", "Other"), "Mq": ("CLASS", "Other"), "PlainDto": ("CLASS", "Other"),
    }
    assert got["OrderServiceImpl"].implements == ["com.acme.api.OrderService"] and got["OrderServiceImpl"].is_dubbo_service
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in facts.errors.collect()) == ["Broken.java", "Color.java"]
    assert [r.table_name for r in facts.tables.collect()] == ["chatroom_noble"]
    assert {r.name for r in java.business_types(facts).collect()} == {"OrderController", "OrderService", "OrderServiceImpl", "ChatroomNobleMapper", "Mq"}


def test_members(facts):
    sig = {r.signature for r in facts.methods.collect()}
    assert {"com.acme.web.OrderController.create(String,int)", "com.acme.web.OrderController.check(String)", "com.acme.api.OrderService.find(Long)", "com.acme.dao.ChatroomNobleMapper.insert(String)"} <= sig
    assert {(r.name, r.type_fqn, r.injection_type) for r in facts.fields.collect() if r.class_fqn.endswith("Impl")} == {("mapper", "com.acme.dao.ChatroomNobleMapper", "Resource"), ("pay", "com.pay.PayApi", "Reference")}
    assert sorted((r.path, r.http_method) for r in facts.endpoints.collect()) == [("/a", "POST"), ("/b", "POST"), ("/c", "GET")]
    assert sorted((r.job_fqn.rsplit(".", 1)[1], r.cron_expr or "") for r in facts.jobs.collect()) == [("other", ""), ("run", "0 * * * *")]
    assert sorted((r.topic, r.mq_type, r.group or "") for r in facts.listeners.collect()) == [("one", "kafka", "g"), ("x-topic", "kafka", "")]
    assert sorted((r.topic, r.mq_type) for r in facts.sends.collect()) == [("t", "rocket"), ("x-topic", "kafka")]


NESTED = """package com.acme.deep;
import com.acme.api.*;
import static java.util.Map.Entry;
import com.other.Base;
@Service("x{;")
public class Outer extends Base implements Api, java.io.Serializable {
    int[] sizes = {1, 2};
    @Resource
    private Helper one, two = null;
    static { boot(); }
    public Outer(int n) { one.made(); }
    public void run() { one.go("} two.no("); /* two.no() */ this.own(); count(); orElse(1); other.far(); new Thing(); new Runnable() { public void inner() { two.deep(); } }; }
    private void own() throws E { char c = '}'; if (x) { two.end(); } }
    static class Inner { @Autowired private Helper in; void last() { in.stop(); } interface Deep { void d(); } enum Kind { A; void k() {} } }
    public int after() { return 1; }
}
class Second { void s() { } }
@interface Note { }
"""


def test_nested_types_declarators_and_calls(spark):
    rows = [("p", "core/src/main/java/com/acme/deep/Outer.java", NESTED), ("p", "src/main/java/Plain.java", "import a.b.*;\nclass Plain { @Autowired Q q; }")]
    f = java.extract(spark.createDataFrame(rows, "project string, path string, content string"))
    assert {(r.fqn, r.module) for r in f.types.collect()} == {("com.acme.deep.Outer", "core"), ("com.acme.deep.Inner", "core"), ("com.acme.deep.Deep", "core"), ("com.acme.deep.Second", "core"), ("Plain", "p")}
    assert {(r.class_fqn, r.name, r.type_fqn) for r in f.fields.collect()} == {("com.acme.deep.Outer", "one", "com.acme.deep.Helper"), ("com.acme.deep.Outer", "two", "com.acme.deep.Helper"), ("com.acme.deep.Inner", "in", "com.acme.deep.Helper"), ("Plain", "q", "a.b.Q")}
    assert {r.signature for r in f.methods.collect()} == {"com.acme.deep.Outer.run()", "com.acme.deep.Outer.own()", "com.acme.deep.Outer.after()", "com.acme.deep.Inner.last()", "com.acme.deep.Deep.d()", "com.acme.deep.Second.s()"}
    got = {(r.caller.split(".", 3)[3], r.callee_name, r.via_field) for r in f.calls.collect()}
    assert got == {("Outer.run()", "go", "one"), ("Outer.run()", "own", None), ("Outer.run()", "deep", "two"), ("Outer.own()", "end", "two"), ("Inner.last()", "stop", "in")}
    t = f.types.where("name = 'Outer'").first()
    assert (t.extends, t.implements) == (["com.other.Base"], ["com.acme.deep.Api", "java.io.Serializable"])


@pytest.fixture(scope="module")
def loaded(spark, facts):
    return load.load(facts, spark.createDataFrame([(n, f"/repos/{n}") for n in ("shop-service", "shop-api")], "name string, path string"), packages=True)


def test_load_makes_every_kind_of_edge(loaded):
    short = lambda s: ".".join(s.split("(")[0].split(".")[-2:])
    got = {(r.rel_type, short(r.src), short(r.dst)) for r in loaded.edge.collect()}
    assert {
        ("CONTAINS", "shop-api", "api.OrderService"), ("CONTAINS", "acme.dao", "dao.ChatroomNobleMapper"), ("DECLARES", "api.OrderService", "OrderService.find"), ("HAS_FIELD", "impl.OrderServiceImpl", "OrderServiceImpl.pay"),
        ("MAPPER_FOR_TABLE", "dao.ChatroomNobleMapper", "chatroom_noble"), ("EXPOSES", "OrderController.show", "/c#show"), ("MQ_KAFKA_CONSUMER", "mq.Mq", "kafka:one"), ("MQ_CONSUMES_METHOD", "kafka:one", "Mq.a"),
        ("MQ_KAFKA_PRODUCER", "Mq.a", "kafka:x-topic"), ("MQ_ROCKET_PRODUCER", "Mq.b", "rocket:t"), ("DUBBO_PROVIDES", "impl.OrderServiceImpl", "api.OrderService"), ("IMPLEMENTS", "impl.OrderServiceImpl", "api.OrderService"),
        ("DUBBO_CALLS", "OrderServiceImpl.place", "PayApi.charge"), ("DECLARES", "pay.PayApi", "PayApi.charge"), ("DB_CALL", "OrderServiceImpl.find", "ChatroomNobleMapper.select"), ("CALLS", "OrderController.create", "OrderController.check"),
    } <= got
    assert not any("PlainDto" in x or "JobTask" in x for e in got for x in e)  # no business types
    assert {(r.name, r.mq_type, r.group) for r in loaded.topic.collect()} == {("one", "kafka", "g"), ("x-topic", "kafka", None), ("t", "rocket", None)}
    assert [(r.fqn, r.kind) for r in loaded.type.where("is_external").collect()] == [("com.pay.PayApi", "INTERFACE")]
    assert {(r.id, r.service_name) for r in loaded.endpoint.where("path = '/c'").collect()} == {("/c#show(String)", "com.acme.web.OrderController")}


def test_stubs_of_parents_and_interfaces(spark):
    rows = [("p", "src/A.java", "package a;\n@DubboService public class A extends B implements C, D { }"), ("p", "src/C.java", "package a;\n@DubboService public class C extends D { }")]
    x = load.load(java.extract(spark.createDataFrame(rows, "project string, path string, content string")), spark.createDataFrame([("p", "/p")], "name string, path string"))
    assert {(r.fqn, r.kind, r.is_external) for r in x.type.collect()} == {("a.A", "CLASS", None), ("a.C", "CLASS", None), ("a.B", "CLASS", None), ("a.D", "CLASS", None)}
    assert {(r.src, r.rel_type, r.dst, r.dst_label) for r in x.edge.where("rel_type IN ('EXTENDS', 'IMPLEMENTS')").collect()} == {("a.A", "EXTENDS", "a.B", "CLASS"), ("a.C", "EXTENDS", "a.D", "CLASS"), ("a.A", "IMPLEMENTS", "a.C", "CLASS"), ("a.A", "IMPLEMENTS", "a.D", "CLASS")}


def test_scan_report(loaded):
    import json

    r = {x.project: x for x in load.scan_report(loaded).collect()}
    assert (r["shop-api"].total_classes, r["shop-api"].total_methods) == (1, 3)
    module = json.loads(r["shop-service"].report)["shop-service"]
    assert module["total_classes"] == r["shop-service"].total_classes and module["total_packages"] == 4
    dao = json.loads(module["packages"])["com.acme.dao"][0]
    assert (dao["name"], dao["method_count"], dao["is_mapper"]) == ("ChatroomNobleMapper", 2, True)


def test_incremental_scans(spark, facts):
    rows = [(p.split("/")[0], p, t) for p, t in JAVA.items()]
    src = spark.createDataFrame(rows, "project string, path string, content string")
    want = spark.createDataFrame([("com.acme.api.OrderService",), ("com.acme.Color",), ("com.acme.Gone",)], "fqn string")
    found, missing = load.requested(src, want)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["Color.java", "OrderService.java"] and [r.fqn for r in missing.collect()] == ["com.acme.Gone"]
    assert [r.fqn for r in load.implementers(src, "OrderService").collect()] == ["com.acme.impl.OrderServiceImpl"]
    assert load.pending(facts.types, want).collect() == []
    one = facts.types.where("name = 'OrderServiceImpl'")
    assert [r.fqn for r in load.pending(one, want.limit(0)).collect()] == ["com.acme.api.OrderService"] and load.pending(one, want).collect() == []
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [r.name for r in load.to_scan(names("a", "b"), names("a")).collect()] == ["b"] and load.to_scan(names("a", "b"), names("a"), force=True).count() == 2


def test_calls_are_not_moved_to_meet_fields(spark):
    """A class's fields travel with its methods: of many calls none is shuffled."""
    body = " ".join(f"a.m{i}(); this.n{i}();" for i in range(400))
    files = spark.createDataFrame([(f"src/C{k}.java", f"package p; class C{k} {{ @Resource A a; void x() {{ {body} }} }}", "one") for k in range(10)], "path string, content string, project string")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    calls = java.extract(files).calls
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = moved()
        assert calls.groupBy("via_field").count().count() == 2
        assert calls.count() == 8000
        assert moved() - before < 8000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_call_edges(facts):
    edges, stubs = java.call_edges(facts)
    short = lambda s: ".".join(s.split("(")[0].split(".")[-2:]) + ("(...)" if s.endswith("(...)") else "")
    got = {(short(r.src), short(r.dst), r.rel_type) for r in edges.collect()}
    assert got == {
        ("OrderController.create", "OrderController.check", "CALLS"), ("OrderController.create", "OrderService.place", "CALLS"), ("OrderController.show", "OrderService.find", "CALLS"),
        ("OrderServiceImpl.place", "ChatroomNobleMapper.insert", "DB_CALL"), ("OrderServiceImpl.place", "PayApi.charge(...)", "DUBBO_CALLS"), ("OrderServiceImpl.find", "ChatroomNobleMapper.select", "DB_CALL"),
    }
    assert [(r.fqn, r.kind, r.is_external) for r in stubs.collect()] == [("com.pay.PayApi", "INTERFACE", True)]
    assert edges.where(F.col("dst").contains("OrderService.find")).count() == 2  # both overloads


def test_read_files_and_git(spark, tmp_path):
    repo = tmp_path / "demo"
    (repo / "src").mkdir(parents=True)
    (repo / "target").mkdir()
    (repo / "src/A.java").write_text("class A {}\n")
    (repo / "src/b.py").write_text("x = 1\n")
    (repo / "src/c.png").write_bytes(b"\x89PNG")
    (repo / "target/D.java").write_text("class D {}")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", "-b", "main", str(repo)], check=True)
    git("add", "src")
    git("commit", "-qm", "first | with a bar")
    (repo / "src/A.java").write_text("class A { int changed; }\n")
    got = {r.path: r for r in files.read_files(spark, str(repo)).where("path NOT LIKE '.git%'").collect()}
    assert {p: r.language for p, r in got.items()} == {"src/A.java": "java", "src/b.py": "python"}
    assert [r.path for r in files.read_files(spark, str(repo), "*.java").collect()] == ["src/A.java"]
    committed = {r.path: r.content for r in files.git_files(spark, str(repo), pattern="*.java").collect()}
    assert committed == {"src/A.java": "class A {}\n"}
    info = files.git_info(spark, str(repo)).first()
    assert info.subject == "first | with a bar" and len(info.version) == 8 and (info.name, info.branch) == ("demo", "main")
    git("remote", "add", "origin", "git@host.org:team/digit.git")
    assert [(r.name, r.url) for r in files.git_repos(spark, str(tmp_path)).collect()] == [("digit", "git@host.org:team/digit.git")]
    git("mv", "src/b.py", "src/moved.py")
    git("commit", "-qam", "second")
    changes = lambda commit: {(r.file_path, r.change_type, r.old_path) for r in files.git_changes(spark, str(repo), commit).collect()}
    assert changes(info.commit) == {("src/A.java", "modified", None), ("src/moved.py", "renamed", "src/b.py")}
    assert changes("0" * 40) == {("src/A.java", "added", None), ("src/moved.py", "added", None), ("src/c.png", "added", None)}
    git("branch", "old", info.commit)
    assert {r.path for r in files.git_files(spark, str(repo), "old").collect()} == {"src/A.java", "src/b.py"}
    assert files.git_files(spark, str(repo)).where("modified_time IS NULL").count() == 0


def test_read_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p/src/A.java", "class A {}")
        z.writestr("p/target/B.java", "class B {}")
        z.writestr("p/x.png", b"x")
    assert [(r.path, r.content) for r in files.read_archives(spark, str(tmp_path)).collect()] == [("p/src/A.java", "class A {}")]


def test_file_filters(spark, tmp_path):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(files.name_matches(F.lit("a/MyFile.JAVA"), "*.java")) and get(files.name_matches(F.lit("a/MyFile.java"), "file.java")) and not get(files.name_matches(F.lit("a/b.javax"), "*.java"))
    assert get(files.hidden(F.lit("a/.git/x"))) and not get(files.hidden(F.lit("a/b.c/x")))
    assert get(files.kept(F.lit("src/A.java"), ("out",), ("*Test.java",), (".java",))) and not get(files.kept(F.lit("src/ATest.java"), ("out",), ("*Test.java",)))
    assert not get(files.kept(F.lit("out/A.java"), ("out",))) and not get(files.kept(F.lit("A.kt"), extensions=(".java",)))
    a = F.array(F.lit("org.x.Generated"), F.lit("Data"))
    assert not get(files.without_annotations(a, ("Generated",))) and not get(files.without_annotations(a, ("org.x.*",))) and get(files.without_annotations(a, ("Other", "Dat*x")))
    (tmp_path / "base").mkdir()
    assert files.contained(f"{tmp_path}/base/x/../y", f"{tmp_path}/base") and not files.contained(f"{tmp_path}/base-other/x", f"{tmp_path}/base") and not files.contained(f"{tmp_path}/base/../z", f"{tmp_path}/base")


def test_clear(spark, tmp_path):
    from codeloom.sources.store import clear

    spark.range(3).write.parquet(f"{tmp_path}/g/types")
    clear(spark, f"{tmp_path}/g")
    assert not (tmp_path / "g").exists()


def test_properties_versions_and_file_entities(spark):
    df = spark.createDataFrame([("k", ["a"], {"x": "y"}, [{"m": "n"}], 1)], "key string, tags array<string>, props map<string,string>, nested array<map<string,string>>, n int")
    assert merge.storable(df).columns == ["key", "tags", "n"]
    v = spark.createDataFrame([("p", "c1", 1), ("q", "c1", 1)], "project string, commit string, seq bigint")
    assert {tuple(r) for r in merge.save_version(v, "p", "c2", 2).collect()} == {("p", "c2", 2), ("q", "c1", 1)}
    t = spark.createDataFrame([("p", "A.java", "a.A"), ("p", "B.java", "a.B")], "project string, file_path string, fqn string")
    assert [r.fqn for r in merge.file_entities(t, "p", "A.java").collect()] == ["a.A"]


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "5")], "path string, hash string")
    assert {tuple(r) for r in files.diff(old, new).collect()} == {("b", "modified", None), ("e", "renamed", "c"), ("d", "deleted", None), ("f", "added", None)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None, 1), (2, "b", "x", 1)], "id int, n string, p string, seq int")
    new = spark.createDataFrame([(1, None, "y", 2), (3, "c", None, 2), (3, "d", None, 3)], "id int, n string, p string, seq int")
    assert {tuple(r) for r in merge.upsert(old, new, ["id"], "seq").collect()} == {(1, "a", "y", 2), (2, "b", "x", 1), (3, "d", None, 3)}
    assert {r.n for r in merge.insert_missing(old, new, ["id"]).where("id = 1").collect()} == {"a"}
    types = spark.createDataFrame([("x", True), ("x", False), ("y", True)], "fqn string, is_external boolean")
    assert {tuple(r) for r in merge.resolve_stubs(types).collect()} == {("x", False), ("y", True)}


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.java", "a/B.java", True), ("src/*.py", "src/a/b.py", False), ("src/**/*.py", "src/a/b.py", True), ("src/**/*.py", "src/b.py", True), ("?.txt", "ab.txt", False)])
def test_glob(spark, glob, path, hit):
    assert spark.range(1).select(files.matching(F.lit(path), glob)).first()[0] is hit


def test_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(rules.git_url(F.lit("git@host.org:team/digit.git"))) == "https://host.org/team/digit"
    assert get(rules.http_method(F.lit("PutMapping"))) == "PUT" and get(rules.http_method(F.lit("MobileAPI"))) == "POST"
    assert get(rules.is_noise(F.lit(None).cast("string"), F.lit("X"), "none")) is True
    assert get(rules.is_noise(F.lit("com.A"), F.lit("Logger"))) is True and get(rules.is_noise(F.lit("com.A"), F.lit("Logger"), "loose")) is False
    with pytest.raises(ValueError, match="odd"):
        rules.is_noise(F.lit("a"), F.lit("b"), "odd")
