"""Text search over files (path, content), change detection, and merges, as plans on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import git_url, glob_pattern, simple_name, table_name
from ..sources import files as fs
from ..sources import merge
from ..sources.program import program_sql
from ..sources.store import small
from .extracted import extracted, rendered
from .registry import on_graph, on_tables


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat_ws("/", "source", F.concat("lang", F.lit("/D"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id", "source", "lang")


_FILES = "f AS (SELECT source || '/' || lang || '/D' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS content, doc_id FROM documents)"


def grep(files: DataFrame, pattern: str, context: int = 1, glob: str | None = None) -> DataFrame:
    """(path, line_number from 1, line, before, after) of the lines that match, whatever their case. The lines around a match are taken from the row's own
    array, so nothing is joined or shuffled; files whose whole text does not match are dropped before they are split."""
    rows = files.where(fs.matching(F.col("path"), glob)) if glob else files
    rows = rows.where(F.col("content").rlike(f"(?im){pattern}")).select("path", F.split("content", "\n").alias("lines"))
    hit = rows.select("path", "lines", F.posexplode("lines").alias("i", "line")).where(F.col("line").rlike(f"(?i){pattern}"))
    first = F.greatest(F.col("i") - context, F.lit(0))
    before = F.concat_ws("\n", F.slice("lines", first + 1, F.col("i") - first))
    after = F.concat_ws("\n", F.slice("lines", F.col("i") + 2, F.lit(context)))
    return hit.select("path", (F.col("i") + 1).cast("long").alias("line_number"), "line", before.alias("before"), after.alias("after"))


@on_tables("txt_01_grep", f"""WITH {_FILES}, l AS (SELECT path, string_split(content, chr(10)) AS x FROM f), p AS (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM l)
SELECT path, i AS line_number, x[i] AS line, CASE WHEN i > 1 THEN x[i - 1] ELSE '' END AS before, CASE WHEN i < len(x) THEN x[i + 1] ELSE '' END AS after FROM p WHERE regexp_matches(x[i], '(?i)licen[sc]ed? under')""")
def _txt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(_docs(spark, sf_dir), "licen[sc]ed? under")


@on_tables("txt_01_grep_per_file", f"""WITH {_FILES} SELECT path, count(*) AS matches FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM f) WHERE regexp_matches(line, '(?i)password|token') GROUP BY path""")
def _txt01f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(_docs(spark, sf_dir), "password|token", 0).groupBy("path").agg(F.count("*").alias("matches"))


def search(files: DataFrame, pattern: str, project: str | None = None, file_pattern: str | None = None, max_results: int = 50, context: int = 3, whole: int = 500) -> DataFrame:
    """(project, file, total_lines, full_content, matches, truncated): the first max_results matching lines in the order of paths, by file.

    project: the first part of the path; file_pattern: see fs.name_matches; full_content only of files of at most `whole` lines;
    truncated: whether there are more matches."""
    rows = files.where(F.element_at(F.split("path", "/"), 1) == project) if project else files
    rows = rows.where(fs.name_matches(F.col("path"), file_pattern)) if file_pattern else rows
    hit = grep(rows, pattern, context).orderBy("path", "line_number").limit(max_results + 1)  # a top-k; one more tells whether it is cut
    place = F.row_number().over(Window.orderBy("path", "line_number"))  # at most max_results + 1 rows
    hit = hit.withColumn("place", place).withColumn("truncated", F.count("*").over(Window.partitionBy()) > max_results).where(F.col("place") <= max_results)
    by = hit.groupBy("path", "truncated").agg(F.sort_array(F.collect_list(F.struct("line_number", "line", "before", "after"))).alias("matches"))
    lines = F.split("content", "\n")
    by = rows.select("path", F.size(lines).cast("long").alias("total_lines"), F.when(F.size(lines) <= whole, F.col("content")).alias("full_content")).join(F.broadcast(by), "path")
    return by.select(F.element_at(F.split("path", "/"), 1).alias("project"), F.regexp_replace("path", "^[^/]*/", "").alias("file"), "total_lines", "full_content", "matches", "truncated")


@on_tables("txt_01_search", f"""WITH {_FILES}, l AS (SELECT path, content, string_split(content, chr(10)) AS x FROM f WHERE path LIKE 'src2/%' AND path LIKE '%.txt'), p AS (SELECT path, content, x, unnest(range(1, len(x) + 1)) AS i FROM l),
h AS (SELECT path, content, len(x) AS total_lines, i, row_number() OVER (ORDER BY path, i) AS n, count(*) OVER () AS c FROM p WHERE regexp_matches(x[i], '(?i)the'))
SELECT 'src2' AS project, regexp_replace(path, '^[^/]*/', '') AS file, CAST(total_lines AS BIGINT) AS total_lines, md5(CASE WHEN total_lines <= 500 THEN content END) AS content_md5, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines, c > 20 AS truncated FROM h WHERE n <= 20 GROUP BY path, content, total_lines, c""")
def _txt01s(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(_docs(spark, sf_dir), "the", "src2", "*.TXT", 20)
    number = F.array_join(F.transform("matches", lambda m: m["line_number"].cast("string")), ",")
    return out.select("project", "file", "total_lines", F.md5("full_content").alias("content_md5"), F.size("matches").cast("long").alias("n"), number.alias("lines"), "truncated")


def glob_files(files: DataFrame, pattern: str, max_lines: int = 500, max_files: int | None = None) -> DataFrame:
    """(path, total_lines, content: the first max_lines lines, truncated) of the files that match a glob and lie in no hidden folder; with
    max_files only the first ones by name."""
    lines = F.split("content", "\n")
    rows = files.where(F.col("path").rlike(glob_pattern(pattern)) & ~fs.hidden(F.col("path"))).withColumn("lines", lines)
    if max_files is not None:
        rows = rows.orderBy(F.element_at(F.split("path", "/"), -1), "path").limit(max_files)
    return rows.select("path", F.size("lines").cast("long").alias("total_lines"), F.concat_ws("\n", F.slice("lines", 1, max_lines)).alias("content"), (F.size("lines") > max_lines).alias("truncated"))


@on_tables("txt_02_glob_first_files", f"WITH {_FILES} SELECT path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS total_lines FROM f WHERE path LIKE '%.txt' ORDER BY string_split(path, '/')[-1], path LIMIT 20")
def _txt02f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 files by name."""
    return glob_files(_docs(spark, sf_dir), "**/*.txt", 3, 20).select("path", "total_lines")


@on_tables("txt_02_glob", f"""WITH {_FILES} SELECT path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS total_lines, array_to_string(list_slice(string_split(content, chr(10)), 1, 3), chr(10)) AS content, len(string_split(content, chr(10))) > 3 AS truncated
FROM f WHERE regexp_matches(path, '^src1/[^/]*/D[^/]*.txt$')""")
def _txt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glob_files(_docs(spark, sf_dir), "src1/*/D*.txt", 3)


def read_lines(files: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end (from 1, both included) of each file."""
    return files.select("path", F.concat_ws("\n", F.slice(F.split("content", "\n"), start, end - start + 1)).alias("content"))


@on_tables("txt_04_read_lines", f"WITH {_FILES} SELECT path, array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) AS content FROM f")
def _txt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(_docs(spark, sf_dir), 2, 4)


def list_files(files: DataFrame, path: str = "", file_pattern: str | None = None) -> DataFrame:
    """(name, type, size) of what lies directly in a folder, by name: directories (size 0) and files (characters); hidden ones are left out, and
    files that do not match file_pattern."""
    depth = len(path.split("/")) if path else 0
    parts = F.split("path", "/")
    rows = files.where(F.col("path").startswith(f"{path}/")) if path else files
    rows = rows.select("path", F.get(parts, F.lit(depth)).alias("name"), (F.size(parts) == depth + 1).alias("is_file"), F.length("content").alias("n")).where(~F.col("name").startswith("."))
    if file_pattern:
        rows = rows.where(~F.col("is_file") | fs.name_matches(F.col("name"), file_pattern))
    out = rows.groupBy("name", "is_file").agg(F.max("n").alias("n"))
    return out.select("name", F.when(F.col("is_file"), "file").otherwise("directory").alias("type"), F.when(F.col("is_file"), F.col("n")).otherwise(0).cast("long").alias("size")).orderBy("name")


@on_tables("txt_05_list", f"WITH {_FILES} SELECT DISTINCT string_split(path, '/')[1] AS name, 'directory' AS type, CAST(0 AS BIGINT) AS size FROM f UNION ALL SELECT string_split(path, '/')[3], 'file', length(content) FROM f WHERE path LIKE 'src1/en/%7.txt'")
def _txt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top folder, and the files of one folder whose names end in 7.txt."""
    d = _docs(spark, sf_dir)
    return list_files(d).union(list_files(d, "src1/en", "*7.TXT"))


def class_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, class_name, path): the file of each wanted class (project, class_name: full or simple), null if there is none.

    files: project, path. A file's name must be the class's; of a full name also the path below src/main/java. Of several, the first by
    extension (java, kt, py, scala), then by path."""
    ext = F.array_position(F.array(*map(F.lit, ("java", "kt", "py", "scala"))), fs.extension(F.col("path")))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    full = F.translate(F.regexp_extract("path", r"(?:^|/)src/main/java/(.+)\.[^./]+$", 1), "/", ".")
    have = files.select("project", name.alias("simple"), F.struct(ext.alias("ext"), "path").alias("at"), full.alias("full")).where("at.ext > 0")
    want = wanted.select("project", "class_name", simple_name(F.col("class_name")).alias("simple"))
    hit = want.join(have, ["project", "simple"]).where(~F.col("class_name").contains(".") | (F.col("class_name") == F.col("full")))
    return want.select("project", "class_name").join(hit.groupBy("project", "class_name").agg(F.min("at").alias("at")), ["project", "class_name"], "left").select("project", "class_name", "at.path")


@on_tables("txt_03_class_files", program_sql("SELECT project, fqn AS class_name, CASE WHEN role <> 'Inner' THEN path END AS path FROM jx_type UNION ALL SELECT project, name, CASE WHEN role <> 'Inner' THEN path END FROM jx_type WHERE id % 5 = 0"))
def _txt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all types by their full names, and of some by their simple ones; nested types have none."""
    files, facts = rendered(spark, sf_dir), extracted(spark, sf_dir)
    some = F.regexp_extract("fqn", r"T(\d+)", 1).cast("long") % 5 == 0
    return class_file(files, facts.types.select("project", F.col("fqn").alias("class_name")).union(facts.types.where(some).select("project", "name")))


@on_graph("ext_15_table_names", r"SELECT name, lower(regexp_replace(regexp_replace(regexp_replace(name, 'Mapper$', ''), '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS table_name FROM fx_type")
def _ext15(g) -> DataFrame:
    return g.type.select("name", table_name(F.col("name")).alias("table_name"))


@on_tables("src_15_url_forms", """SELECT page_id, CASE page_id % 5 WHEN 4 THEN regexp_replace(url, '/+$', '') ELSE 'https://host.org/team/r' || page_id END AS url FROM pages""")
def _src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone URLs in five forms: scp-like and ssh addresses, with .git and slashes at the end, and pages' own."""
    r = F.concat(F.lit("team/r"), F.col("page_id").cast("string"))
    forms = [F.concat(F.lit("git@host.org:"), r, F.lit(".git")), F.concat(F.lit("ssh://git@host.org/"), r, F.lit(".git")), F.concat(F.lit(" https://host.org/"), r, F.lit(".git ")), F.concat(F.lit("https://host.org/"), r, F.lit("//"))]
    url = F.coalesce(*(F.when(F.col("page_id") % 5 == i, x) for i, x in enumerate(forms)), F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", git_url(url).alias("url"))


_SOURCES = ("'src/main/java/A' || c_custkey || '.java'", "'src/test/java/A' || c_custkey || '.java'", "'mod/target/A' || c_custkey || '.java'", "'src/main/java/A' || c_custkey || 'Test.java'", "'src/main/java/A' || c_custkey || 'Tests.java'", "'src/main/res/A' || c_custkey || '.xml'", "'mod/src/main/java/testing/A' || c_custkey || '.java'")


@on_tables("src_07_source_filter", f"SELECT CASE c_custkey % 7 WHEN 0 THEN {_SOURCES[0]} ELSE {_SOURCES[6]} END AS path FROM customer WHERE c_custkey % 7 IN (0, 6)")
def _src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of paths of seven forms, those of Java sources that are no tests and lie in no pruned folder."""
    path = F.expr("CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SOURCES)) + " END")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(path.alias("path")).where(fs.is_java_source(F.col("path")))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents before and after a change: some sources are new, some gone, some moved, and German texts are edited."""
    d = _docs(spark, sf_dir)
    old = d.where("source <> 'src3'").select("path", F.md5("content").alias("hash"))
    name = F.when(F.col("source") == "src7", F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    text = F.when(F.col("lang") == "de", F.concat(F.col("content"), F.lit("!"))).otherwise(F.col("content"))
    return old, d.where("source <> 'src5'").select(name.alias("path"), F.md5(text).alias("hash"))


_SNAPSHOTS = f"""{_FILES.replace("doc_id FROM", "doc_id, source, lang FROM")}, a AS (SELECT path, md5(content) AS h FROM f WHERE source <> 'src3'),
b AS (SELECT CASE WHEN source = 'src7' THEN 'moved/' || path ELSE path END AS path, md5(CASE WHEN lang = 'de' THEN content || '!' ELSE content END) AS h FROM f WHERE source <> 'src5')"""


@on_tables("chg_02_diff_counts", f"""WITH {_SNAPSHOTS},
g AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b)), c AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a)),
r AS (SELECT CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END AS change_type FROM c FULL JOIN g ON g.h = c.h AND g.n = c.n UNION ALL SELECT 'modified' FROM a JOIN b USING (path) WHERE a.h <> b.h)
SELECT change_type, count(*) AS n FROM r GROUP BY 1""")
def _chg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.diff(*_snapshots(spark, sf_dir)).groupBy("change_type").agg(F.count("*").alias("n"))


@on_tables("chg_03_modified_files", f"WITH {_SNAPSHOTS} SELECT path AS file_path FROM a JOIN b USING (path) WHERE a.h <> b.h")
def _chg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.diff(*_snapshots(spark, sf_dir)).where("change_type = 'modified'").select("file_path")


@on_tables("chg_04_replace_files", f"WITH {_SNAPSHOTS} SELECT path AS file_path, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS version FROM f")
def _chg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumnRenamed("path", "file_path")
    changed = d.where("lang = 'de'")
    return merge.replace_files(d.select("file_path", F.lit("old").alias("version")), changed.select("file_path", F.lit("new").alias("version")), changed)


def can_build(current: F.Column, scanned: F.Column) -> F.Column:
    """Whether a repository has a commit that is not the one scanned last."""
    return (F.coalesce(current, F.lit("")) != "") & (F.coalesce(current, F.lit("")) != F.coalesce(scanned, F.lit("")))


@on_tables("chg_01_can_build", """SELECT c_custkey AS id, coalesce(now, '') <> '' AND coalesce(now, '') <> coalesce(old, '') AS can_build FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL ELSE md5(c_name) END AS now,
CASE WHEN c_custkey % 3 = 0 THEN md5(c_name) WHEN c_custkey % 5 = 0 THEN NULL ELSE md5(c_mktsegment) END AS old FROM customer)""")
def _chg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits are hashes; some repositories have none, some were never scanned, some are unchanged."""
    c, i = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    now = F.when(i % 7 == 0, "").when(i % 11 != 0, F.md5("c_name"))
    old = F.when(i % 3 == 0, F.md5("c_name")).when(i % 5 != 0, F.md5("c_mktsegment"))
    return c.select(i.alias("id"), can_build(now, old).alias("can_build"))


@on_tables("snk_01_upsert", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_name END AS c_name, c_mktsegment, CAST(CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS BIGINT) AS seq FROM customer")
def _snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch names customers in debt anew and repeats others without any value, which keeps the old ones."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.select("c_custkey", "c_name", "c_mktsegment", F.lit(1).cast("long").alias("seq"))
    new = c.where("c_acctbal < 0 OR c_mktsegment = 'BUILDING'").select("c_custkey", F.when(F.col("c_acctbal") < 0, "in debt").alias("c_name"), F.lit(2).cast("long").alias("seq"))
    return merge.upsert(old, new, ["c_custkey"], "seq")


@on_graph("snk_02_upsert_edges", "SELECT DISTINCT c.src, c.rel_type, c.dst FROM fx_call c JOIN fx_method a ON a.method_id = c.src JOIN fx_type x ON x.type_id = a.type_id JOIN fx_method b ON b.method_id = c.dst JOIN fx_type y ON y.type_id = b.type_id WHERE x.project_id IS NOT NULL AND y.project_id IS NOT NULL")
def _snk02(g) -> DataFrame:
    """Every call comes twice; those with an end outside all projects have no node there."""
    nodes = g.owned.where("project_id IS NOT NULL").select(F.col("method_id").alias("id"))
    return merge.upsert_edges(nodes, g.call.select("src", "rel_type", "dst").unionByName(g.call.select("src", "rel_type", "dst")))


@on_graph("snk_16_delete_project", "WITH k AS (SELECT m.method_id FROM fx_method m JOIN fx_type t ON t.type_id = m.type_id WHERE t.project_id = 3) SELECT (SELECT count(*) FROM fx_type WHERE project_id IS NULL OR project_id <> 3) AS types, (SELECT count(*) FROM fx_method WHERE method_id NOT IN (SELECT method_id FROM k)) AS methods, (SELECT count(*) FROM fx_call WHERE src NOT IN (SELECT method_id FROM k) AND dst NOT IN (SELECT method_id FROM k)) AS calls")
def _snk16(g) -> DataFrame:
    t, m, c = (df.agg(F.count("*").alias(n)) for n, df in zip(("types", "methods", "calls"), merge.without_project(g.type, g.method, g.call, 3), strict=True))
    return t.join(F.broadcast(m)).join(F.broadcast(c))  # one row each


@on_graph("snk_18_scan_report", "WITH c AS (SELECT p.name AS project, t.package, t.fqn, count(m.method_id) AS n FROM fx_type t JOIN fx_project p ON p.project_id = t.project_id LEFT JOIN fx_method m ON m.type_id = t.type_id GROUP BY ALL) SELECT project, package, count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_methods, string_agg(fqn || '=' || n, ',' ORDER BY fqn) AS classes FROM c GROUP BY ALL")
def _snk18(g) -> DataFrame:
    n = g.method.groupBy("type_id").agg(F.count("*").alias("k"))
    c = g.contained.join(n, "type_id", "left").select("project", "package", "fqn", F.coalesce("k", F.lit(0).cast("long")).alias("k"))
    names = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("fqn", "k"))), lambda x: F.concat_ws("=", x["fqn"], x["k"].cast("string"))))
    return c.groupBy("project", "package").agg(F.count("*").alias("n_classes"), F.sum("k").alias("n_methods"), names.alias("classes"))


@on_graph("set_03_missing", "SELECT DISTINCT fqn || 'X' AS fqn FROM fx_type WHERE type_id % 10 = 0")
def _set03(g) -> DataFrame:
    """Requested names, some of which no type has: those."""
    wanted = g.type.select(F.when(F.col("type_id") % 10 == 0, F.concat("fqn", F.lit("X"))).otherwise(F.col("fqn")).alias("fqn")).distinct()
    return wanted.join(g.type, "fqn", "left_anti")


@on_graph("jon_08_lookup_by_name_or_path", "SELECT b.id, coalesce(x.project_id, y.project_id) AS project_id FROM (SELECT type_id AS id, CASE WHEN type_id % 2 = 0 THEN upper(package) ELSE 'FRANCE' END AS name, '/repos/' || CASE WHEN type_id % 3 = 0 THEN 'china' ELSE 'peru/' END AS path FROM fx_type) b LEFT JOIN fx_project x ON x.name = b.name LEFT JOIN fx_project y ON y.path = rtrim(b.path, '/')")
def _jon08(g) -> DataFrame:
    """By name first, else by path without slashes at its end."""
    b = g.type.select(F.col("type_id").alias("id"), F.when(F.col("type_id") % 2 == 0, F.upper("package")).otherwise("FRANCE").alias("name"), F.concat(F.lit("/repos/"), F.when(F.col("type_id") % 3 == 0, "china").otherwise("peru/")).alias("path"))
    b = b.withColumn("path", F.regexp_replace("path", "/+$", ""))
    x, y = small(g.project.select("name", F.col("project_id").alias("p1"))), small(g.project.select("path", F.col("project_id").alias("p2")))
    return b.join(x, "name", "left").join(y, "path", "left").select("id", F.coalesce("p1", "p2").alias("project_id"))
