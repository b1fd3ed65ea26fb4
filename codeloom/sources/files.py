"""Source files as a table, and filters on their paths; all of it in the JVM, pushed down to the file listing where it can be."""

from __future__ import annotations

import fnmatch
import shutil
import subprocess
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import glob_pattern
from .store import ship

# Languages by extension, folders and kinds of files that are left out.
LANGUAGES = {"java": "java", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "go": "go", "rs": "rust", "xml": "xml", "sql": "sql"}
PRUNED = (".git", "node_modules", "target", "build")
PRUNED_TRACKED = ("target", "build", ".git", ".idea", "node_modules", "out", "test")
PRUNED_JAVA = ("target", "build", ".git", ".idea", "node_modules", "test")
BINARY = ("jpg", "jpeg", "png", "gif", "ico", "pdf", "zip", "tar", "gz", "rar", "7z", "exe", "dll", "so", "dylib", "jar", "war", "class", "pyc")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(*(F.when(extension(path) == e, n) for e, n in LANGUAGES.items()), F.lit("unknown"))


def outside(path: Column, folders: tuple[str, ...]) -> Column:
    """Whether no part of the path is one of the folders."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def is_java_source(path: Column) -> Column:
    """Java files that are no tests and lie in no pruned folder."""
    return path.endswith(".java") & ~path.endswith("Test.java") & ~path.endswith("Tests.java") & outside(path, PRUNED_JAVA)


def matching(path: Column, pattern: str) -> Column:
    return path.rlike(glob_pattern(pattern))


def hidden(path: Column) -> Column:
    """Whether a part of the path begins with a dot."""
    return path.rlike(r"(?:^|/)\.[^/]")


def name_matches(path: Column, pattern: str) -> Column:
    """A file name's filter: * is anything, the case does not count, and the name may begin with more."""
    return F.element_at(F.split(path, "/"), -1).rlike("(?i)" + pattern.strip().replace(".", "\\.").replace("*", ".*") + "$")


def kept(path: Column, exclude_dirs: tuple[str, ...] = (), exclude_patterns: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> Column:
    """A configured filter: no part of the path is an excluded folder, its name matches no excluded pattern (* and ? as in a shell), and it has
    one of the extensions (with their dot), if any are given."""
    ok = outside(path, exclude_dirs) if exclude_dirs else F.lit(True)
    name = F.element_at(F.split(path, "/"), -1)
    for x in exclude_patterns:
        ok &= ~name.rlike(fnmatch.translate(x).replace("\\Z", "$").replace("\\z", "$"))
    if extensions:
        ok &= F.concat(F.lit("."), extension(path)).isin(*extensions)
    return ok


def without_annotations(annotations: Column, excluded: tuple[str, ...]) -> Column:
    """Whether no annotation is excluded: by its name, its last part, or a pattern with *."""
    patterns = [fnmatch.translate(x).replace("\\Z", "$").replace("\\z", "$") for x in excluded if "*" in x]
    bad = lambda a: reduce(or_, [a.rlike(p) for p in patterns], a.isin(*excluded) | F.element_at(F.split(a, "\\."), -1).isin(*excluded))
    return ~F.exists(annotations, bad)


def contained(path: str, base: str) -> bool:
    """Whether a path lies in a folder, by its real parts (links and .. resolved)."""
    return Path(path).resolve().is_relative_to(Path(base).resolve())


def read_files(spark: SparkSession, root: str, pattern: str = "*", pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """path (relative to root), content, language, encoding, size, modified_time, sha256; binary files and pruned folders are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = Path(root).resolve().as_posix() if "://" not in root else root
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^\\Q{base}\\E/", "")
    files = raw.withColumn("path", rel).where(outside(F.col("path"), pruned) & ~extension(F.col("path")).isin(*BINARY) & matching(F.col("path"), pattern))
    return files.select("path", F.decode("content", "UTF-8").alias("content"), language(F.col("path")).alias("language"), F.lit("utf-8").alias("encoding"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"), F.sha2("content", 256).alias("sha256"))


def project_info(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(Path(root).name, root, None, None)], "name string, path string, version string, language string")


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True, timeout=600).stdout


def _blobs(repo: str, ids: list[str]) -> list[bytes]:
    """The contents of blobs, by one git process."""
    done = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="\n".join(ids).encode() + b"\n", capture_output=True, timeout=600, check=True).stdout
    out, at = [], 0
    for _ in ids:
        end = done.index(b"\n", at)
        size = int(done[at:end].rsplit(b" ", 1)[1])
        out.append(done[end + 1 : end + 1 + size])
        at = end + size + 2
    return out


def clone_repository(url: str, base: str, branch: str | None = None) -> str:
    """Clones a repository into a folder of its name below base (a driver's helper: no Spark work); returns the folder. One that is there is brought up to
    date. A url that names a folder outside base by .. is refused."""
    name = url.rstrip("/").removesuffix(".git").replace(":", "/").rsplit("/", 1)[-1]
    to = Path(base) / name
    if not name or name in (".", "..") or not contained(str(to), base):
        raise ValueError(f"no repository of that name can lie in {base}")
    if (to / ".git").exists():
        _git(str(to), "pull", "--ff-only", "--quiet")
    else:
        subprocess.run(["git", "clone", "--quiet", *(["--branch", branch] if branch else []), "--", url, str(to)], check=True, capture_output=True, timeout=3600)
    return str(to)


def delete_repository(name: str, base: str) -> bool:
    """Deletes a cloned repository below base; returns whether it was there. Only a repository directly in base is deleted, never through a link."""
    to = Path(base) / name
    if to.is_symlink() or Path(name).name != name or name in ("", ".", "..") or not contained(str(to), base):
        raise ValueError(f"{name!r} names no repository in {base}")
    if not (to / ".git").exists():
        return False
    shutil.rmtree(to)
    return True


def git_files(spark: SparkSession, repo: str, rev: str = "HEAD", pattern: str = "*") -> DataFrame:
    """Committed files of a revision or branch: path, content, language, size, blob, modified_time (of the last commit that changed the tree).

    The listing is the driver's; contents are read in tasks, by one git process for each Arrow batch, so the repository must lie
    in a folder that all executors see. Nothing is checked out."""
    ship(spark)
    rows = [line.split("\t", 1) for line in _git(repo, "ls-tree", "-r", "-l", "-z", rev).split("\0") if line]
    listed = [(p, m.split()[2], int(m.split()[3])) for m, p in rows if m.split()[1] == "blob"]
    at = _git(repo, "log", "-1", "--pretty=%cI", rev).strip()
    files = spark.createDataFrame(listed, "path string, blob string, size bigint").where(outside(F.col("path"), PRUNED) & ~extension(F.col("path")).isin(*BINARY) & matching(F.col("path"), pattern))

    def load(it):
        for df in it:
            yield df.assign(content=[x.decode(errors="replace") for x in _blobs(repo, list(df["blob"]))])

    files = files.mapInPandas(load, "path string, blob string, size bigint, content string")
    return files.select("path", "content", language(F.col("path")).alias("language"), "size", "blob", F.lit(at).cast("timestamp").alias("modified_time"))


def _origin(repo: str) -> str:
    """The URL of a repository's origin, or ""."""
    return subprocess.run(["git", "-C", repo, "remote", "get-url", "origin"], capture_output=True, text=True, timeout=60, check=False).stdout.strip()


def git_info(spark: SparkSession, *repos: str) -> DataFrame:
    """A row per repository: name (of its origin, else of its folder), version (8 characters of the commit), commit, subject, author,
    committed_at, url, branch; git's fields are divided by a control character."""
    rows = []
    for repo in repos:
        sha, subject, author, at = _git(repo, "log", "-1", "--pretty=%H\x1f%s\x1f%an\x1f%aI").rstrip("\n").split("\x1f")
        url = _origin(repo)
        name = url.rstrip("/").removesuffix(".git").replace(":", "/").rsplit("/", 1)[-1] or Path(repo).resolve().name
        rows.append((name, sha[:8], sha, subject, author, at, url, _git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()))
    return spark.createDataFrame(rows, "name string, version string, commit string, subject string, author string, committed_at string, url string, branch string")


def git_repos(spark: SparkSession, folder: str) -> DataFrame:
    """git_info of every repository directly in a folder."""
    return git_info(spark, *(str(p) for p in sorted(Path(folder).iterdir()) if (p / ".git").exists()))


def git_changes(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """(file_path, change_type, old_path) since a commit; if it is not known, every file is added."""
    known = subprocess.run(["git", "-C", repo, "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True, timeout=60, check=False).returncode == 0
    tree = lambda rev: spark.createDataFrame([(p, m.split()[2]) for m, p in (x.split("\t", 1) for x in _git(repo, "ls-tree", "-r", "-z", rev).split("\0") if x)], "path string, hash string")
    new = tree("HEAD")
    return diff(tree(commit) if known else new.limit(0), new)


def read_archives(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(archive, path, content) of the text files in the zip archives of a folder; each archive is one task's work."""

    def unzip(it):
        import io
        import zipfile

        import pandas as pd

        for df in it:
            for path, data in zip(df["path"], df["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = [(path, n, z.read(n).decode(errors="replace")) for n in z.namelist() if not n.endswith("/")]
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root).select("path", "content")
    files = raw.mapInPandas(unzip, "archive string, path string, content string")
    return files.where(outside(F.col("path"), PRUNED) & ~extension(F.col("path")).isin(*BINARY) & matching(F.col("path"), pattern))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change_type, old_path) between two snapshots (path, hash): added, deleted, modified, and renamed for a
    deleted and an added file of equal hash (paired in the order of their paths)."""
    from pyspark.sql import Window

    both = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full")
    nth = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("path"))
    gone = both.where("h1 IS NULL").select(F.col("path").alias("old_path"), F.col("h0").alias("h"), nth("h0").alias("n"))
    come = both.where("h0 IS NULL").select("path", F.col("h1").alias("h"), nth("h1").alias("n"))
    pair = come.join(gone, ["h", "n"], "full")
    kind = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    moved = pair.select(F.coalesce("path", "old_path").alias("file_path"), kind.alias("change_type"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    return moved.union(both.where("h0 <> h1").select("path", F.lit("modified"), F.lit(None).cast("string")))
