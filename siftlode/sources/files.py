"""File listings and contents as DataFrames; ignore files; git differences."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions import paths, text
from siftlode.runtime import local_path


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None, listed: list[str] | None = None) -> DataFrame:
    """(path, ext, language, content) of the readable files under a folder, read by Spark's file source.

    Paths are relative. Ignore patterns, dot parts and the extension list are also put on the file's metadata, so that
    a file they leave out is dropped from the listing and its bytes are never read. ``listed`` names the files instead
    (see ``git_files``); ignore patterns do not apply to them. Any file system Spark reads will do.
    """
    base = root.rstrip("/") + "/"
    if listed is not None and not listed:
        return spark.createDataFrame([], "path string, ext string, language string, content string")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = reader.load(root if listed is None else [base + p for p in listed])
    clean = base.split(":", 1)[1].replace("//", "/") if ":" in base.split("/")[0] else base
    prefix = f"^(?:[a-z0-9]+:/*)?/?{_quoted(clean.strip('/'))}/"
    kinds = paths.extension_list(list(extensions or text.DEFAULT_EXTENSIONS))

    def wanted(path):
        ok = text.extension(path).isin(*kinds)
        return ok if listed is not None else ok & ~paths.ignored(path, ignore or [])

    raw = raw.where(wanted(F.regexp_replace(F.col("_metadata.file_path"), prefix, "")))
    rows = raw.select(F.regexp_replace(F.col("path"), prefix, "").alias("path"), "content").where(wanted(F.col("path")))
    ext = text.extension(F.col("path"))
    return rows.select("path", ext.alias("ext"), text.language(ext).alias("language"), F.decode("content", "UTF-8").alias("content"))


def git_files(root: str, extensions: list[str] | None = None) -> list[str] | None:
    """Relative paths of the tracked and the new, not ignored files of a repository that exist; None without one."""
    names = git(root, "ls-files", "--cached", "--others", "--exclude-standard")
    if names is None:
        return None
    ends = tuple(extensions) if extensions else None
    return [n for n in dict.fromkeys(names) if (ends is None or n.lower().endswith(ends)) and os.path.isfile(os.path.join(local_path(root), n))]


def code_files(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """``scan`` of the files git lists, which need no ignore patterns, else of the folder."""
    kinds = paths.extension_list(list(extensions or text.DEFAULT_EXTENSIONS))
    return scan(spark, root, extensions, ignore, git_files(root, kinds))


def graph_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, language, content) of what a graph is made of: source files, Dockerfiles and manifests.

    Files git lists, else all outside the folders no graph scan enters.
    """
    source = [e for e in text.GRAPH_LANGUAGES if e not in (".yaml", ".yml")]
    listed = git_files(root)
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    base = root.rstrip("/") + "/"
    if listed == []:
        return scan(spark, root, source, listed=[])
    raw = every.load(root if listed is None else [base + p for p in listed])
    clean = base.split(":", 1)[1].replace("//", "/") if ":" in base.split("/")[0] else base
    rel = lambda c: F.regexp_replace(F.col(c), f"^(?:[a-z0-9]+:/*)?/?{_quoted(clean.strip('/'))}/", "")
    wanted = lambda p: (text.extension(p).isin(*source) | is_infrastructure(p)) & (F.lit(listed is not None) | ~paths.in_ignored_folder(p))
    rows = raw.where(wanted(rel("_metadata.file_path"))).select(rel("path").alias("path"), "content").where(wanted(F.col("path")))
    ext = text.extension(F.col("path"))
    return rows.select("path", ext.alias("ext"), text.language(ext).alias("language"), F.decode("content", "UTF-8").alias("content"))


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in s)


def file_states(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, hash) of file contents."""
    return files.select(F.col(path_col).alias("path"), F.sha2(F.col(content_col), 256).alias("hash"))


def is_infrastructure(path: Column) -> Column:
    """Dockerfiles, and yaml files in folders named after deployments."""
    folders = r"(?:k8s|kubernetes|deploy|deployment|infra|manifests|helm|charts)"
    return text.is_dockerfile(path) | F.lower(path).rlike(rf"(?:^|/)[^/]*{folders}[^/]*/.*\.ya?ml$")


def ignore_patterns(root: str, home_file: str | None = None) -> list[str]:
    """The patterns of the ignore files in a folder, then of one for all projects, in order, without comments and blanks."""
    folder = local_path(root)
    names = [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.startswith(".") and n.endswith("ignore")] if os.path.isdir(folder) else []
    found: list[str] = []
    for name in [*names, *([home_file] if home_file else [])]:
        if os.path.isfile(name):
            with open(name, encoding="utf-8") as f:  # Spark's readers pass over dot files
                lines = [line.strip() for line in f]
            found += [line for line in lines if line and not line.startswith("#")]
    return list(dict.fromkeys(found))


def git(root: str, *args: str, timeout: int = 10) -> list[str] | None:
    """Lines that git prints in a folder, None if it fails."""
    try:
        done = subprocess.run(["git", "-C", local_path(root), *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.splitlines() if done.returncode == 0 else None


def changed_files(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """(file_path) of the files changed since ``base``, the default branch if it is not given, else since HEAD."""
    names = None
    for b in [base] if base else ["origin/HEAD", "main", "master", "develop"]:
        names = git(root, "diff", "--name-only", f"{b}...HEAD")
        if names is not None:
            break
    if names is None:
        names = git(root, "diff", "--name-only", "HEAD") or []
    return spark.createDataFrame([(n,) for n in names if n], "file_path string")


def changed_by_extension(root: str, extensions: list[str]) -> list[str]:
    """Relative paths of the existing files with these extensions that differ from HEAD."""
    names = git(root, "diff", "--name-only", "HEAD") or []
    return [n for n in names if n and n.endswith(tuple(extensions)) and os.path.isfile(os.path.join(local_path(root), n))]


def repository_identity(root: str) -> str:
    """remote:branch of a folder's repository, else its absolute path."""
    url, branch = git(root, "remote", "get-url", "origin"), git(root, "rev-parse", "--abbrev-ref", "HEAD")
    return f"{url[0]}:{branch[0]}" if url and branch else os.path.abspath(local_path(root))
