"""Path filters: globs, dot files, ignore rules and extensions."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders no graph scan enters.
IGNORED_FOLDERS = (
    "node_modules", ".git", "dist", "build", ".next", "__pycache__", ".venv", "vendor", "target", "coverage", ".nyc_output", ".cache",
    ".idea", ".vscode", ".circleci", "bin", "obj", "out", "tmp", "temp", ".tox", ".mypy_cache", ".pytest_cache", ".turbo", ".angular",
    ".nuxt", ".svn", ".hg", "bower_components", ".terraform", ".parcel-cache",
)


def glob_regex(pattern: str) -> str | None:
    """The regular expression of an ignore pattern on a relative path, None for an empty pattern.

    ``*`` crosses ``/``; a leading ``/`` anchors; a trailing ``/`` names a directory, at any depth unless anchored; a
    pattern without ``/`` is matched against the base name; any other against the whole path. ``?`` is one character.
    """
    pattern = pattern.strip()
    anchored, directory = pattern.startswith("/"), pattern.endswith("/")
    core = pattern.strip("/")
    if not core:
        return None
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in core)
    head = "^" if anchored else "(^|/)"
    if directory:
        return f"{head}{body}/"
    if "/" in core or anchored:
        return f"^{body}$"
    return f"(^|/){body.replace('.*', '[^/]*')}$"


def matches_glob(path: Column, pattern: str) -> Column:
    rx = glob_regex(pattern)
    return F.lit(False) if rx is None else path.rlike(rx)


def has_dot_part(path: Column) -> Column:
    return path.startswith(".") | path.contains("/.")


def ignored(path: Column, patterns: list[str]) -> Column:
    """A dot part or any pattern, tested on the path and, for folders, on every prefix of it (as a trailing slash does)."""
    rules = [matches_glob(path, p) for p in patterns]
    folders = [path.rlike(rx.removesuffix("$") + "/") for p in patterns if (rx := glob_regex(p)) and not p.strip().endswith("/")]
    return functools.reduce(operator.or_, rules + folders, has_dot_part(path))


def in_ignored_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_FOLDERS]))


def extension_list(extensions: list[str]) -> list[str]:
    """Extensions with their dots; an entry that is empty or holds white space is an error."""
    out = []
    for e in extensions:
        e = e.strip() if e == e.strip() else ""
        if len(e.lstrip(".")) == 0 or re.search(r"\s", e):
            raise ValueError(f"not an extension: {e!r}")
        out.append(e if e.startswith(".") else f".{e}")
    return list(dict.fromkeys(out))
