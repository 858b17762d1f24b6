"""Scalar functions on names, paths and texts, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that are indexed, and the language each stands for.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".m": "objective-c", ".mm": "objective-c", ".dart": "dart",
    ".sol": "solidity", ".md": "markdown", ".markdown": "markdown", ".ipynb": "jupyter",
}
#: The language each extension is parsed as for the graph.
GRAPH_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python",
    ".java": "java", ".cpp": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".cc": "cpp", ".go": "go", ".rs": "rust", ".cs": "csharp",
    ".yaml": "yaml", ".yml": "yaml",
}
#: The names of languages that are split at definitions, and the language whose rules apply.
SPLITTABLE = {
    "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "python": "python", "py": "python",
    "java": "java", "cpp": "cpp", "c++": "cpp", "c": "cpp", "go": "go", "rust": "rust", "rs": "rust", "cs": "csharp",
    "csharp": "csharp", "scala": "scala",
}
DEFAULT_EXTENSIONS = tuple(LANGUAGES)


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and c == c.lower()]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


MARKED, UNMARKED = _folds()


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(ext: Column) -> Column:
    return F.coalesce(lookup(LANGUAGES, F.lower(ext)), F.lit("text"))


def graph_language(path: Column) -> Column:
    """The language a file is parsed as for the graph; yaml for manifests, empty if none."""
    return F.coalesce(lookup(GRAPH_LANGUAGES, extension(path)), F.lit(""))


def splitter_language(name: Column) -> Column:
    """The language whose definitions a language of this name is split at, empty if there are no rules for it."""
    return F.coalesce(lookup(SPLITTABLE, F.lower(name)), F.lit(""))


def is_dockerfile(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^dockerfile(\..*)?$")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """A readable id; the hash of the raw path keeps paths apart that look alike once cleaned."""
    clean = F.regexp_replace(path, r"[^a-zA-Z0-9._-]", "_")
    return F.concat(F.lit("chunk_"), clean, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), F.substring(F.md5(path), 1, 8))


def collection_name(identity: Column, prefix: str = "code_chunks", override: str | None = None) -> Column:
    middle = "" if not override else "_" + "".join(c if c.isalnum() or c == "_" else "_" for c in override)
    return F.substring(F.concat(F.lit(f"{prefix}{middle}_"), F.substring(F.md5(identity), 1, 8)), 1, 255)


def folded(text: Column) -> Column:
    """Lower case, without the marks of Latin letters and without combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, UNMARKED), "[\u0300-\u036f]", "")


def tokens(text: Column) -> Column:
    """Words of letters and digits of any script, in lower case, Latin letters without marks."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def words_of(text: str) -> list[str]:
    """The tokens of a query, on the driver."""
    low = "".join(c for c in text.lower().translate(str.maketrans(MARKED, UNMARKED)) if not "\u0300" <= c <= "\u036f")
    return re.findall(r"[^\W_]+", low)


def query_terms(text: Column) -> Column:
    """Search terms: camel case and separators split, each once, in order."""
    split = F.split(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"[\s_\-.:/]+")
    return F.array_distinct(F.filter(F.transform(split, F.lower), lambda t: t != ""))


def search_words(query: str) -> list[str]:
    """The terms of ``query_terms`` as tokens, on the driver."""
    parts = re.split(r"[\s_\-.:/]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))
    return list(dict.fromkeys(w for p in parts for w in words_of(p)))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4.0).cast("long")


def simple_name(qn: Column) -> Column:
    return F.regexp_extract(qn, r"([^.:]*)$", 1)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading dotted parts two names share."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, p: F.struct((s["n"] + F.when(s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False)), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on"))
    return F.aggregate(pairs, start, step)["n"]


def is_test_name(qn: Column) -> Column:
    return F.lower(qn).rlike(r"test|mock|stub|fake|fixture|spec")


def count_penalty(base: float, n: Column) -> Column:
    return F.lit(base) * F.least(F.lit(1.0), F.lit(5.0) / n)


def module_name(project: Column, path: Column) -> Column:
    """project.dir.file without extension; index and __init__ files stand for their folder."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: ~p.isin("", "index", "__init__"))
    return F.concat_ws(".", project, F.array_join(parts, "."))


def adr_slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"(^-+|-+$)", "")


def route_parameters(template: Column) -> Column:
    return F.regexp_replace(template, r"\$\{[^}]*\}", ":param")


def embedding_text(text: Column, max_tokens: int = 8191) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(" ")).otherwise(F.substring(text, 1, 4 * max_tokens))


def truncated(text: Column, limit: int = 5000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def overlap_share(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The share of [start, end] that another line range covers."""
    shared = F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start) + 1)
    return shared / F.greatest(F.lit(1), end - start + 1)


def progress_percent(done: Column, total: Column) -> Column:
    return F.round(10 + done / total * 90)


def looks_like_identity(s: Column) -> Column:
    return s.contains("://") | s.contains("git@")
