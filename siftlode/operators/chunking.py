"""From files to chunks: definition-based, line-based and recursive splitting, overlap, filters and caps."""

from __future__ import annotations

import ast
import re
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions.text import SPLITTABLE
from siftlode.runtime import cut

#: Separators of the recursive splitter, strongest first.
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ", ""],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\n\n", "\n", " ", ""],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\n\n", "\n", " ", ""],
    "typescript": ["\nfunction ", "\nconst ", "\nlet ", "\nclass ", "\ninterface ", "\nenum ", "\n\n", "\n", " ", ""],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", "\n\n", "\n", " ", ""],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\ncase ", "\n\n", "\n", " ", ""],
    "": ["\n\n", "\n", " ", ""],
}


def split_lines(content: Column, limit: int = 2500) -> Column:
    """Array of pieces: whole lines packed greedily up to ``limit`` characters; a longer line is a piece of its own.

    A fold over the lines inside the JVM; pieces of white space only are dropped.
    """
    start = F.struct(F.slice(F.array(F.lit("")), 1, 0).alias("done"), F.lit("").alias("cur"))

    def step(s, x):
        fits = (F.length(s["cur"]) + F.length(x) + 1 <= limit) | (s["cur"] == "")
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit("\n"), x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("cur"))

    pieces = F.aggregate(F.split(content, "\n"), start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))
    return F.filter(F.transform(pieces, lambda p: F.rtrim(p)), lambda p: F.trim(p) != "")


def line_chunks(files: DataFrame, limit: int = 2500, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, seq, content) by ``split_lines``; null and blank contents give none."""
    return files.where(F.col(content_col).isNotNull()).select(F.col(path_col).alias("path"), F.posexplode(split_lines(F.col(content_col), limit)).alias("seq", "content"))


def with_overlap(chunks: DataFrame, size: int = 300, path_col: str = "path", seq_col: str = "seq", content_col: str = "content", start_col: str | None = None) -> DataFrame:
    """Each chunk with the last ``size`` characters of the one before it in its file, and a line break, in front."""
    w = Window.partitionBy(path_col).orderBy(seq_col)
    tail = F.substring(F.lag(content_col).over(w), -size, size)
    out = chunks.withColumn("__tail", tail)
    if start_col:
        lines = F.size(F.split(F.col("__tail"), "\n"))
        out = out.withColumn(start_col, F.when(F.col("__tail").isNull(), F.col(start_col)).otherwise(F.greatest(F.lit(1), F.col(start_col) - lines)))
    return out.withColumn(content_col, F.when(F.col("__tail").isNull(), F.col(content_col)).otherwise(F.concat("__tail", F.lit("\n"), content_col))).drop("__tail")


def keep_long(chunks: DataFrame, least: int = 10, content_col: str = "content") -> DataFrame:
    return chunks.where(F.length(F.trim(content_col)) > least)


def capped(chunks: DataFrame, most: int = 450_000, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, left): chunks of whole files up to ``most`` in order of path, and (path) of the files left to a later run.

    The feature of a bounded index run: a file is kept whole or left whole (the first is always kept), so what is left
    can be indexed later. Counts a path are summed in two steps, over ranges of paths and inside them, so no task holds
    them all.
    """
    counts = chunks.groupBy(path_col).agg(F.count("*").alias("n")).repartitionByRange(path_col).withColumn("part", F.spark_partition_id())
    counts = cut(counts, "counts")
    before, total = {}, 0
    for r in counts.groupBy("part").agg(F.sum("n").alias("n"), F.min(path_col).alias("first")).orderBy("first").collect():
        before[r["part"]], total = total, total + r["n"]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    upto = F.element_at(offset, F.col("part")) + F.sum("n").over(Window.partitionBy("part").orderBy(path_col))
    placed = counts.withColumn("upto", upto)
    over = (F.col("upto") > most) & (F.col("upto") > F.col("n"))
    left = placed.where(over).select(path_col)
    return chunks.join(left, path_col, "left_anti"), left


def with_chunk_index(chunks: DataFrame, path_col: str = "path", order: str = "seq") -> DataFrame:
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(path_col).orderBy(order)) - 1)


def recursive_split(text: str, size: int = 1000, overlap: int = 200, language: str = "") -> list[str]:
    """Pieces of at most ``size`` characters where separators allow, cut at the strongest separator that occurs."""
    known = SPLITTABLE.get(language, language)
    known = "typescript" if known == "javascript" else "java" if known == "csharp" else known
    return _recursive(text, SEPARATORS.get(known, SEPARATORS[""]), size, overlap)


def _recursive(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for k, p in enumerate(_kept(text, sep)) if p]
    out: list[str] = []
    good: list[str] = []
    for part in parts:
        if len(part) < size:
            good.append(part)
            continue
        out += _packed(good, size, overlap)
        good = []
        out += _recursive(part, rest, size, overlap) if rest else [part]
    return out + _packed(good, size, overlap)


def _kept(text: str, sep: str) -> list[str]:
    first, *others = text.split(sep)
    return [first, *(sep + o for o in others)]


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    out, cur, total = [], [], 0
    for part in parts:
        if cur and total + len(part) > size:
            out.append("".join(cur).strip())
            while cur and (total > overlap or total + len(part) > size):
                total -= len(cur.pop(0))
        cur.append(part)
        total += len(part)
    out.append("".join(cur).strip())
    return [p for p in out if p]


def window_split(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[str, int, int]]:
    """(content, start_line, end_line) of whole lines up to ``size`` characters, the last lines repeated as overlap."""
    lines = text.split("\n")
    average = max(1.0, len(text) / len(lines))
    out, start = [], 0
    while start < len(lines):
        end, total = start, 0
        while end < len(lines) and (end == start or total + len(lines[end]) + 1 <= size):
            total += len(lines[end]) + 1
            end += 1
        content = "\n".join(lines[start:end])
        if len(content.strip()) > 10:
            out.append((content, start + 1, end))
        if end >= len(lines):
            break
        start = max(end - min(int(overlap / average), end - start), start + 1)
    return out


class Splitter(Protocol):
    """Anything that cuts a text into (content, start_line, end_line) pieces."""

    def split(self, text: str, language: str) -> list[tuple[str, int, int]]: ...


class DefinitionSplitter:
    """At definitions where the language has rules (see ``SPLITTABLE``), else recursively."""

    def split(self, text: str, language: str) -> list[tuple[str, int, int]]:
        known = SPLITTABLE.get(language.lower())
        return definition_split(text, known) if known else RecursiveSplitter().split(text, language)


class RecursiveSplitter:
    """At the strongest separator of the language; lines are those of a piece's first occurrence after the last one."""

    def __init__(self, size: int = 1000, overlap: int = 200):
        self.size, self.overlap = size, overlap

    def split(self, text: str, language: str) -> list[tuple[str, int, int]]:
        out, at = [], 0
        for p in recursive_split(text, self.size, self.overlap, language.lower()):
            found = text.find(p, max(0, at - self.overlap - 1))
            at = (found if found >= 0 else at) + len(p)
            out.append((p, *estimated_lines(text, p, max(found, 0))))
        return out


class WindowSplitter:
    """Whole lines up to a size, the last ones repeated."""

    def __init__(self, size: int = 1000, overlap: int = 200):
        self.size, self.overlap = size, overlap

    def split(self, text: str, language: str) -> list[tuple[str, int, int]]:
        return window_split(text, self.size, self.overlap)


SPLITTERS = {"definitions": lambda size, overlap: DefinitionSplitter(), "recursive": RecursiveSplitter, "window": WindowSplitter}


def estimated_lines(text: str, piece: str, at: int) -> tuple[int, int]:
    """The first and last line of a piece that begins at a position of a text."""
    first = text.count("\n", 0, at) + 1
    return first, first + piece.count("\n")


_BRACED = re.compile(r"^\s*(?:(?:export|default|declare|public|private|protected|internal|static|abstract|final|sealed|async|pub(?:\([^)]*\))?|unsafe|const)\s+)*(?:function|class|interface|enum|struct|trait|impl|func|fn|type)\b|^\s+(?:(?:public|private|protected|internal|static|async|virtual|override|final)\s+)*(?!if|for|while|switch|catch|return|else)[\w<>\[\], ?]*\b\w+\s*\([^;{}]*\)[^;{}]*\{\s*$")


def definition_split(text: str, language: str) -> list[tuple[str, int, int]]:
    """(content, start_line, end_line) of every definition, nested ones too, in source order; else the whole text."""
    lines = text.split("\n")
    spans: list[tuple[int, int]] = []
    if language == "python":
        try:
            for node in ast.walk(ast.parse(text)):
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                    spans.append((first, node.end_lineno or node.lineno))
        except (SyntaxError, ValueError, RecursionError):
            pass
    else:
        depth, open_ = 0, []
        for k, line in enumerate(lines, 1):
            bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*$", "", line)
            if "{" in bare and _BRACED.match(bare):
                open_.append((depth, k))
            depth += bare.count("{") - bare.count("}")
            while open_ and depth <= open_[-1][0]:
                spans.append((open_.pop()[1], k))
    if not spans:
        return [(text, 1, len(lines))] if text.strip() else []
    return [("\n".join(lines[a - 1 : b]), a, b) for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1]))]


def chunk_files(files: DataFrame, splitter: str | Splitter = "definitions", path_col: str = "path", language_col: str = "language", content_col: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(path, seq, content, start_line, end_line) by a splitter: the name of one of ``SPLITTERS``, or any ``Splitter``.

    Null contents give no chunks; a null language is unknown.
    """
    base = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(language_col), F.lit("")).alias("language"), F.col(content_col).alias("content")).where("content is not null")
    cutter = SPLITTERS[splitter](size, overlap) if isinstance(splitter, str) else splitter

    def run(batches):
        for batch in batches:
            rows = [(p, k, *x) for p, lang, t in zip(*(c.to_pylist() for c in batch.columns)) for k, x in enumerate(cutter.split(t, lang))]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "seq", "content", "start_line", "end_line"])

    return base.mapInArrow(run, "path string, seq int, content string, start_line int, end_line int")
