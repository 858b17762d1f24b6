"""Searching nodes and lines, neighbours and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators.graph.tables import degrees


#: The weights of a node's texts in a search by words.
WEIGHTS = {"name": 1.0, "qualified_name": 2.0, "file_path": 0.5}


def _holds(col: str, pattern: str) -> Column:
    """A case-insensitive literal search; wildcard characters are dropped, as in a pattern of plain words."""
    return F.lower(F.col(col)).contains(re.sub(r"[*?^${}()\[\]]", "", pattern).lower())


def find_nodes(nodes: DataFrame, edges: DataFrame | None = None, project: str | None = None, label: str | None = None, name: str | None = None, qualified_name: str | None = None, file: str | None = None, exact_file: str | None = None, min_degree: int | None = None, max_degree: int | None = None, limit: int | None = 200, offset: int = 0) -> DataFrame:
    """A page of nodes by name, then id, with their degrees if edges are given; the degree filter comes before the page."""
    rows = nodes
    for col, value in (("project", project), ("label", label), ("file_path", exact_file)):
        if value is not None:
            rows = rows.where(F.col(col) == value)
    for col, pattern in (("name", name), ("qualified_name", qualified_name), ("file_path", file)):
        if pattern is not None:
            rows = rows.where(_holds(col, pattern))
    if edges is not None:
        rows = rows.join(degrees(rows, edges), "id")
        total = F.col("in_degree") + F.col("out_degree")
        if min_degree is not None:
            rows = rows.where(total >= min_degree)
        if max_degree is not None:
            rows = rows.where(total <= max_degree)
    return rows if limit is None else rows.orderBy("name", "id").offset(offset).limit(limit)


def found_page(rows: DataFrame, order: list, limit: int = 200, offset: int = 0) -> tuple[DataFrame, int, bool]:
    """(page, total, has_more) of rows in an order."""
    total = rows.count()
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page, total, offset + min(limit, max(0, total - offset)) < total


_MATCH = re.compile(r"^\s*MATCH\s*\(\s*(\w+)(?:\s*:\s*(\w+))?\s*\)\s*(?:WHERE\s+(.*?))?\s*RETURN\s+.+$", re.I | re.S)
_FIELDS = {"name": "name", "label": "label", "qualifiedname": "qualified_name", "qualified_name": "qualified_name"}


def cypher(nodes: DataFrame, query: str, project: str | None = None) -> DataFrame:
    """``MATCH (v) [WHERE conditions] RETURN v``: equality on name, label, qualifiedName, and CONTAINS on name, all of them."""
    m = _MATCH.match(query)
    if not m:
        raise ValueError(f"not a query of the supported form: {query}")
    rows = nodes if project is None else nodes.where(F.col("project") == project)
    if m.group(2):
        rows = rows.where(F.col("label") == m.group(2))
    for field, value in re.findall(r"\w+\.(\w+)\s*=\s*['\"]([^'\"]*)['\"]", m.group(3) or ""):
        if field.lower() in _FIELDS:
            rows = rows.where(F.col(_FIELDS[field.lower()]) == value)
    part = re.search(r"\w+\.name\s+CONTAINS\s+['\"]([^'\"]*)['\"]", m.group(3) or "", re.I)
    return rows.where(_holds("name", part.group(1))) if part else rows


def grep(files: DataFrame, pattern: str, regex: bool = False, path_filter: str | None = None, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, line, text): lines that hold a literal (any case) or match a regular expression (as it is)."""
    rows = files if path_filter is None else files.where(F.col(path_col).rlike(path_filter))
    lines = rows.select(path_col, F.posexplode(F.split(content_col, "\n")).alias("at", "text"))
    hit = F.col("text").rlike(pattern) if regex else F.lower(F.col("text")).contains(pattern.lower())
    return lines.where(hit).select(path_col, (F.col("at") + 1).alias("line"), "text")


def smallest_node(lines: DataFrame, nodes: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, line, node_id): each line with the smallest node of its file around it, -1 where there is none.

    The file is the join key, the line range a condition on it; hot files are split by adaptive skew handling.
    """
    spans = nodes.select(F.col("file_path").alias(path_col), F.col("id").alias("node_id"), "start_line", "end_line")
    cond = (F.col("l.line") >= F.col("n.start_line")) & (F.col("l.line") <= F.col("n.end_line"))
    met = lines.alias("l").join(spans.alias("n"), (F.col(f"l.{path_col}") == F.col(f"n.{path_col}")) & cond, "left")
    size = F.col("n.end_line") - F.col("n.start_line")
    best = met.groupBy(F.col(f"l.{path_col}").alias(path_col), F.col("l.line").alias("line")).agg(F.min(F.when(F.col("n.node_id").isNotNull(), F.struct(size.alias("s"), F.col("n.node_id").alias("node_id")))).alias("b"))
    return best.select(path_col, "line", F.coalesce(F.col("b.node_id").cast("string"), F.lit("-1")).alias("node_id"))


def once_per_node(matches: DataFrame) -> DataFrame:
    """Of the lines matched to one node of a file, the first; lines outside nodes all stay."""
    w = Window.partitionBy("path", "node_id").orderBy("line")
    return matches.withColumn("r", F.row_number().over(w)).where("r = 1 or node_id = '-1'").drop("r")


def search_code(files: DataFrame, nodes: DataFrame, pattern: str, regex: bool = False, path_filter: str | None = None, limit: int = 10) -> tuple[DataFrame, dict]:
    """(path, line, text, node_id, name, label) of grep hits, each node once, in order of path and line; and the totals.

    A hit outside all nodes stands for its file (node_id -1, label File). ``limit`` is a page of the result; the
    totals are of all hits.
    """
    hits = grep(files, pattern, regex, path_filter)
    placed = once_per_node(smallest_node(hits.select("path", "line"), nodes)).join(hits, ["path", "line"])
    titles = nodes.select(F.col("id").cast("string").alias("node_id"), "name", "label", F.col("file_path").alias("path"))
    named = placed.join(titles, ["node_id", "path"], "left")
    base = F.element_at(F.split("path", "/"), -1)
    rows = named.select("path", "line", F.trim("text").alias("text"), "node_id", F.coalesce("name", base).alias("name"), F.coalesce("label", F.lit("File")).alias("label"))
    totals = {"matches": hits.count(), "results": rows.count()}
    return rows.orderBy("path", "line").limit(limit), totals


def snippet(content: Column, start: Column, end: Column) -> Column:
    """The lines start to end, from 1, of a text."""
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(start, F.lit(1)).cast("int"), F.greatest(end - start + 1, F.lit(1)).cast("int")), "\n")


def neighbours(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """(id, direction, neighbour): callers and callees by name; an unknown node reads ``id:<id>``."""
    used = edges.where(F.col("type").isin(*types))
    both = used.select(F.col("source_id").alias("id"), F.lit("callee").alias("direction"), F.col("target_id").alias("other")).unionByName(
        used.select(F.col("target_id").alias("id"), F.lit("caller").alias("direction"), F.col("source_id").alias("other"))
    )
    named = both.join(nodes.select(F.col("id").alias("other"), "name"), "other", "left")
    return named.select("id", "direction", F.coalesce("name", F.concat(F.lit("id:"), F.col("other").cast("string"))).alias("neighbour")).distinct()


def enrich(nodes: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """(id, callers, callees, top_callers, top_callees, flag) of nodes: counts, the first names, ``unused`` or ``entry``.

    Callers are the sources of CALLS edges, callees the targets of edges of any type.
    """
    into = edges.where("type = 'CALLS'").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    names = nodes.select(F.col("id").alias("other"), "name")

    def side(pairs: DataFrame, count: str, first: str) -> DataFrame:
        named = pairs.join(names, "other", "left").withColumn("name", F.coalesce("name", F.lit("?")))
        return named.groupBy("id").agg(F.count("*").alias(count), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, top), ",").alias(first))

    joined = nodes.select("id", "label").join(side(into, "callers", "top_callers"), "id", "left").join(side(out, "callees", "top_callees"), "id", "left")
    a, b = F.coalesce("callers", F.lit(0)), F.coalesce("callees", F.lit(0))
    flag = F.when((a == 0) & (b == 0), "unused").when((a == 0) & (F.col("label") == "Function"), "entry").otherwise("")
    return joined.select("id", a.alias("callers"), b.alias("callees"), F.coalesce("top_callers", F.lit("")).alias("top_callers"), F.coalesce("top_callees", F.lit("")).alias("top_callees"), flag.alias("flag"))


def impacted(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes whose file path holds the path of a changed file, whatever stands before it.

    A path is taken apart into its endings at each ``/``, so the join is on equal text and no pair of lists is crossed.
    """
    ends = nodes.select("id", F.explode(_endings(F.col("file_path"))).alias("file_path"))
    names = changed.select(F.lower("file_path").alias("file_path")).distinct()
    return nodes.join(ends.join(names, "file_path", "left_semi").select("id").distinct(), "id", "left_semi")


def _endings(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def route_summary(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(project, routes, first): how many routes a project has, and the first k by name."""
    rows = nodes.where("label = 'Route'")
    names = F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, k), "; ")
    return rows.groupBy("project").agg(F.count("*").alias("routes"), names.alias("first"))
