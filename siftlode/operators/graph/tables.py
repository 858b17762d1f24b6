"""Keeping node and edge tables: upserts, removal of duplicates, deletion with cascade, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The labels of nodes and the types of edges.
LABELS = ("Function", "Method", "Class", "Interface", "Struct", "Enum", "Variable", "Module", "File", "Folder", "Package", "Route", "Resource", "ADR")
EDGE_TYPES = (
    "CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "DECORATES", "HANDLES", "HTTP_CALLS", "ASYNC_CALLS", "DATA_FLOWS", "TYPE_REF",
    "CONTAINS", "CONFIGURES", "CROSS_HTTP_CALLS", "CROSS_ASYNC_CALLS", "CROSS_CHANNEL",
)


def node_id(project: Column, qualified_name: Column) -> Column:
    """A stable id of a node's key, so that writing a node again keeps its id."""
    return F.xxhash64(project, qualified_name)


def upsert_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (project, qualified_name): the last written one."""
    cols = [c for c in nodes.columns if c not in ("project", "qualified_name")]
    last = F.max_by(F.struct(*cols), F.col(seq))
    return nodes.groupBy("project", "qualified_name").agg(last.alias("v")).select("project", "qualified_name", "v.*")


def dedupe_edges(edges: DataFrame, seq: str = "seq", keep: str = "first") -> DataFrame:
    """One row per (project, source_id, target_id, type).

    Its properties are those of the ``first`` or ``last`` written row, or with ``merge`` those of all, later ones over
    earlier ones.
    """
    key = ["project", "source_id", "target_id", "type"]
    if keep == "merge":
        rows = edges.select(*key, seq, F.explode(_properties(F.col("properties"))).alias("name", "value"))
        last = rows.groupBy(*key, "name").agg(F.max_by("value", seq).alias("value"))
        merged = last.groupBy(*key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("properties"))
        return edges.select(*key).distinct().join(merged, key, "left").select(*key, F.coalesce("properties", F.lit("{}")).alias("properties"))
    pick = F.min_by if keep == "first" else F.max_by
    return edges.groupBy(*key).agg(pick("properties", seq).alias("properties"))


def edges_at(edges: DataFrame, source: Column | str | int | None = None, target: Column | str | int | None = None, types: tuple[str, ...] = (), project: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges from a source, to a target, of some types and a project; a page of them in order of their ends."""
    rows = edges
    for name, value in (("source_id", source), ("target_id", target), ("project", project)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if types:
        rows = rows.where(F.col("type").isin(*types))
    return rows if limit is None else rows.orderBy("source_id", "target_id", "type").limit(limit)


def adjacency(edges: DataFrame, ids: DataFrame, direction: str = "outbound", types: tuple[str, ...] = ()) -> DataFrame:
    """(id, others): of each given node the nodes at the other end of its edges, in order."""
    a, b = ("source_id", "target_id") if direction == "outbound" else ("target_id", "source_id")
    rows = edges_at(edges, types=types).select(F.col(a).alias("id"), F.col(b).alias("other")).join(ids.select("id").distinct(), "id", "left_semi")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("others"))


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the given (id) rows."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_qualified_name(nodes: DataFrame, project: str, qualified_name: str) -> DataFrame:
    return nodes.where((F.col("project") == project) & (F.col("qualified_name") == qualified_name))


def distinct_files(nodes: DataFrame) -> DataFrame:
    """(project, file_path) of all nodes that stand in a file."""
    return nodes.where("file_path <> ''").select("project", "file_path").distinct()


def delete_label(nodes: DataFrame, edges: DataFrame, project: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Removes all nodes of a label of a project, with their edges."""
    return delete_nodes(nodes, edges, nodes.where((F.col("project") == project) & (F.col("label") == label)))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id")
    half = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return half.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone`` (ids), and edges without those at either end."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes all nodes of (project, file_path) rows, with their edges."""
    return delete_nodes(nodes, edges, nodes.join(files.select("project", "file_path").distinct(), ["project", "file_path"], "left_semi"))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "label").agg(F.count("*").alias("n"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project", "type").agg(F.count("*").alias("n"))


def project_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, nodes, edges); a project with edges only has 0 nodes, and the other way round."""
    n = nodes.groupBy("project").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("project").agg(F.count("*").alias("edges"))
    return n.join(e, "project", "full_outer").select("project", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def schema_listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name): the labels and edge types in use."""
    a = nodes.select(F.lit("label").alias("kind"), F.col("label").alias("name"))
    return a.unionByName(edges.select(F.lit("type").alias("kind"), F.col("type").alias("name"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of all nodes, zeros kept. Partial counts fold a hub before the shuffle."""
    out = edges.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = edges.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    both = out.unionByName(into).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(both, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def _properties(c: Column) -> Column:
    """A JSON object as a map of texts; unreadable JSON counts as empty."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def merge_properties(old: Column, new: Column) -> Column:
    """A shallow merge of two JSON objects, the new one's entries win; unreadable JSON counts as empty."""
    a, b = _properties(old), _properties(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def adr_rows(records: DataFrame) -> DataFrame:
    """(project, title, content, status, created) rows as ADR nodes, one per project and slug of the title."""
    from siftlode.functions.text import adr_slug

    qn = F.concat(F.col("project"), F.lit(".adr."), adr_slug(F.col("title")))
    return records.select(
        node_id(F.col("project"), qn).alias("id"), "project", F.lit("ADR").alias("label"), F.col("title").alias("name"), qn.alias("qualified_name"),
        F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.to_json(F.struct("content", "status", "created")).alias("properties"),
    )


def adrs(nodes: DataFrame, project: str | None = None, most: int = 1000) -> DataFrame:
    """(id, project, title, status, content, created) of the ADRs, at most ``most`` by title."""
    rows = nodes.where(F.col("label") == "ADR")
    rows = rows if project is None else rows.where(F.col("project") == project)
    get = lambda k: F.get_json_object("properties", f"$.{k}").alias(k)
    return rows.select("id", "project", F.col("name").alias("title"), get("status"), get("content"), get("created")).orderBy("title", "id").limit(most)


def update_properties(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the properties of (id, properties) rows merged into theirs; unknown ids change nothing."""
    joined = nodes.join(changes.select("id", F.col("properties").alias("__new")), "id", "left")
    merged = F.when(F.col("__new").isNull(), F.col("properties")).otherwise(merge_properties(F.col("properties"), F.col("__new")))
    return joined.withColumn("properties", merged).select(*nodes.columns)
