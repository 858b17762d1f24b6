"""Roll-ups of a graph: entry points, directory clusters with cohesion, package trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.operators.graph.tables import degrees


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("root"))


def entry_points(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(id, score): functions and methods with more outgoing than twice the incoming edges, best first."""
    callable_ = nodes.where(F.col("label").isin("Function", "Method"))
    score = F.col("out_degree") - 2 * F.col("in_degree")
    return degrees(callable_, edges).select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def clusters(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """(folder, size, internal, outgoing, cohesion): folders of two nodes or more, largest first.

    Cohesion is the share of edges from the folder's nodes that end in it, 0 without edges.
    """
    placed = nodes.select("id", folder(F.col("file_path")).alias("folder"))
    sizes = placed.groupBy("folder").agg(F.count("*").alias("size"))
    ends = edges.select("source_id", "target_id").join(placed.select(F.col("id").alias("source_id"), F.col("folder").alias("a")), "source_id").join(placed.select(F.col("id").alias("target_id"), F.col("folder").alias("b")), "target_id", "left")
    flows = ends.groupBy(F.col("a").alias("folder")).agg(F.count("*").alias("outgoing"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("internal"))
    joined = sizes.where("size >= 2").join(flows, "folder", "left").fillna(0, ["outgoing", "internal"])
    cohesion = F.when(F.col("outgoing") == 0, 0.0).otherwise(F.col("internal") / F.col("outgoing"))
    return joined.select("folder", "size", "internal", "outgoing", F.round(cohesion, 6).alias("cohesion")).orderBy(F.desc("size"), "folder").limit(k)


def top_nodes(nodes: DataFrame, k: int = 5) -> DataFrame:
    """The first k nodes of each folder by name; Spark limits folders before the shuffle."""
    w = Window.partitionBy("folder").orderBy("name", "id")
    placed = nodes.select(folder(F.col("file_path")).alias("folder"), "name", "id")
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def package_tree(nodes: DataFrame) -> DataFrame:
    """(path, parent, depth, nodes): node counts of every folder, those below it included."""
    parts = F.split(F.col("file_path"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = nodes.where(F.size(parts) > 1).select(F.explode(prefixes).alias("path"))
    counted = rows.groupBy("path").agg(F.count("*").alias("nodes"))
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    return counted.select("path", parent.alias("parent"), F.size(F.split("path", "/")).alias("depth"), "nodes")
