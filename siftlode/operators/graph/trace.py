"""Bounded breadth-first tracing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.runtime import cut

#: The edge types each mode follows.
MODES = {
    "calls": ("CALLS",),
    "data_flow": ("CALLS", "DATA_FLOWS"),
    "cross_service": ("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "CROSS_HTTP_CALLS", "CROSS_ASYNC_CALLS", "CROSS_CHANNEL"),
}


def mode_types(mode: str) -> tuple[str, ...]:
    """The edge types of a mode; an unknown one follows calls."""
    return MODES.get(mode, MODES["calls"])


def is_test_path(col: str = "file_path"):
    p = F.lower(F.col(col))
    return p.contains("test") | p.contains("spec") | p.contains("__tests__")


def trace(edges: DataFrame, roots: DataFrame, depth: int = 3, direction: str = "outbound", types: tuple[str, ...] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth, direction): nodes reached from ``roots`` (id) within ``depth`` steps, at their least depth.

    ``direction`` is outbound, inbound or both; with both, what inbound reached is not reached again outbound.
    ``allowed`` (id) names the nodes that may be entered; others are neither given nor passed. A round is one join of
    the frontier, made distinct, with the edges; visited nodes are removed by an anti-join. Edges are written out once,
    sorted by either end, and frontiers each round, so no round computes an edge again and lineage stays short; a small
    frontier is broadcast by its size.
    """
    used = edges if types is None else edges.where(F.col("type").isin(*types))
    used = cut(used.select("source_id", "target_id"), "steps")
    visited = roots.select("id").distinct()
    found: DataFrame | None = None
    for way in ("inbound", "outbound") if direction == "both" else (direction,):
        a, b = ("source_id", "target_id") if way == "outbound" else ("target_id", "source_id")
        steps = used.select(F.col(a).alias("id"), F.col(b).alias("next"))
        frontier = roots.select("id").distinct()
        for d in range(1, depth + 1):
            reached = frontier.join(steps, "id").select(F.col("next").alias("id")).distinct()
            if allowed is not None:
                reached = reached.join(allowed.select("id"), "id", "left_semi")
            frontier = cut(reached.join(visited, "id", "left_anti"), "frontier")
            level = frontier.select("id", F.lit(d).alias("depth"), F.lit(way).alias("direction"))
            found = level if found is None else found.unionByName(level)
            visited = visited.unionByName(frontier)
            if frontier.isEmpty():
                break
    return found


def resolve_root(nodes: DataFrame, name: str) -> DataFrame:
    """(id) of the node a name means: an exact name first, then an exact qualified name, then the first that holds it."""
    n, q = F.col("name"), F.col("qualified_name")
    low = name.lower()
    rank = F.when(n == name, 0).when(q == name, 1).when(F.lower(n).contains(low), 2).when(F.lower(q).contains(low), 3)
    return nodes.select("id", "name", rank.alias("r")).where("r is not null").orderBy("r", "name", "id").limit(1).select("id")
