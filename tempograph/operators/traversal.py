"""Breadth-first search, level by level, as joins.

A queue visits nodes of a level in the order of their parents, and each parent's edges in the order of their insertion. So
a node's place is the list of edge numbers on its path, compared as lists: no global numbering is needed, and a node that
several parents reach takes the least list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults as D
from ..plans.loop import Rounds, stored_seen


def walkable(nodes: DataFrame, edges: DataFrame, edge_type: str | None, predicate: Column | None, min_weight: float | None, min_confidence: float | None) -> DataFrame:
    """(src, dst, seq, weight, type) of the edges that may be taken: filtered once, before the levels. Edges to nodes that
    don't exist or fail the predicate are left out."""
    out = edges if edge_type is None else edges.filter(F.col("type") == edge_type)
    if min_weight is not None:
        out = out.filter(F.col("weight") >= min_weight)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    there = nodes.filter(predicate) if predicate is not None else nodes
    out = out.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), "seq", "weight", "type")
    return out.join(there.select(F.col("id").alias("dst")), "dst", "left_semi")


def _levels(walk: DataFrame, first: DataFrame, max_depth: int, rounds: Rounds, target: str | None = None):
    """Yields each level after the first, its depth and its size, up to the one with the target: (id, place, path, types,
    weights). Only the visited ids are kept besides."""
    level, visited, depth = first, first.select("id"), 0
    while depth < max_depth:
        depth += 1
        step = level.join(walk, level["id"] == walk["src"]).select(
            walk["dst"].alias("id"), F.array_append("place", F.col("seq")).alias("place"), F.array_append("path", F.col("dst")).alias("path"),
            F.array_append("types", F.col("type")).alias("types"), F.array_append("weights", F.col("weight")).alias("weights"),
        )
        best = step.groupBy("id").agg(F.min(F.struct("place", "path", "types", "weights")).alias("b")).select("id", "b.*")
        level, _, seen = stored_seen(best.join(visited, "id", "left_anti"), rounds.name, n=F.count("*"), hits=F.count_if(F.col("id") == F.lit(target)))
        if not seen["n"]:
            return
        yield level, depth, seen["n"]
        if seen["hits"]:
            return
        visited = visited.unionAll(level.select("id"))


def _first(nodes: DataFrame, start: str) -> DataFrame:
    return nodes.filter(F.col("id") == start).select("id", F.array().cast("array<bigint>").alias("place"), F.array("id").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<double>").alias("weights"))


def traverse(nodes: DataFrame, edges: DataFrame, start: str, edge_type: str | None = D.EDGE_TYPE, max_depth: int = D.TRAVERSE_DEPTH, limit: int = D.TRAVERSE_LIMIT, predicate: Column | None = None, min_weight: float | None = None, min_confidence: float | None = None) -> DataFrame:
    """(position, id, depth) of the first `limit` nodes in breadth-first order. A start that fails the predicate is
    expanded, not given; one that doesn't exist gives nothing."""
    rounds = Rounds(nodes.sparkSession, "bfs")
    first = rounds.cut(_first(nodes, start))
    given = first if predicate is None else first.join(nodes.filter(predicate).select("id"), "id", "left_semi")
    found, n = [given.select("id", F.lit(0).alias("depth"), "place")], given.count()
    walk = rounds.cut(walkable(nodes, edges, edge_type, predicate, min_weight, min_confidence))
    if n < limit and (n or not first.isEmpty()):
        for level, depth, size in _levels(walk, first, max_depth, rounds):
            found.append(level.select("id", F.lit(depth).alias("depth"), "place"))
            n += size
            if n >= limit:
                break
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    top = every.orderBy("depth", "place").limit(limit)
    return top.select((F.row_number().over(Window.orderBy("depth", "place")) - 1).alias("position"), "id", "depth")  # at most `limit` rows


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, target: str, edge_type: str | None = D.EDGE_TYPE, max_depth: int = D.PATH_DEPTH, predicate: Column | None = None, min_weight: float | None = None, min_confidence: float | None = None) -> DataFrame:
    """(position, id, edge_type, weight, total_weight) of the path of fewest edges, the first found of equal ones; none if
    there is none within max_depth. The start has no edge and weighs 0; it needn't meet the predicate, the target must."""
    spark = nodes.sparkSession
    rounds = Rounds(spark, "path")
    first = rounds.cut(_first(nodes, start))
    hit = first.filter(F.col("id") == target)
    if start != target and not first.isEmpty():
        walk = rounds.cut(walkable(nodes, edges, edge_type, predicate, min_weight, min_confidence))
        for level, _, _ in _levels(walk, first, max_depth, rounds, target):
            hit = level.filter(F.col("id") == target)
    parts = hit.select(F.posexplode("path").alias("position", "id"), "types", "weights")
    weight = F.when(F.col("position") == 0, 0.0).otherwise(F.get("weights", F.col("position") - 1))
    return parts.select("position", "id", F.when(F.col("position") > 0, F.get("types", F.col("position") - 1)).alias("edge_type"), weight.alias("weight"), F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).alias("total_weight"))
