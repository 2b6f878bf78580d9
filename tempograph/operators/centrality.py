"""Degree, PageRank, betweenness, closeness, distinct neighbours and orders of nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..plans.loop import Rounds
from .connectivity import known_edges


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): out-edges of all types, parallel ones counted; 0 without any."""
    n = edges.groupBy(F.col("from_node_id").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = D.PAGERANK[0], tolerance: float | None = D.PAGERANK[1], max_iterations: int = D.PAGERANK[2], cut_every: int = 5) -> DataFrame:
    """(id, rank) by synchronous steps until no rank changes by more than the tolerance, which is asked for every
    `cut_every` steps. Ranks of nodes without out-edges aren't handed out again. Edges to unknown nodes count for the
    out-degree; those from unknown nodes give nothing.

    Nodes and each edge's share are kept dealt by the key that steps join them on, so a step moves ranks alone: one join on
    the source and one sum by target, combined before its shuffle. The ranks are written every `cut_every` steps.
    """
    spark = nodes.sparkSession
    rounds, parts = Rounds(spark, "pagerank"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    base, n = rounds.counted(nodes.select("id").distinct())
    if not n:
        return base.withColumn("rank", F.lit(0.0))
    degree = edges.groupBy(F.col("from_node_id").alias("src")).agg(F.count("*").alias("degree"))
    shares = edges.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("k")).join(degree, "src")
    shares = rounds.cut(shares.select("src", "dst", (F.col("k") / F.col("degree")).alias("share")))
    dealt, ids = shares.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK), base.repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    ranks, kept = ids.withColumn("rank", F.lit(1.0 / n)), None
    for i in range(max_iterations):
        got = dealt.join(ranks, dealt["src"] == ranks["id"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ids.join(got, ids["id"] == got["to"], "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut_every == 0 or i + 1 == max_iterations:
            new = rounds.cut(new)
            # The step before is computed once more, from the last cut, only where the change is asked for.
            still = tolerance is not None and new.join(ranks.withColumnRenamed("rank", "was"), "id").agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance
            rounds.drop(*([kept] if kept is not None else []))
            kept = new
            if still:
                break
        ranks = new
    dealt.unpersist()
    ids.unpersist()
    rounds.drop(shares, base)
    return new


class _Packed:
    """A graph as arrays: out-edges of node i are dst[start[i]:start[i + 1]], each with its number of parallel edges."""

    def __init__(self, e: pd.DataFrame):
        codes, ids = pd.factorize(pd.concat([e["src"], e["dst"]]))
        src, dst = codes[: len(e)], codes[len(e) :]
        order = np.argsort(src, kind="stable")
        self.ids, self.at = np.asarray(ids, dtype=object), {x: i for i, x in enumerate(ids)}
        self.dst, self.k = dst[order], e["k"].to_numpy()[order]
        self.start = np.searchsorted(src[order], np.arange(len(ids) + 1))

    def search(self, source: int) -> tuple[np.ndarray, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Breadth first: numbers of shortest paths, the sum of distances, and each level's edges (from, to, how many)."""
        paths, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        front, total, steps = np.array([source]), 0, []
        paths[source], seen[source] = 1.0, True
        while True:
            n = self.start[front + 1] - self.start[front]
            at = np.repeat(self.start[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = np.repeat(front, n), self.dst[at]
            new = ~seen[b]
            a, b, k = a[new], b[new], self.k[at][new]
            if not len(b):
                return paths, total, steps
            np.add.at(paths, b, paths[a] * k)
            front = np.unique(b)
            seen[front] = True
            steps.append((a, b, k))
            total += len(front) * len(steps)


def _searched(e: DataFrame, sources: DataFrame, visit, finish, schema: str) -> DataFrame:
    """Searches from each source in a graph whose edges (src, dst, k) are counted and few: the sources are spread over
    tasks, and each task has the whole graph. visit(graph, code, state) takes one source in, finish(graph, state) gives a
    task's rows."""
    spark = sources.sparkSession
    packed = spark.sparkContext.broadcast(_Packed(e.toPandas()))

    def run(batches):
        g, state = packed.value, {}
        for batch in batches:
            for s in batch["id"]:
                visit(g, s, state)
        yield finish(g, state)

    return sources.select("id").repartition(max(spark.sparkContext.defaultParallelism, 1), "id").mapInPandas(run, schema)


def _count_paths(g: _Packed, s: str, state: dict) -> None:
    """Adds to every node's score what it gains by paths from s, from the last level back."""
    if s not in g.at:
        return
    code = g.at[s]
    paths, _, steps = g.search(code)
    delta = np.zeros(len(g.ids))
    for a, b, k in reversed(steps):
        np.add.at(delta, a, paths[a] * k / paths[b] * (1 + delta[b]))
    delta[code] = 0.0
    state["score"] = state.get("score", 0.0) + delta


def _scores(g: _Packed, state: dict) -> pd.DataFrame:
    score = np.broadcast_to(state.get("score", 0.0), len(g.ids))
    return pd.DataFrame({"id": g.ids[score > 0], "score": score[score > 0]})


def _sum_distances(g: _Packed, s: str, state: dict) -> None:
    state[s] = g.search(g.at[s])[1] if s in g.at else 0


def _sums(g: _Packed, state: dict) -> pd.DataFrame:
    return pd.DataFrame({"id": list(state), "sum": list(state.values())}).astype({"id": object, "sum": "int64"})


def _packed_edges(nodes: DataFrame, edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, int]:
    """(src, dst, k) of edges between nodes that exist, k parallel ones, and how many rows that are."""
    return rounds.counted(known_edges(nodes, edges).groupBy("src", "dst").agg(F.count("*").cast("double").alias("k")))


def _batches(chosen: DataFrame, n_nodes: int, rounds: Rounds) -> list[DataFrame]:
    """The sources in parts of so few that a search reaches at most about SEARCH_ROWS pairs of source and node."""
    chosen, n = rounds.counted(chosen)
    parts = max(1, -(-n * n_nodes // D.SEARCH_ROWS))
    return [chosen.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) for i in range(parts)]


def _reach(e: DataFrame, sources: DataFrame, rounds: Rounds) -> list[DataFrame]:
    """Levels of (source, id, paths): nodes at each distance from each source and the number of shortest paths to them."""
    level, n = rounds.counted(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))
    levels, visited = [level], level.select("source", "id")
    while n:
        step = level.join(e, level["id"] == e["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
        level, n = rounds.counted(step.join(visited, ["source", "id"], "left_anti"))
        if n:
            levels.append(level)
            visited = visited.unionAll(level.select("source", "id"))
    return levels


def _gained(e: DataFrame, sources: DataFrame, rounds: Rounds) -> DataFrame:
    """(id, score): what paths from the sources give each node, summed from the last level back."""
    levels = _reach(e, sources, rounds)
    below = levels[-1].withColumn("delta", F.lit(0.0))
    sums = below.filter("id <> source").groupBy("id").agg(F.sum("delta").alias("score"))
    for level in reversed(levels[:-1]):
        b = below.select("source", F.col("id").alias("dst"), F.col("paths").alias("p"), F.col("delta").alias("d"))
        via = level.join(e, level["id"] == e["src"]).join(b, ["source", "dst"])
        got = via.groupBy("source", "id").agg(F.sum(F.col("paths") * F.col("k") / F.col("p") * (1 + F.col("d"))).alias("delta"))
        below = rounds.cut(level.join(got, ["source", "id"], "left").select("source", "id", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        sums = sums.unionAll(below.filter("id <> source").groupBy("id").agg(F.sum("delta").alias("score")))
    return rounds.cut(sums.groupBy("id").agg(F.sum("score").alias("score")), *levels)


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, local: int = D.LOCAL_EDGES) -> DataFrame:
    """(id, score) of all nodes: shortest paths through each (Brandes), directed, not normalised, ends excluded, parallel
    edges as several paths. Graphs of at most `local` counted edges are handed to tasks that share out the sources; in
    larger ones the sources are searched by joins, keyed by source, as many at once as SEARCH_ROWS lets be."""
    rounds = Rounds(nodes.sparkSession, "between")
    ids, n_nodes = rounds.counted(nodes.select("id").distinct())
    chosen = ids if sources is None else ids.join(sources.select("id").distinct(), "id", "left_semi")
    e, n = _packed_edges(nodes, edges, rounds)
    if n <= local:
        every = _searched(e, chosen, _count_paths, _scores, "id string, score double")
    else:
        every = None
        for part in _batches(chosen, n_nodes, rounds):
            got = _gained(e, part, rounds)
            every = got if every is None else every.unionAll(got)
    score = every.groupBy("id").agg(F.sum("score").alias("score"))
    return ids.join(score, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def closeness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, local: int = D.LOCAL_EDGES) -> DataFrame:
    """(id, score) of the sources: (nodes - 1) over the sum of distances to what they reach; 0 if nothing, 1 in a graph of
    one node."""
    rounds = Rounds(nodes.sparkSession, "close")
    ids, n = rounds.counted(nodes.select("id").distinct())
    chosen = ids if sources is None else ids.join(sources.select("id").distinct(), "id", "left_semi")
    e, n_edges = _packed_edges(nodes, edges, rounds)
    if n_edges <= local:
        total = _searched(e, chosen, _sum_distances, _sums, "id string, sum long")
    else:
        total = None
        for part in _batches(chosen, n, rounds):
            levels = _reach(e, part, rounds)
            own = None
            for d, level in enumerate(levels):
                one = level.groupBy(F.col("source").alias("id")).agg((F.count("*") * d).alias("sum"))
                own = one if own is None else own.unionAll(one)
            own = rounds.cut(own.groupBy("id").agg(F.sum("sum").alias("sum")), *levels)
            total = own if total is None else total.unionAll(own)
    score = F.lit(1.0) if n == 1 else F.when(F.col("sum") > 0, (n - 1) / F.col("sum")).otherwise(0.0)
    return chosen.join(total, "id", "left").select("id", score.alias("score"))


def distinct_neighbours(edges: DataFrame, precision: int = D.HLL_PRECISION) -> DataFrame:
    """(id, estimate) of distinct targets by a HyperLogLog sketch, built in each task and merged."""
    return edges.groupBy(F.col("from_node_id").alias("id")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("to_node_id", F.lit(precision))).cast("double").alias("estimate"))


def by_community(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Nodes by community (a number; those without last), then by health, best first."""
    m = membership.select("id", F.col("community").cast("int").alias("community"))
    return nodes.join(m, "id", "left").orderBy(F.col("community").asc_nulls_last(), F.col("health_score").desc(), "id")


def by_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(out_degree(nodes, edges), "id").orderBy(F.col("degree").desc(), "id")


def by_accessibility(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.col("health_score").desc(), "id")
