"""Modularity and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..plans.loop import Rounds


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: q, over communities, of the share of weight within less the squared half-share of out-weight; 0 without
    weight. Edges with an end outside the membership count in the total only."""
    m = membership.select("id", "community")
    e = edges.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), "weight")
    ends = e.join(m.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst", "left")
    by = ends.groupBy("cs").agg(F.sum("weight").alias("out"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inner"))
    s = by.agg(F.sum("out").alias("m"), F.sum(F.when(F.col("cs").isNotNull(), F.col("inner"))).alias("i"), F.sum(F.when(F.col("cs").isNotNull(), F.col("out") * F.col("out"))).alias("sq"))
    return s.select(F.when(F.col("m") > 0, F.col("i") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).otherwise(0.0).alias("q"))


def clusters(nodes: DataFrame, edges: DataFrame, mode: str = "reference", passes: int = D.CLUSTER_PASSES, least_gain: float = D.CLUSTER_GAIN) -> DataFrame:
    """(id, community): communities are numbered by their least id.

    mode "reference": a node's gain is the same for every target: the weight of its own edges into its community, over 2m,
    less its out-weight times its community's, over 4m²; if it is above 0, the node goes to the community of the first of
    its out-edges (by seq) that leads to another. From singletons only a self-loop makes such a gain, so nodes of graphs
    without loops stay alone. All nodes of a pass move at once. mode "modularity": synchronous local moves to the community of
    greatest gain, the least of equal ones, half of the nodes after the other, halved anew each pass; passes stop when none moves or, after the
    first two, modularity gains less than least_gain.
    """
    ids = nodes.select("id").distinct()
    if mode == "reference":
        return _reference_clusters(ids, edges, passes, least_gain)
    rounds = Rounds(nodes.sparkSession, "communities")
    known = edges.join(ids.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").join(ids.withColumnRenamed("id", "to_node_id"), "to_node_id", "left_semi")
    e = known.filter("from_node_id <> to_node_id").select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b"), "weight")
    e = rounds.cut(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("w")))
    total = e.agg(F.sum("w")).first()[0] or 0.0
    now = rounds.cut(ids.withColumn("community", F.col("id")))
    if not total:
        return now
    strength = rounds.cut(e.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    last_q, still = modularity(edges, now).first()[0], 0
    for p in range(2 * passes):
        k = now.join(strength, "id")
        size = k.groupBy("community").agg(F.sum("k").alias("tot"))
        to = e.join(now.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("into"))
        own = k.select("id", "k", F.col("community").alias("at"))
        gains = to.join(own, "id").join(size, "community")
        gain = F.col("into") - F.col("k") * (F.col("tot") - F.when(F.col("community") == F.col("at"), F.col("k")).otherwise(0.0)) / total
        best = gains.withColumn("gain", gain).groupBy("id").agg(F.max(F.when(F.col("community") == F.col("at"), F.col("gain"))).alias("stay"), F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("b"), F.first("k").alias("k"), F.first("at").alias("at"))
        alone = -F.col("k") * 0.0
        moves = best.filter((-F.col("b.loss") > F.coalesce("stay", alone) + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(p // 2)), F.lit(2)) == p % 2)).select("id", F.col("b.community").alias("new"))
        moves = rounds.cut(moves)
        still = still + 1 if moves.isEmpty() else 0
        if still == 2:  # neither half moves
            break
        if not still:
            now = rounds.cut(now.join(moves, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
        if p > 1 and p % 2:
            q = modularity(edges, now).first()[0]
            if 0 <= q - last_q < least_gain:
                break
            last_q = q
    names = now.groupBy("community").agg(F.min("id").alias("name"))
    return now.join(names, "community").select("id", F.col("name").alias("community"))


def _reference_clusters(ids: DataFrame, edges: DataFrame, passes: int, least_gain: float) -> DataFrame:
    now = ids.withColumn("community", F.col("id"))
    if edges.filter("from_node_id = to_node_id").isEmpty():
        return now
    rounds = Rounds(ids.sparkSession, "reference")
    e = edges.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), "weight", "seq")
    now, e = rounds.cut(now), rounds.cut(e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
    m2 = 2.0 * (edges.agg(F.sum("weight")).first()[0] or 0.0)
    last_q = modularity(edges, now).first()[0]
    for _ in range(passes if m2 else 0):
        ends = e.join(now.select(F.col("id").alias("src"), F.col("community").alias("own")), "src").join(now.select(F.col("id").alias("dst"), F.col("community").alias("to")), "dst", "left")
        away = F.when(F.col("to") != F.col("own"), F.struct("seq", "dst", "to"))
        of_node = ends.groupBy("src", "own").agg(F.sum("weight").alias("k"), F.coalesce(F.sum(F.when(F.col("to") == F.col("own"), F.col("weight"))), F.lit(0.0)).alias("into"), F.min(away).alias("first"))
        total = of_node.groupBy("own").agg(F.sum("k").alias("tot"))
        gain = F.col("into") / m2 - F.col("tot") * F.col("k") / (m2 * m2)
        moves, n = rounds.counted(of_node.join(total, "own").filter((gain > 0) & F.col("first").isNotNull()).select(F.col("src").alias("id"), F.col("first.to").alias("new")))
        if not n:
            break
        now = rounds.cut(now.join(moves, "id", "left").select("id", F.coalesce("new", "community").alias("community")), now, moves)
        q = modularity(edges, now).first()[0]
        if q - last_q < least_gain:
            break
        last_q = q
    names = now.groupBy("community").agg(F.min("id").alias("name"))
    return now.join(names, "community").select("id", F.col("name").alias("community"))


def cluster_table(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, node_ids, size, modularity): one row for each community; modularity is the whole partition's."""
    q = modularity(edges, membership).first()[0]
    return membership.groupBy(F.col("community").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("node_ids"), F.count("*").cast("int").alias("size")).withColumn("modularity", F.lit(q))
