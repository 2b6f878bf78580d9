"""Health vectors, bottlenecks, insights, decay and conflicts over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import scores as S
from ..functions.temporal import instant, seconds_between
from ..plans.loop import Rounds


def weak_out_edges(edges: DataFrame, limit: float = D.WEAK_WEIGHT) -> DataFrame:
    """(node_id, weak_edges): out-edges of less weight than the limit."""
    return edges.filter(F.col("weight") < limit).groupBy(F.col("from_node_id").alias("node_id")).agg(F.count("*").alias("weak_edges"))


def health_vectors(metrics: DataFrame, edges: DataFrame | None = None, nodes: DataFrame | None = None, weights: tuple[float, float, float] = D.HEALTH_WEIGHTS, approximate: bool = False) -> DataFrame:
    """(node_id, failure_prob, p50, p95, p99, predicted_latency_ms, smooth_throughput, resource_strain, retry_budget,
    health_score, n) from metrics (node_id, ts, values).

    Latencies are those entries that have AvgLatencyMs; a failure is an entry with ItemsFailed above 0, of all entries. The
    latency forecast folds a node's latencies in the order of time, which takes one node's history as an array; the other
    columns are plain aggregates. approximate: percentiles by sketch. nodes: those without history get zeros and score 1.
    """
    m = metrics.select("node_id", "ts", F.col("values")["AvgLatencyMs"].alias("lat"), F.col("values")["SmoothThroughput"].alias("thr"), F.col("values")["ItemsFailed"].alias("failed"))
    p = (lambda q: F.percentile_approx("lat", q, 10_000)) if approximate else (lambda q: F.percentile("lat", q))
    history = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c).alias("x"))))), lambda s: s["x"])
    out = m.groupBy("node_id").agg(
        F.avg(F.when(F.col("failed") > 0, 1.0).otherwise(0.0)).alias("failure_prob"), *(F.coalesce(p(q / 100), F.lit(0.0)).alias(f"p{q}") for q in (50, 95, 99)),
        history("lat").alias("lats"), history("thr").alias("thrs"), F.count("*").alias("n"),
    )
    if nodes is not None:
        out = nodes.select(F.col("id").alias("node_id")).join(out, "node_id", "left")
    smooth = F.when(F.size("thrs") > 0, F.aggregate(F.slice("thrs", 2, F.greatest(F.size("thrs") - 1, F.lit(0))), F.get("thrs", F.lit(0)), lambda s, x: D.EMA_ALPHA * x + (1 - D.EMA_ALPHA) * s)).otherwise(0.0)
    zero = F.lit(0.0)
    out = out.select("node_id", *(F.coalesce(c, zero).alias(c) for c in ("failure_prob", "p50", "p95", "p99")), F.coalesce(S.double_ema(F.col("lats")), zero).alias("predicted_latency_ms"), F.coalesce(smooth, zero).alias("smooth_throughput"), F.coalesce("n", F.lit(0)).alias("n"))
    if edges is not None:
        out = out.join(weak_out_edges(edges), "node_id", "left").withColumn("resource_strain", S.strain(F.col("weak_edges"))).drop("weak_edges")
    else:
        out = out.withColumn("resource_strain", zero)
    return out.withColumn("retry_budget", F.lit(D.RETRY_BUDGET)).withColumn("health_score", S.health_score(F.col("failure_prob"), F.col("predicted_latency_ms"), F.col("resource_strain"), weights))


def snapshot_vectors(metrics: DataFrame, weights: tuple[float, float, float] = D.HEALTH_WEIGHTS) -> DataFrame:
    """health_vectors of each entry by itself, with its ts: nothing is shuffled, as the percentiles and the forecast of
    one entry are its own latency."""
    value = lambda k: F.coalesce(F.col("values")[k], F.lit(0.0))
    failed, latency, zero = F.when(value("ItemsFailed") > 0, 1.0).otherwise(0.0), value("AvgLatencyMs"), F.lit(0.0)
    return metrics.select(
        "node_id", "ts", failed.alias("failure_prob"), *(latency.alias(c) for c in ("p50", "p95", "p99", "predicted_latency_ms")), value("SmoothThroughput").alias("smooth_throughput"),
        zero.alias("resource_strain"), F.lit(D.RETRY_BUDGET).alias("retry_budget"), S.health_score(failed, latency, zero, weights).alias("health_score"),
    )


def predict_bottlenecks(current: DataFrame, history: DataFrame, latency_limit: float = D.BOTTLENECK_LATENCY_MS, health_limit: float = D.BOTTLENECK_HEALTH) -> DataFrame:
    """current and history: (node_id, ts, health_score, predicted_latency_ms, failure_prob). For each current row, against
    the node's latest earlier one: is_bottleneck, health_delta, latency_delta, confidence, time_to_impact_ms. Rows without
    earlier one are compared with themselves."""
    h = history.select("node_id", F.struct(F.col("ts").alias("t"), F.col("health_score").alias("s"), F.col("predicted_latency_ms").alias("l")).alias("h"))
    keys = current.select("node_id", "ts").distinct()
    last = keys.join(h, "node_id").filter(F.col("h.t") < F.col("ts")).groupBy("node_id", "ts").agg(F.max("h").alias("h"))
    joined = current.join(last, ["node_id", "ts"], "left")
    was = lambda f, c: F.coalesce(F.col(f"h.{f}"), F.col(c))
    health, latency = was("s", "health_score") - F.col("health_score"), F.col("predicted_latency_ms") - was("l", "predicted_latency_ms")
    out = joined.withColumns({
        "is_bottleneck": S.is_bottleneck(F.col("predicted_latency_ms"), F.col("health_score"), latency_limit, health_limit), "health_delta": health, "latency_delta": latency,
        "confidence": S.bottleneck_confidence(health, latency, F.col("failure_prob")),
        "time_to_impact_ms": S.time_to_impact_ms(F.col("predicted_latency_ms"), was("l", "predicted_latency_ms"), seconds_between(was("t", "ts"), F.col("ts")), latency_limit),
    })
    return out.drop("h")


def _insight(kind: Column, title: Column, description: Column, nodes: Column, confidence: Column, severity: Column, now) -> list[Column]:
    """The columns of an insight; its id is a hash of what it says, so that making it again makes no other."""
    at = instant(now)
    return [F.sha2(F.concat_ws("|", kind, title, F.array_join(nodes, ","), at.cast("string")), 256).alias("id"), kind.alias("type"), title.alias("title"), description.alias("description"), nodes.alias("related_node_ids"), confidence.cast("double").alias("confidence"), severity.alias("severity"), at.alias("generated_at")]


def insights_of(predictions: DataFrame, now, health_drop: float = D.INSIGHT_HEALTH_DROP) -> DataFrame:
    """An insight for each prediction that is a bottleneck or whose health fell by more than health_drop."""
    hot = F.col("is_bottleneck")
    kind = F.when(hot, "BottleneckPrediction").otherwise("HealthDegradation")
    title = F.when(hot, F.format_string("Bottleneck predicted at %s", F.col("node_id"))).otherwise(F.format_string("Health degradation at %s", F.col("node_id")))
    text = F.format_string("Latency %.0f ms, health %.2f, confidence %.2f", "predicted_latency_ms", "health_score", "confidence")
    severity = F.when(hot, "Critical").otherwise("Warning")
    return predictions.filter(hot | (F.col("health_delta") > health_drop)).select(*_insight(kind, title, text, F.array("node_id"), F.col("confidence"), severity, now))


def retry_insights(vectors: DataFrame, now) -> DataFrame:
    """An insight for each node whose retry budget is used up."""
    return vectors.filter("retry_budget <= 0").select(*_insight(F.lit("RetryBudgetExhausted"), F.format_string("Retry budget exhausted at %s", F.col("node_id")), F.format_string("No retries left, health %.2f", F.col("health_score")), F.array("node_id"), F.lit(1.0), F.lit("Warning"), now))


def cluster_insights(clusters: DataFrame, now) -> DataFrame:
    """An insight for each cluster (id, node_ids, size, modularity)."""
    return clusters.select(*_insight(F.lit("ClusterDiscovered"), F.format_string("Cluster of %d nodes", F.col("size").cast("int")), F.format_string("Modularity %.3f", F.col("modularity")), F.col("node_ids"), F.col("modularity"), F.lit("Info"), now))


def consolidate(new: DataFrame, existing: DataFrame, least: int = D.CONSOLIDATE_FROM) -> DataFrame:
    """Each new insight with those existing of its type that share a node with it: with itself n of them. From `least` on
    it is replaced by one of all their nodes and mean confidence, raised by a tenth for each above `least`; others stay.
    Insights meet on (type, node), so no pairs of all insights are formed."""
    by_node = lambda t, p: t.select("type", F.explode("related_node_ids").alias("node"), F.struct(F.col("id").alias("id"), F.col("confidence").alias("c"), F.col("related_node_ids").alias("nodes")).alias(p))
    near = by_node(new, "n").join(by_node(existing, "e"), ["type", "node"]).filter("n.id <> e.id").select(F.col("n.id").alias("id"), "e").distinct()
    found = near.groupBy("id").agg(F.count("*").alias("others"), F.sum("e.c").alias("sum"), F.flatten(F.collect_list("e.nodes")).alias("more"))
    j = new.join(found, "id", "left").withColumn("k", F.coalesce("others", F.lit(0)) + 1)
    many = F.col("k") >= least
    value = F.least((F.col("confidence") + F.coalesce("sum", F.lit(0.0))) / F.col("k") + D.CONSOLIDATE_STEP * (F.col("k") - least), F.lit(1.0))
    nodes = F.array_sort(F.array_distinct(F.concat("related_node_ids", F.coalesce("more", F.array().cast("array<string>")))))
    return j.select(
        F.when(many, F.concat(F.lit("consolidated_"), "id")).otherwise(F.col("id")).alias("id"), "type", F.when(many, F.format_string("Consolidated: %d insights of %s", "k", "type")).otherwise(F.col("title")).alias("title"),
        F.when(many, F.format_string("%d similar insights over %d nodes", F.col("k"), F.size(nodes))).otherwise(F.col("description")).alias("description"), F.when(many, nodes).otherwise(F.col("related_node_ids")).alias("related_node_ids"),
        F.when(many, value).otherwise(F.col("confidence")).alias("confidence"), "severity", "generated_at",
    )


def group_greedily(insights: DataFrame) -> DataFrame:
    """(id, type, leader): in the order of (generated_at, id), an insight joins the first group whose first member shares a
    node with it, else leads its own. Ids are unique.

    The leaders are the first maximal independent set in that order, of insights that share a node of a type. Each round
    takes all insights that come first on all of their nodes as leaders, and out of the search what shares a node with
    one; so an insight waits only for those before it that share its nodes, and no type or component is one task.
    """
    rounds = Rounds(insights.sparkSession, "greedy")
    nodes = F.array_compact(F.array_distinct(F.coalesce("related_node_ids", F.array().cast("array<string>"))))
    every = rounds.cut(insights.select("id", "type", F.struct("generated_at", "id").alias("rank"), nodes.alias("nodes")))
    spread = lambda t: t.select("type", F.explode("nodes").alias("node"), "rank", "id")
    live, led = every.filter(F.size("nodes") > 0), None
    while not live.isEmpty():
        on = spread(live)
        first = on.groupBy("type", "node").agg(F.min("rank").alias("first"))
        leads = on.join(first, ["type", "node"]).groupBy("id").agg(F.bool_and(F.col("rank") == F.col("first")).alias("leads")).filter("leads")
        new = rounds.cut(on.join(leads.select("id"), "id", "left_semi").select("type", "node", F.col("rank").alias("leader")))
        met = on.join(new, ["type", "node"], "left_semi").select("id").distinct()
        live = rounds.cut(live.join(met, "id", "left_anti"), live)
        led = new if led is None else led.unionAll(new)
    if led is None:
        return every.select("id", "type", F.col("id").alias("leader"))
    found = spread(every).join(led, ["type", "node"]).groupBy("id").agg(F.min("leader").alias("leader"))
    return every.join(found, "id", "left").select("id", "type", F.coalesce("leader.id", "id").alias("leader"))


def consolidate_all(insights: DataFrame, least: int = D.CONSOLIDATE_FROM) -> DataFrame:
    """Groups of group_greedily of at least `least` become one insight each; the others stay."""
    g = insights.join(group_greedily(insights).drop("type"), "id")
    n = g.groupBy("leader").agg(F.count("*").alias("k"), F.avg("confidence").alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("related_node_ids")))).alias("nodes"))
    j = g.join(n, "leader").filter((F.col("k") < least) | (F.col("id") == F.col("leader")))
    many = F.col("k") >= least
    return j.select(
        F.when(many, F.concat(F.lit("consolidated_"), "id")).otherwise(F.col("id")).alias("id"), "type", F.when(many, F.format_string("Consolidated: %d insights of %s", "k", "type")).otherwise(F.col("title")).alias("title"), "description",
        F.when(many, F.col("nodes")).otherwise(F.col("related_node_ids")).alias("related_node_ids"), F.when(many, F.least(F.col("c") + D.CONSOLIDATE_STEP * (F.col("k") - least), F.lit(1.0))).otherwise(F.col("confidence")).alias("confidence"), "severity", "generated_at",
    )


def decay(edges: DataFrame, now, access: Column | None = None, half_life_s: float = D.HALF_LIFE_S, least: float = D.MIN_WEIGHT) -> DataFrame:
    """edges with decayed_weight and is_weakened."""
    w = S.decayed(F.col("weight"), F.col("valid_from"), now, F.lit(0) if access is None else access, half_life_s, least)
    return edges.withColumn("decayed_weight", w).withColumn("is_weakened", F.col("decayed_weight") < D.WEAK_WEIGHT)


def resolve_conflicts(edges: DataFrame, losers: DataFrame, now, least: float = D.MIN_WEIGHT) -> DataFrame:
    """edges with those whose id losers has made weaker, less sure and ended now."""
    j = edges.join(losers.select("id", F.lit(True).alias("lost")), "id", "left")
    lost = F.coalesce("lost", F.lit(False))
    return j.withColumns({"weight": F.when(lost, F.greatest(F.col("weight") * 0.5, F.lit(least))).otherwise(F.col("weight")), "confidence": F.when(lost, F.col("confidence") * 0.8).otherwise(F.col("confidence")), "valid_to": F.when(lost, instant(now)).otherwise(F.col("valid_to"))}).drop("lost")


def conflicts(edges: DataFrame) -> DataFrame:
    """(from_node_id, to_node_id, type, n, n_conflicts): keys with versions that began at different times, and how many
    unordered pairs differ. Counted by key and start, not by joining versions."""
    by = edges.groupBy("from_node_id", "to_node_id", "type", "valid_from").agg(F.count("*").alias("c"))
    s = by.groupBy("from_node_id", "to_node_id", "type").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count("*").alias("starts"))
    return s.filter("starts > 1").select("from_node_id", "to_node_id", "type", "n", ((F.col("n") * F.col("n") - F.col("sq")) / 2).cast("long").alias("n_conflicts"))


STATE_HEALTH = {"Running": "Healthy", "Draining": "Degraded", "Drained": "Healthy", "Faulted": "Unhealthy"}


def store_health(state: str) -> str:
    return STATE_HEALTH[state]
