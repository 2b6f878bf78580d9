"""Node metrics as a stream: running health of each node, and the periodic agent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import defaults as D
from ..functions import scores as S
from ..operators import health
from ..plans.loop import shared_dir, stored
from ..schema import METRIC
from ..sources.store import GraphStore

STATE = "n long, failed long, a double, b double, seen boolean"
OUT = "node_id string, n long, failed long, predicted_latency_ms double"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts and the two averages of a node; its history isn't kept. Entries of a batch are taken in the order of time;
    those that come in a later batch than younger ones are taken when they come."""
    n, failed, a, b, seen = state.get if state.exists else (0, 0, 0.0, 0.0, False)
    rows = pd.concat(list(batches)).sort_values(["ts", "latency"])
    for latency, bad in zip(rows["latency"], rows["failed"], strict=True):
        n, failed = n + 1, failed + int(bad > 0)
        if latency == latency:
            a = D.EMA_ALPHA * latency + (1 - D.EMA_ALPHA) * a if seen else latency
            b = D.EMA_ALPHA * a + (1 - D.EMA_ALPHA) * b if seen else latency
            seen = True
    state.update((n, failed, a, b, seen))
    ahead = 2 * a - b + D.EMA_ALPHA / (1 - D.EMA_ALPHA) * (a - b) if seen else 0.0
    yield pd.DataFrame({"node_id": [key[0]], "n": [n], "failed": [failed], "predicted_latency_ms": [ahead]})


def metrics_stream(spark: SparkSession, path: str, config: D.EngineConfig | None = None) -> DataFrame:
    """A stream of the metric entries that are added to a folder of Parquet files. A trigger takes a bounded number of
    files, the others wait: nothing is dropped when entries come faster than they are taken in."""
    return spark.readStream.schema(METRIC).option("maxFilesPerTrigger", (config or D.EngineConfig()).metrics_files_per_trigger).parquet(path)


def running_health(metrics: DataFrame) -> DataFrame:
    """A stream of (node_id, n, failed, predicted_latency_ms) from one of (node_id, ts, values): a row for each node that a
    trigger touches."""
    rows = metrics.select("node_id", "ts", F.col("values")["AvgLatencyMs"].alias("latency"), F.coalesce(F.col("values")["ItemsFailed"], F.lit(0.0)).alias("failed"))
    return rows.groupBy("node_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def consume(spark: SparkSession, metrics: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Runs a metrics stream over what is there and gives the last health of each node."""
    out, checkpoint = shared_dir(spark, "running"), shared_dir(spark, "running-state")

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{out}/batch={batch}")

    running_health(metrics).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{OUT}, batch long").option("basePath", out).parquet(out)
    last = rows.groupBy("node_id").agg(F.max_by(F.struct("n", "failed", "predicted_latency_ms"), "batch").alias("r")).select("node_id", "r.*")
    weak = health.weak_out_edges(edges) if edges is not None else spark.createDataFrame([], "node_id string, weak_edges long")
    j = last.join(weak, "node_id", "left").withColumn("resource_strain", S.strain(F.col("weak_edges"))).withColumn("failure_prob", F.col("failed") / F.col("n"))
    return j.select("node_id", "n", "failure_prob", "predicted_latency_ms", "resource_strain", S.health_score(F.col("failure_prob"), F.col("predicted_latency_ms"), F.col("resource_strain")).alias("health_score"))


def apply_health(store: GraphStore, vectors: DataFrame, now) -> None:
    """Writes vectors to their nodes; unknown ones are passed over."""
    versions = store.nodes().select("id", F.col("version").alias("expected_version"))
    store.update_node_health(vectors.withColumnRenamed("node_id", "id").join(versions, "id"), now)


def agent_round(store: GraphStore, history: DataFrame, now, limit: float = D.DEGRADED_HEALTH) -> DataFrame:
    """One round of the agent: degraded nodes against their history; insights, consolidated with those there, are stored
    and given back."""
    nodes = store.nodes().filter(F.col("health_score") < limit)
    current = nodes.select(F.col("id").alias("node_id"), F.lit(str(now)).cast("timestamp_ntz").alias("ts"), "health_score", "predicted_latency_ms", "failure_prob")
    new, _ = stored(health.consolidate(health.insights_of(health.predict_bottlenecks(current, history), now), store.insights()), "agent")
    store.insert_insights(new)
    return new


def agent_stream(store: GraphStore, ticks: DataFrame, history: DataFrame, clock, checkpoint: str):
    """The agent every 30 seconds, driven by a stream of ticks."""
    return ticks.writeStream.foreachBatch(lambda df, _: agent_round(store, history, clock())).option("checkpointLocation", checkpoint).trigger(processingTime=f"{D.AGENT_SECONDS} seconds").start()
