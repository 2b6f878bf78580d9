"""A store of graph tables: append-only logs, of which the latest row of a key is current."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import defaults as D
from ..diagnostics import EngineMetrics
from ..functions.classify import node_type
from ..functions.temporal import as_of, instant
from ..operators.query import GraphQuery
from ..plans.loop import drop_dir, shared_dir
from ..schema import EDGE, EDGE_DEFAULTS, EDGE_TYPES, INSIGHT, INSIGHT_TYPES, METRIC, NODE, NODE_DEFAULTS, SCHEMA_VERSION, SEVERITIES

NODE_KEY, EDGE_KEY = ("id",), ("from_node_id", "to_node_id", "type")
LOG = "deleted boolean, log_seq bigint, row_no bigint"
SCHEMAS = {"nodes": f"{NODE}, {LOG}", "edges": f"{EDGE}, {LOG}", "insights": INSIGHT, "metrics": METRIC}


def completed(df: DataFrame, defaults: dict[str, str], schema: str, now) -> DataFrame:
    """df with the columns of the schema, defaults for those it lacks."""
    at = f"timestamp_ntz '{now}'"
    for name, sql in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(sql.replace("{now}", at)))
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted))


def latest(log: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The last row of each key by (tx_time, log_seq, row_no), without deleted ones. An aggregate: rows are combined before
    the shuffle, which a window over the key wouldn't do."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("tx_time", "log_seq", "row_no")).alias("r")).select(*key, "r.*")
    return last.filter("not deleted").drop("deleted", "log_seq", "row_no")


class Drained(RuntimeError):
    """The store takes no more writes."""


class GraphStore:
    """Logs of nodes, edges, insights and metrics as Parquet folders. A write appends one batch; nothing is overwritten, so
    an older transaction time can be read again. Every clock is an argument. A store is Running, Draining while it waits
    for the streams attached to it, Drained when it takes no more writes, and Faulted after a write that failed."""

    def __init__(self, spark: SparkSession, path: str | None = None, auto_classify: bool = False):
        self.spark, self.path, self.auto_classify = spark, path or shared_dir(spark, "store"), auto_classify
        self.state, self.serial = "Running", 0
        self.metrics, self.streams = EngineMetrics(), []

    @classmethod
    def from_config(cls, spark: SparkSession, config: D.EngineConfig) -> GraphStore:
        """What the configuration opens: a store at its path, or one in memory."""
        return cls.open(spark, config.path, auto_classify=config.auto_classify) if config.path else cls.in_memory(spark, auto_classify=config.auto_classify)

    @classmethod
    def in_memory(cls, spark: SparkSession, **options) -> GraphStore:
        return cls(spark, None, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> GraphStore:
        """A store at a path, with what it held. Rows keep their versions."""
        store = cls(spark, path, **options)
        for name in ("nodes", "edges"):
            if store._exists(name):
                store.serial = max(store.serial, (store._log(name).agg(F.max("log_seq")).first()[0] or 0))
        return store

    @classmethod
    def from_dataframes(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame, now: datetime | str, **options) -> GraphStore:
        store = cls(spark, None, **options)
        store.upsert_nodes(nodes, now)
        store.upsert_edges(edges, now)
        return store

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _log(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, df: DataFrame, deleted: bool = False) -> None:
        """Appends a batch. Its rows are counted by the write itself; a row's place in the batch tells equal keys apart."""
        if self.state not in (("Running", "Draining") if name == "metrics" else ("Running",)):
            raise Drained(f"the store is {self.state}")
        if name in ("nodes", "edges"):
            self.serial += 1
            df = df if "row_no" in df.columns else df.withColumn("row_no", F.monotonically_increasing_id())
            df = df.withColumns({"deleted": F.lit(deleted), "log_seq": F.lit(self.serial).cast("long")})
        seen = Observation()
        try:
            with self.metrics.span(self.spark, f"Delete.{name}" if deleted else f"Write.{name}"):
                df.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(f"{self.path}/{name}")
        except Exception:
            self.state = "Faulted"
            raise
        self.metrics.add(f"{name}.{'deleted' if deleted else 'written'}", seen.get["n"])

    def nodes(self) -> DataFrame:
        return latest(self._log("nodes"), NODE_KEY)

    def edges(self) -> DataFrame:
        return latest(self._log("edges"), EDGE_KEY)

    def open_nodes(self) -> DataFrame:
        """Current nodes whose validity hasn't ended: what a reload of the store takes up."""
        return self.nodes().filter("valid_to is null")

    def at_transaction(self, t: datetime | str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as they were recorded at t."""
        then = lambda name: self._log(name).filter(F.col("tx_time") <= instant(t))
        return latest(then("nodes"), NODE_KEY), latest(then("edges"), EDGE_KEY)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes().filter(F.col("id") == node_id)

    def query(self) -> GraphQuery:
        return GraphQuery(self.nodes(), self.edges(), insight_table=self.insights(), metrics=self.metrics)

    def upsert_nodes(self, df: DataFrame, now: datetime | str) -> None:
        """Appends nodes with their version raised by one and now as their transaction time. The last of equal ids wins.
        Nodes without type are classified if the store does that."""
        df = completed(df, NODE_DEFAULTS, NODE, now).withColumns({"version": F.col("version") + 1, "tx_time": instant(now)})
        if self.auto_classify:
            df = df.withColumn("type", F.when(F.coalesce("type", F.lit("")) == "", node_type(F.col("properties"))).otherwise(F.col("type")))
        self._append("nodes", df.filter("id is not null"))

    def delete_nodes(self, ids: DataFrame, now: datetime | str) -> None:
        """Deletes nodes and all edges at either end."""
        gone = ids.select("id").distinct()
        edges = self.edges()
        ends = edges.join(gone.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").unionByName(edges.join(gone.withColumnRenamed("id", "to_node_id"), "to_node_id", "left_semi")).dropDuplicates(list(EDGE_KEY))
        nodes = self.nodes().join(gone, "id", "left_semi")
        if self._exists("edges"):
            self._append("edges", ends.select(*self.edges().columns).withColumn("tx_time", instant(now)), deleted=True)
        self._append("nodes", nodes.select(*self.nodes().columns).withColumn("tx_time", instant(now)), deleted=True)

    def upsert_edges(self, df: DataFrame, now: datetime | str) -> None:
        """Appends edges; the key is (from, to, type), of equal ones the last wins. A key keeps the place (seq) of its first
        insertion; ids are new each time: hashes of key and write."""
        df = completed(df, EDGE_DEFAULTS, EDGE, now)
        if not df.filter(~F.col("type").isin(*EDGE_TYPES)).isEmpty():
            raise ValueError(f"edge types are {EDGE_TYPES}")
        columns, df = df.columns, df.withColumn("row_no", F.monotonically_increasing_id())
        old = self.edges().select(*EDGE_KEY, F.col("seq").alias("was"))
        base = (self.serial + 1) << 40
        placed = df.withColumn("seq", F.coalesce("seq", F.lit(base) + F.col("row_no")))
        fresh = placed.join(old, list(EDGE_KEY), "left").withColumn("seq", F.coalesce("was", "seq")).drop("was")
        fresh = fresh.withColumns({"id": F.coalesce("id", F.xxhash64(*EDGE_KEY, F.lit(base))), "tx_time": instant(now)})
        self._append("edges", fresh.select(*columns, "row_no"))

    def delete_edge(self, edge_id: int, now: datetime | str) -> None:
        self._append("edges", self.edges().filter(F.col("id") == edge_id).withColumn("tx_time", instant(now)), deleted=True)

    def update_node_health(self, updates: DataFrame, now: datetime | str) -> None:
        """updates: (id, health_score, failure_prob, predicted_latency_ms, resource_strain, expected_version). Raises if a
        version isn't the expected one, writing nothing; unknown nodes are passed over; versions stay."""
        u = updates.select("id", *(F.col(c).alias(f"new_{c}") for c in ("health_score", "failure_prob", "predicted_latency_ms", "resource_strain")), "expected_version")
        j = self.nodes().join(u, "id")
        if not j.filter("version <> expected_version").isEmpty():
            raise ValueError("version mismatch: the node changed since it was read")
        new = j.withColumns({c: F.col(f"new_{c}") for c in ("health_score", "failure_prob", "predicted_latency_ms", "resource_strain")} | {"tx_time": instant(now)})
        self._append("nodes", new.select(*self.nodes().columns))

    def insert_insights(self, df: DataFrame) -> None:
        """Appends insights as they are; types and severities are of a fixed set."""
        if not df.filter(~F.col("type").isin(*INSIGHT_TYPES) | ~F.col("severity").isin(*SEVERITIES)).isEmpty():
            raise ValueError(f"insight types are {INSIGHT_TYPES}, severities {SEVERITIES}")
        self._append("insights", df.select(*(c.split()[0] for c in INSIGHT.split(", "))))

    def insert_metrics(self, df: DataFrame) -> None:
        """Appends entries (node_id, ts, values); taken while draining too, as the last ones come then."""
        self._append("metrics", df.select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "values"))

    def metric_entries(self) -> DataFrame:
        return self._log("metrics")

    def insights(self, insight_type: str | None = None, limit: int | None = None) -> DataFrame:
        """Insights as they are; pseudo_edges gives them as edges."""
        out = self._log("insights")
        out = out if insight_type is None else out.filter(F.col("type") == insight_type)
        return out if limit is None else out.orderBy("generated_at", "id").limit(limit)

    def weakened_edges(self, node_id: str) -> DataFrame:
        return weakened_edges(self.edges(), node_id)

    def degraded_nodes(self) -> DataFrame:
        return degraded_nodes(self.nodes())

    def as_of(self, t: datetime | str) -> GraphQuery:
        """A query over what was valid at t, for traversals too."""
        return GraphQuery(self.nodes().filter(as_of(t)), self.edges().filter(as_of(t, closed=False)), insight_table=self.insights(), metrics=self.metrics)

    def compact(self, path: str | None = None, drop: bool = False) -> GraphStore:
        """A new store of the current rows alone. drop: this one is drained, and its logs are deleted once the new one is
        whole."""
        out = GraphStore(self.spark, path, self.auto_classify)
        for name in ("nodes", "edges", "insights", "metrics"):
            if self._exists(name):
                out._append(name, {"nodes": self.nodes, "edges": self.edges}.get(name, lambda name=name: self._log(name))())
        if drop:
            self.drain()
            drop_dir(self.spark, self.path)
        return out

    def attach(self, stream) -> None:
        """A streaming query that drain stops."""
        self.streams.append(stream)

    def drain(self) -> None:
        """Lets attached streams end what they have begun, stops them, and takes no more writes."""
        if self.state != "Running":
            return
        self.state = "Draining"
        for s in self.streams:
            s.stop()
        self.streams = []
        self.state = "Drained"

    def fault(self) -> None:
        self.state = "Faulted"

    def close(self, drop: bool = False) -> None:
        """Drains; drop deletes the logs too."""
        self.drain()
        if drop:
            drop_dir(self.spark, self.path)

    def manifest(self) -> str:
        return json.dumps({"schema_version": SCHEMA_VERSION, "path": self.path, "state": self.state})


def weakened_edges(edges: DataFrame, node_id: str, limit: float = D.WEAK_WEIGHT) -> DataFrame:
    return edges.filter((F.col("from_node_id") == node_id) & (F.col("weight") < limit))


def degraded_nodes(nodes: DataFrame, limit: float = D.DEGRADED_HEALTH) -> DataFrame:
    return nodes.filter((F.col("health_score") < limit) & F.col("valid_to").isNull()).orderBy("health_score", "id")


def pseudo_edges(insights: DataFrame) -> DataFrame:
    """Insights as edges from their first node."""
    return insights.select(F.get("related_node_ids", F.lit(0)).alias("from_node_id"), F.col("id").alias("to_node_id"), F.lit("FeedsInto").alias("type"), F.col("confidence").alias("weight"))


def steps_json(steps: Column) -> Column:
    return F.to_json(steps)


def properties_json(properties: Column) -> Column:
    return F.to_json(properties)
