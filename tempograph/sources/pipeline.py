"""Graphs as sources and sinks of ETL jobs. A job's result has is_success, value (a struct) and error."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import defaults as D
from ..schema import METRIC
from .store import GraphStore

#: The name under which a stream's results are counted.
WATCH = "tempograph"


def graph_source(store: GraphStore, node_type: str | None = None) -> DataFrame:
    nodes = store.nodes()
    return nodes if node_type is None else nodes.filter(F.col("type") == node_type)


def good_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("is_success") & F.col("value").isNotNull())


def graph_sink(results: DataFrame, store: GraphStore, to_node: dict[str, Column], now) -> None:
    """Writes a node for each success; failures are passed over. Streams too, batch by batch: see sink_stream."""
    store.upsert_nodes(good_rows(results).select(*(c.alias(n) for n, c in to_node.items())), now)


def watched(results: DataFrame) -> DataFrame:
    """results, with failures counted as they pass, for a PipelineMonitor to read."""
    return results.observe(WATCH, F.count_if(~F.coalesce("is_success", F.lit(False))).alias("failed"))


def sink_stream(results: DataFrame, store: GraphStore, to_node: dict[str, Column], clock: Callable[[], str], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """graph_sink of a stream's batches, over what there is; a batch that is run again writes the same nodes again."""
    writer = watched(results).writeStream.foreachBatch(lambda df, _: graph_sink(df, store, to_node, clock())).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def emit_edges(rows: DataFrame, store: GraphStore, to_edge: dict[str, Column], now) -> DataFrame:
    """Writes an edge for each row and gives the rows back."""
    store.upsert_edges(rows.select(*(c.alias(n) for n, c in to_edge.items())), now)
    return rows


class PipelineMonitor(StreamingQueryListener):
    """Watches one streaming query for a store: the query is a node of its own, what its progress says are that node's
    metrics, and the store is drained when that query ends (faulted if it fails). Other queries of the session are passed
    over. Entries wait in a buffer of fixed size, the oldest going first, until flush writes them to the store."""

    def __init__(self, store: GraphStore, source: str, sink: str, clock: Callable[[], str], capacity: int = D.METRICS_BUFFER):
        self.store, self.node_id, self.clock = store, f"pipeline_{source}_{sink}", clock
        self.entries: deque[tuple] = deque(maxlen=capacity)
        self.query_id: str | None = None
        self.early: dict[str, list] = {}
        self.ended, self.error, self.lock = threading.Event(), None, threading.Lock()

    def register(self) -> None:
        spark = self.store.spark
        self.store.upsert_nodes(spark.createDataFrame([(self.node_id, "Pipeline", self.node_id)], "id string, type string, label string"), self.clock())

    def watch(self, start: Callable[[], StreamingQuery]) -> StreamingQuery:
        """Registers the node, starts the query and follows it. What its events say before its id is known is kept."""
        self.register()
        self.store.spark.streams.addListener(self)
        query = start()
        with self.lock:
            self.query_id = query.id
            for handle, event in self.early.pop(query.id, []):
                handle(event)
            self.early.clear()
        return query

    def finish(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Waits for the query's end and for the events of it, writes its metrics, and drains or faults the store."""
        try:
            query.awaitTermination()
        except Exception as e:
            self.error = self.error or str(e)
        self.ended.wait(seconds)
        self.store.spark.streams.removeListener(self)
        self.flush()
        self.store.fault() if self.error else self.store.drain()

    def flush(self) -> None:
        rows = []
        while self.entries:
            rows.append(self.entries.popleft())
        if rows:
            self.store.insert_metrics(self._table(rows))

    def _table(self, rows: list[tuple]) -> DataFrame:
        return self.store.spark.createDataFrame(rows, METRIC.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def metrics(self) -> DataFrame:
        """What is written and what still waits."""
        return self.store.metric_entries().filter(F.col("node_id") == self.node_id).unionByName(self._table(list(self.entries)))

    def _own(self, query_id, handle, event) -> None:
        with self.lock:
            if self.query_id is None:
                self.early.setdefault(str(query_id), []).append((handle, event))
            elif str(query_id) == self.query_id:
                handle(event)

    def _progressed(self, event) -> None:
        p = event.progress
        n, ms = float(p.numInputRows), float((p.durationMs or {}).get("triggerExecution", 0))
        seen = (p.observedMetrics or {}).get(WATCH)
        self.entries.append((self.node_id, self.clock(), {"ItemsProcessed": n, "ItemsFailed": float(seen["failed"]) if seen is not None else 0.0, "AvgLatencyMs": ms / max(n, 1.0), "SmoothThroughput": float(p.processedRowsPerSecond or 0)}))

    def _terminated(self, event) -> None:
        self.error = self.error or event.exception
        self.ended.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._own(event.progress.id, self._progressed, event)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._own(event.id, self._terminated, event)
