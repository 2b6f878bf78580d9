"""What an engine counts of itself: rows written, queries built, the time of store operations; and cancelling of jobs."""

from __future__ import annotations

import time
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Operations whose times are kept for each name; older ones go.
KEPT_SPANS = 10_000


class EngineMetrics:
    """Counters and times of one store. All are numbers on the driver; none needs a job of its own."""

    def __init__(self):
        self.counters: Counter[str] = Counter()
        self.spans: deque[tuple[str, float]] = deque(maxlen=KEPT_SPANS)

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    @contextmanager
    def span(self, spark: SparkSession, name: str) -> Iterator[None]:
        """Jobs inside carry the name as their description, and the time is kept."""
        sc = spark.sparkContext
        was, began = sc.getLocalProperty("spark.job.description"), time.monotonic()
        sc.setLocalProperty("spark.job.description", name)
        try:
            yield
        finally:
            sc.setLocalProperty("spark.job.description", was)
            self.spans.append((name, 1000 * (time.monotonic() - began)))
            self.add(f"events.{name}")

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, value): the counters and, of the times, each operation's mean in milliseconds."""
        rows = [(k, float(v)) for k, v in sorted(self.counters.items())]
        for name in sorted({n for n, _ in self.spans}):
            own = [ms for n, ms in self.spans if n == name]
            rows.append((f"latency_ms.{name}", sum(own) / len(own)))
        return spark.createDataFrame(rows, "name string, value double")


class Cancellation:
    """A token: jobs started inside `with token:` end with an error when any thread calls cancel()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"tempograph-{uuid.uuid4().hex[:12]}", False

    def __enter__(self) -> Cancellation:
        self.raise_if_cancelled()
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, *error) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def raise_if_cancelled(self) -> None:
        if self.cancelled:
            raise RuntimeError("cancelled")
