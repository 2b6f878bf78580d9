"""Defaults and thresholds, fixed by the semantics of the operators."""

from __future__ import annotations

from dataclasses import dataclass

PATH_DEPTH, TRAVERSE_DEPTH, TRAVERSE_LIMIT, EDGE_TYPE = 10, 3, 100, "DerivedFrom"
DEGRADED_HEALTH, WEAK_WEIGHT, EQUAL_TOLERANCE = 0.7, 0.3, 0.001
HEALTH_WEIGHTS, FULL_LATENCY_MS, FULL_STRAIN_EDGES, RETRY_BUDGET = (0.35, 0.35, 0.30), 1000.0, 100, 3
BOTTLENECK_LATENCY_MS, BOTTLENECK_HEALTH, INSIGHT_HEALTH_DROP = 500.0, 0.3, 0.1
CONFIDENCE_WEIGHTS, CONSOLIDATE_FROM, CONSOLIDATE_STEP = (0.4, 0.3, 0.3), 5, 0.1
HALF_LIFE_S, MIN_WEIGHT, ACCESS_FACTOR = 30 * 86400.0, 0.1, 0.1
PAGERANK = (0.85, 1e-6, 100)
CLUSTER_PASSES, CLUSTER_GAIN = 10, 0.001
EMA_ALPHA, HLL_PRECISION, AGENT_SECONDS = 0.2, 12, 30
METRICS_BUFFER = 10_000
#: Graphs of at most so many edges are solved in one task where levels, not data, would make the jobs.
LOCAL_EDGES = 500_000
#: A search by joins from many sources takes so many that it reaches about so many pairs of source and node at once.
SEARCH_ROWS = 200_000_000


@dataclass(frozen=True)
class EngineConfig:
    """How a store is opened (by path, or in memory without one), how many files of metrics a trigger takes in at most,
    and whether nodes without type are classified."""

    path: str | None = None
    metrics_files_per_trigger: int = 100
    auto_classify: bool = False
