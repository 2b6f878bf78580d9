"""Property filters as columns. Comparisons with NaN are false, where Spark would rank NaN above all numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..defaults import EQUAL_TOLERANCE

PROPERTIES = {"HealthScore": "health_score", "FailureProb": "failure_prob", "ResourceStrain": "resource_strain", "PredictedLatencyMs": "predicted_latency_ms"}
OPERATORS = ("LessThan", "GreaterThan", "Equals")


def property_column(name: str) -> Column:
    """The column of a property; an unknown one is 0."""
    return F.col(PROPERTIES[name]) if name in PROPERTIES else F.lit(0.0)


@dataclass(frozen=True)
class PropertyFilter:
    name: str
    operator: str
    value: float

    def column(self) -> Column:
        p, v = property_column(self.name), float(self.value)
        if v != v:
            return F.lit(False)
        if self.operator == "LessThan":
            return p < v
        if self.operator == "GreaterThan":
            return (p > v) & ~F.isnan(p)
        # The bounds reach the Parquet scan; the difference decides.
        return p.between(v - 1.1 * EQUAL_TOLERANCE, v + 1.1 * EQUAL_TOLERANCE) & (F.abs(p - v) < EQUAL_TOLERANCE)


@dataclass(frozen=True)
class Both:
    left: PropertyFilter | Both | Either
    right: PropertyFilter | Both | Either

    def column(self) -> Column:
        return self.left.column() & self.right.column()


@dataclass(frozen=True)
class Either:
    left: PropertyFilter | Both | Either
    right: PropertyFilter | Both | Either

    def column(self) -> Column:
        return self.left.column() | self.right.column()
