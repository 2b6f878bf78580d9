"""Health, bottleneck and decay arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D
from .temporal import instant, seconds_between


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def health_score(failure: Column, latency_ms: Column, strain: Column, weights: tuple[float, float, float] = D.HEALTH_WEIGHTS) -> Column:
    """1 less the weighted failure rate, latency (full at a second) and strain. Weights must sum to 1."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("health weights must sum to 1")
    f, lat, s = weights
    return clamp(1 - (f * failure + lat * F.least(latency_ms / D.FULL_LATENCY_MS, F.lit(1.0)) + s * strain))


def strain(weak_edges: Column) -> Column:
    return F.least(F.coalesce(weak_edges, F.lit(0)) / float(D.FULL_STRAIN_EDGES), F.lit(1.0))


def is_bottleneck(latency_ms: Column, score: Column, latency_limit: float = D.BOTTLENECK_LATENCY_MS, health_limit: float = D.BOTTLENECK_HEALTH) -> Column:
    return (latency_ms > latency_limit) | (score < health_limit)


def bottleneck_confidence(health_drop: Column, latency_rise: Column, failure: Column) -> Column:
    a, b, c = D.CONFIDENCE_WEIGHTS
    return F.least(a * F.greatest(health_drop, F.lit(0.0)) + b * F.greatest(latency_rise / 1000.0, F.lit(0.0)) + c * failure, F.lit(1.0))


def time_to_impact_ms(current: Column, before: Column, seconds: Column, limit: float = D.BOTTLENECK_LATENCY_MS) -> Column:
    """Until latency reaches the limit at its present rise; infinite if it doesn't rise, negative if it is there."""
    speed = F.try_divide(current - before, seconds)
    return F.when((seconds > 0) & (current > before), F.try_divide(limit - current, speed) * 1000.0).otherwise(F.lit(float("inf")))


def decayed(weight: Column, since: Column, now, access: Column, half_life_s: float = D.HALF_LIFE_S, least: float = D.MIN_WEIGHT) -> Column:
    """An edge's weight, halved each half-life, which grows by a tenth with each access."""
    age = seconds_between(since, instant(now))
    return F.greatest(weight * F.pow(F.lit(0.5), age / (half_life_s * (1 + D.ACCESS_FACTOR * access))), F.lit(least))


def double_ema(history: Column, alpha: float = D.EMA_ALPHA) -> Column:
    """Brown's double smoothing, one step ahead, over an array of numbers in order; 0 of none."""
    first = F.struct(F.get(history, F.lit(0)).alias("a"), F.get(history, F.lit(0)).alias("b"))
    rest = F.slice(history, 2, F.greatest(F.size(history) - 1, F.lit(0)))

    def step(s, x):
        a = alpha * x + (1 - alpha) * s["a"]
        return F.struct(a.alias("a"), (alpha * a + (1 - alpha) * s["b"]).alias("b"))

    ahead = lambda s: 2 * s["a"] - s["b"] + alpha / (1 - alpha) * (s["a"] - s["b"])
    return F.when(F.size(history) > 0, F.aggregate(rest, first, step, ahead)).otherwise(F.lit(0.0))
