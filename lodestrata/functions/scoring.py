"""Scores, ages and estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking and relevance formulas.
RANKING = {"semantic": 0.35, "graph": 0.25, "recency": 0.20, "importance": 0.15, "feedback": 0.05}
RELEVANCE = {"usage": 0.4, "recency": 0.3, "centrality": 0.2, "success": 0.1}
KEYWORD_SCORE = 0.5
HALF_LIFE_DAYS = 14.0
USAGE_FULL, CENTRALITY_FULL = 32, 16


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum, term by term in the order of the weights, clipped to 0..1."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    total = None
    for name, w in weights.items():
        term = F.lit(w) * values[name]
        total = term if total is None else total + term
    return clip(total)


def recency(age_days: Column, half_life: float) -> Column:
    if half_life <= 0:
        return F.lit(0.0)
    return F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / F.lit(half_life)))


def saturating(count: Column, full: int) -> Column:
    return F.sqrt(F.least(count.cast("double"), F.lit(float(full))) / F.lit(float(full)))


def proximity(depth: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + depth)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; null if the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def severity(x: Column, low: float = 0.05, medium: float = 0.20, high: float = 0.50) -> Column:
    return F.when(x >= high, "CRITICAL").when(x >= medium, "HIGH").when(x >= low, "MEDIUM").otherwise("LOW")


#: What a severity calls for.
ACTIONS = {
    "LOW": "within tolerance — no action",
    "MEDIUM": "monitor; schedule a refresh on next idle cycle",
    "HIGH": "trigger Phase-6 refresh for affected entities",
    "CRITICAL": "ESCALATE — full re-index recommended",
}


def action(severity: Column, what: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, value in ACTIONS.items():
        text = F.when(severity == name, value).otherwise(text)
    return F.concat(what, F.lit(": "), text)


def list_repr_length(items: Column) -> Column:
    """Characters of a list of strings as quoted text in brackets."""
    n = F.size(items)
    inside = F.aggregate(items, F.lit(0), lambda s, x: s + F.length(x) + 2)
    return F.when(n == 0, 2).otherwise(inside + 2 * (n - 1) + 2)


def pressure(queue_share: Column, inflight_share: Column, queue_limit: float = 0.8, inflight_limit: float = 0.9) -> Column:
    """Levels 0 to 3 by how far either share is over its limit."""
    over = F.greatest(queue_share / queue_limit, inflight_share / inflight_limit)
    return F.when(over >= 2, 3).when(over >= 1.5, 2).when(over >= 1, 1).otherwise(0)


def backoff_ms(attempt: Column, base: float = 50.0, factor: float = 2.0) -> Column:
    return F.lit(base) * F.pow(F.lit(factor), attempt)
