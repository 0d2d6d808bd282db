"""Numeric scalars as Column functions: curves, ladders and clamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column, default: float = 0.0) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def logistic(x: Column, middle: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(x - middle) / scale))


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str | None) -> Column:
    """The name of the first threshold (highest first) that x reaches."""
    out = F.lit(otherwise)
    for limit, name in sorted(steps):
        out = F.when(x >= limit, name).otherwise(out)
    return out


#: Thresholds and names, and weights by category.
PRIORITY = [(2.0, "Critical"), (1.5, "High"), (1.0, "Medium"), (0.5, "Low")]
COMPLEXITY = [(25.0, "Critical"), (15.0, "High"), (10.0, "Moderate")]


def priority(score: Column) -> Column:
    return ladder(F.abs(score), PRIORITY, "None")


#: Words in a feature's name, in the order in which they are tried.
CATEGORIES = [
    ("complexity", ("cyclomatic", "cognitive", "complexity")),
    ("graph", ("betweenness", "centrality", "fan_")),
    ("structure", ("structure", "class", "method", "function", "directory", "lines_of_code", "nesting")),
    ("style", ("style", "naming", "format")),
    ("coverage", ("coverage", "test")),
]
WEIGHTS = {"complexity": 1.0, "graph": 0.8, "structure": 0.9, "style": 0.5, "coverage": 0.7, "other": 1.0}


def category(feature: Column) -> Column:
    out = F.lit("other")
    for name, words in reversed(CATEGORIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | feature.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def weight(cat: Column) -> Column:
    out = F.lit(1.0)
    for name, w in WEIGHTS.items():
        out = F.when(cat == name, w).otherwise(out)
    return out


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def lognormal_parameters(mode: float, p95: float) -> tuple[float, float]:
    """mu and sigma of the log-normal distribution with this mode and 95th percentile."""
    s = (-1.645 + math.sqrt(1.645**2 + 4 * math.log(p95 / mode))) / 2
    return math.log(mode) + s * s, s


def lognormal_health(x: Column, mode: float, p95: float) -> Column:
    """One minus the log-normal distribution function; 1 at or below zero."""
    mu, s = lognormal_parameters(mode, p95)
    cdf = 0.5 * (1 + erf((F.ln(x) - mu) / (s * math.sqrt(2))))
    return F.when(x <= 0, 1.0).otherwise(1 - cdf)


def lognormal_density(x: Column, mode: float, p95: float) -> Column:
    """The log-normal density at x over that at its mode, within [0, 1]; 0 where x, the mode or the spread is none, but 1 at the mode."""
    if mode <= 0 or p95 <= mode:
        return F.when(x == mode, 1.0).otherwise(0.0)
    mu, s = lognormal_parameters(mode, p95)
    centred = F.ln(F.when(x > 0, x)) - mu
    d = mode / F.when(x > 0, x) * F.exp(-0.5 * (centred * centred - s**4) / (s * s))
    return F.when(x > 0, F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
