"""Proper scores as Column expressions; every one stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.constants import INTERVAL_LEVELS, QUANTILE_LEVELS

_DENOMINATOR = len(INTERVAL_LEVELS) + 0.5


def _alpha(level: int) -> float:
    return round(1 - level / 100, 2)


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def interval_score(lower: Column, upper: Column, y: Column, alpha: float) -> Column:
    below = F.greatest(F.lit(0.0), lower - y)
    above = F.greatest(F.lit(0.0), y - upper)
    return F.when(y.isNotNull(), (upper - lower) + (2 / alpha) * below + (2 / alpha) * above)


def wis_from_intervals(y: Column) -> Column:
    """Weighted interval score of the wide columns of the current row."""
    parts = [
        (_alpha(level) / 2)
        * interval_score(F.col(f"lower_{level}"), F.col(f"upper_{level}"), y, _alpha(level))
        for level in INTERVAL_LEVELS
    ]
    return (0.5 * F.abs(y - F.col("pred")) + reduce(add, parts)) / _DENOMINATOR


def wis_from_quantiles(y: Column, quantiles: Column) -> Column:
    """The same score from the nine quantiles in an array, as a sum of pinball losses."""
    losses = [pinball(y, quantiles[i], tau) for i, tau in enumerate(QUANTILE_LEVELS)]
    return reduce(add, losses) / _DENOMINATOR


def dispersion(y: Column) -> Column:
    widths = [
        (_alpha(level) / 2) * (F.col(f"upper_{level}") - F.col(f"lower_{level}")) for level in INTERVAL_LEVELS
    ]
    return (0.5 * F.abs(y - F.col("pred")) + reduce(add, widths)) / _DENOMINATOR


def overprediction(y: Column) -> Column:
    parts = [F.greatest(F.lit(0.0), F.col(f"lower_{level}") - y) for level in INTERVAL_LEVELS]
    return F.when(y.isNotNull(), reduce(add, parts) / _DENOMINATOR)  # ``greatest`` passes over nulls


def underprediction(y: Column) -> Column:
    parts = [F.greatest(F.lit(0.0), y - F.col(f"upper_{level}")) for level in INTERVAL_LEVELS]
    return F.when(y.isNotNull(), reduce(add, parts) / _DENOMINATOR)


def covered(y: Column, level: int) -> Column:
    return (y >= F.col(f"lower_{level}")) & (y <= F.col(f"upper_{level}"))


def widening_needed(y: Column, level: int) -> Column:
    """Multiple of the half-width that would just reach ``y``; 0 when ``y`` equals the median."""
    floor = F.lit(1e-9)
    median = F.col("pred")
    return (
        F.when(y > median, (y - median) / F.greatest(F.col(f"upper_{level}") - median, floor))
        .when(y < median, (median - y) / F.greatest(median - F.col(f"lower_{level}"), floor))
        .otherwise(F.lit(0.0))
    )


def conformity(y: Column, lower: Column, upper: Column) -> Column:
    """Positive when ``y`` falls outside the interval, by how much."""
    return F.greatest(lower - y, y - upper)
