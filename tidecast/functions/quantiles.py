"""Expressions on quantile vectors, kept as ARRAY<DOUBLE> in ascending level order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.constants import INTERVAL_LEVELS, QUANTILE_COLUMNS, QUANTILE_LEVELS

MEDIAN_SLOT = QUANTILE_LEVELS.index(0.5)


def wide_array() -> Column:
    """The nine wide columns of the current row as one array."""
    return F.array(*[F.col(c) for c in QUANTILE_COLUMNS])


def spread(quantiles: Column) -> list[Column]:
    """The nine wide columns from an array."""
    return [quantiles[i].alias(c) for i, c in enumerate(QUANTILE_COLUMNS)]


def to_wide(df: DataFrame, column: str = "q") -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], *spread(F.col(column)))


def to_long(df: DataFrame, column: str = "q") -> DataFrame:
    """One row per level."""
    levels = F.array(*[F.lit(v) for v in QUANTILE_LEVELS])
    pairs = F.arrays_zip(levels.alias("quantile_level"), F.col(column).alias("predicted_value"))
    return df.select(*[c for c in df.columns if c != column], F.inline(pairs).alias("quantile_level", "predicted_value"))


def rearrange(df: DataFrame) -> DataFrame:
    """Sort the nine wide values of each row and hand them back in level order."""
    return to_wide(df.withColumn("q", F.array_sort(wide_array())).drop(*QUANTILE_COLUMNS))


def needs_reordering() -> Column:
    return wide_array() != F.array_sort(wide_array())


def floor_zero(x: Column) -> Column:
    """``max(0, x)`` that keeps missing values missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def shift_floor(quantiles: Column, centre: Column) -> Column:
    """Add a centre to every quantile and cut at zero."""
    return F.transform(quantiles, lambda v: F.greatest(v + centre, F.lit(0.0)))


def mean_centred(quantiles: Column, mean: Column) -> Column:
    """Put the mean in the median slot and push the neighbours outward so the vector stays ordered."""
    upper = [
        reduce(lambda a, b: F.greatest(a, b), [mean] + [quantiles[j] for j in range(MEDIAN_SLOT + 1, i + 1)])
        for i in range(MEDIAN_SLOT + 1, len(QUANTILE_LEVELS))
    ]
    lower = [
        reduce(lambda a, b: F.least(a, b), [mean] + [quantiles[j] for j in range(i, MEDIAN_SLOT)])
        for i in range(MEDIAN_SLOT)
    ]
    return F.transform(F.array(*lower, mean, *upper), lambda v: F.greatest(v, F.lit(0.0)))


def blend(weight: Column, first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: weight * a + (1 - weight) * b)


def widen(factors: dict[int, Column]) -> list[Column]:
    """Interval bounds moved about the median by one factor per level; the median stays."""
    out = []
    for name in QUANTILE_COLUMNS:
        if name == "pred":
            out.append(F.col("pred"))
            continue
        side, level = name.split("_")
        s = factors[int(level)]
        if side == "upper":
            out.append((F.col("pred") + s * (F.col(name) - F.col("pred"))).alias(name))
        else:
            out.append((F.col("pred") - s * (F.col("pred") - F.col(name))).alias(name))
    return out


def widen_log(shifts: dict[int, Column]) -> list[Column]:
    """Additive widening in log1p space, lower bounds cut at zero."""
    out = [F.col("pred")]
    for level in INTERVAL_LEVELS:
        lo, hi = F.col(f"lower_{level}"), F.col(f"upper_{level}")
        out.append(F.expm1(F.greatest(F.lit(0.0), F.log1p(lo) - shifts[level])).alias(f"lower_{level}"))
        out.append(F.expm1(F.log1p(hi) + shifts[level]).alias(f"upper_{level}"))
    return out
