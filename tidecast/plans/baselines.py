"""Statistical forecasters. Each takes a dense series and the fold table and forecasts every fold at once.

The series stays partitioned by geo from densification onward: all group keys contain geo, so windows and
aggregates below it add no exchange. A row enters the span between two cut-offs once (``folds.Nested``) and all folds are
told apart only in the fitted state. The fold calendar (about 52 rows a fold) is the only broadcast side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import MAX_HORIZON, QUANTILE_LEVELS
from tidecast.functions import calendar as cal
from tidecast.functions import quantiles as qt
from tidecast.operators import folds as fo
from tidecast.operators import order_stats as os_

KEYS = ["fold_id", "geo"]


def zeros() -> Column:
    return F.array(*[F.lit(0.0) for _ in QUANTILE_LEVELS])


def on_grid(fitted: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fitted state per (fold, geo) onto every target week of the fold."""
    return fitted.join(F.broadcast(calendar), "fold_id").withColumn("epiweek", cal.epi_week(F.col("date")))


def forecast_columns(df: DataFrame, name: str, q) -> DataFrame:
    return df.select(
        F.lit(name).alias("model"), "fold_id", "geo", "date", "origin_date", "horizon_weeks", q.alias("q")
    )


def step_differences(series: DataFrame, first: int = 1, last: int = MAX_HORIZON + 1) -> DataFrame:
    """geo, h, diff, date: all h-step differences, with the date of the later week, which a fold must have seen.

    The next values of each week come from one window frame, so no self-join is needed.
    """
    ahead = W.partitionBy("geo").orderBy("date").rowsBetween(1, last)
    steps = series.withColumn("_ahead", F.collect_list("casos").over(ahead))
    pairs = steps.select("geo", "casos", "date", F.posexplode("_ahead").alias("_i", "_next"))
    return pairs.select("geo", (F.col("_i") + 1).alias("h"), (F.col("_next") - F.col("casos")).alias("diff"),
                        F.date_add("date", (F.col("_i") + 1) * 7).alias("date")).filter(F.col("h") >= first)


def _last_by_fold(series: DataFrame, nested: fo.Nested) -> DataFrame:
    """geo, and per fold the last value (last_1, ...) and the number of training weeks (weeks_1, ...), from one row a span."""
    spans = nested.trained(series).groupBy("geo", "_span").agg(
        F.max_by("casos", "date").alias("_last"), F.max("date").alias("_at"), F.count("*").alias("_weeks"))
    return spans.groupBy("geo").agg(
        *[F.max_by("_last", F.when(nested.until(i), F.col("_at"))).alias(f"last_{i}") for i in nested.ids],
        *[F.sum(F.when(nested.until(i), F.col("_weeks"))).alias(f"weeks_{i}") for i in nested.ids])


def last_values(series: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id, geo, last observed value and number of training weeks."""
    nested = fo.Nested(folds)
    rows = _last_by_fold(series, nested).select("geo", nested.rows(last_value="last", weeks="weeks"))
    return rows.filter("weeks is not null").select(*KEYS, "last_value", "weeks")


def naive(series: DataFrame, folds: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Last value plus quantiles of the h-step differences, cut at zero."""
    calendar = fo.fold_calendar(folds) if calendar is None else calendar
    nested = fo.Nested(folds)
    counts = nested.counts(nested.trained(step_differences(series)), ["geo", "h"], "diff")
    vectors = counts.groupBy("geo", "h").agg(*[os_.quantile_vector(F.col("diff"), weight=F.col(f"n_{i}")).alias(f"q_{i}") for i in nested.ids])
    spreads = vectors.groupBy("geo").agg(*[F.map_from_entries(F.collect_list(F.struct("h", f"q_{i}"))).alias(f"q_{i}") for i in nested.ids])
    both = _last_by_fold(series, nested).join(spreads, "geo", "left")
    fitted = both.select("geo", nested.rows(last_value="last", weeks="weeks", _by_h="q")).filter("weeks is not null")
    h = F.col("horizon_weeks")
    usable = F.when(F.col("weeks") <= h, F.greatest(F.lit(1), F.col("weeks").cast("int") - 1)).otherwise(h)
    q = qt.shift_floor(F.coalesce(F.col("_by_h")[usable], zeros()), F.col("last_value"))
    return forecast_columns(on_grid(fitted, calendar), "naive", q)


def week_counts(df: DataFrame, nested: fo.Nested, value: str, keys: list[str] = ["geo"]) -> DataFrame:
    """keys, epiweek, value and its occurrences up to each fold's cut-off: what all seasonal models pool."""
    weeks = nested.trained(df).withColumn("epiweek", cal.epi_week(F.col("date")))
    return nested.counts(weeks, [*keys, "epiweek"], value)


def weekly_medians(series: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id, geo, epiweek, median: the usual level of each week of the year."""
    nested = fo.Nested(folds)
    medians = week_counts(series, nested, "casos").groupBy("geo", "epiweek").agg(
        *[F.percentile("casos", 0.5, F.col(f"n_{i}")).alias(f"m_{i}") for i in nested.ids])
    rows = medians.select("geo", "epiweek", nested.rows(median="m"))
    return rows.filter("median is not null").select(*KEYS, "epiweek", "median")


def residual_pools(series: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id, geo, q, medians: quantiles of the departures from the usual level, and that level by week."""
    nested = fo.Nested(folds)
    week = W.partitionBy("geo", "epiweek")
    centred = week_counts(series, nested, "casos").withColumns(
        {f"m_{i}": F.percentile("casos", 0.5, F.col(f"n_{i}")).over(week) for i in nested.ids})
    pools = centred.groupBy("geo").agg(
        *[os_.quantile_vector(F.col("casos") - F.col(f"m_{i}"), weight=F.col(f"n_{i}")).alias(f"q_{i}") for i in nested.ids],
        *[F.map_from_entries(F.collect_set(F.when(F.col(f"m_{i}").isNotNull(), F.struct("epiweek", F.col(f"m_{i}").alias("median"))))).alias(f"m_{i}") for i in nested.ids])
    return pools.select("geo", nested.rows(q="q", medians="m")).filter("q is not null").select(*KEYS, "q", "medians")


def seasonal_naive(series: DataFrame, folds: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Same-week median plus pooled residual quantiles; an unseen week gets the median of the medians."""
    calendar = fo.fold_calendar(folds) if calendar is None else calendar
    fitted = residual_pools(series, folds).withColumn("_usual", os_.array_median(F.map_values("medians")))
    centre = F.coalesce(F.col("medians")[F.col("epiweek")], F.col("_usual"), F.lit(0.0))
    return forecast_columns(on_grid(fitted, calendar), "seasonal_naive", qt.shift_floor(F.col("q"), centre))


def pooled_weeks(counts: DataFrame, nested: fo.Nested, value: str, lo: int, hi: int, keys: list[str] = ["geo"]) -> DataFrame:
    """fold_id, keys, target_week, q, mean from the histograms of ``week_counts`` around each week of the year."""
    around = os_.circular_week_pool(counts, lo, hi).groupBy(*keys, "target_week").agg(
        *[os_.quantile_vector(F.col(value), weight=F.col(f"n_{i}")).alias(f"q_{i}") for i in nested.ids],
        *[F.try_divide(F.sum(F.col(value) * F.col(f"n_{i}")), F.sum(f"n_{i}")).alias(f"mean_{i}") for i in nested.ids])
    rows = around.select(*keys, "target_week", nested.rows(q="q", mean="mean"))
    return rows.filter("q is not null").select("fold_id", *keys, "target_week", "q", "mean")


def window_pools(series: DataFrame, folds: DataFrame, lo: int = -3, hi: int = 1) -> DataFrame:
    """fold_id, geo, target_week, q, mean: empirical quantiles over a circular window of weeks."""
    nested = fo.Nested(folds)
    return pooled_weeks(week_counts(series, nested, "casos"), nested, "casos", lo, hi)


def climatological(series: DataFrame, folds: DataFrame, calendar: DataFrame | None = None,
                   point_estimate: str = "median", lo: int = -3, hi: int = 1) -> DataFrame:
    """Quantiles of past counts around the same week of the year; an empty window gives zeros."""
    calendar = fo.fold_calendar(folds) if calendar is None else calendar
    entry = F.struct("target_week", F.struct("q", "mean"))
    fitted = window_pools(series, folds, lo, hi).groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_by_week")
    )
    pool = F.col("_by_week")[F.col("epiweek")]
    q = F.transform(F.coalesce(pool["q"], zeros()), lambda v: F.greatest(v, F.lit(0.0)))
    if point_estimate == "mean":
        q = qt.mean_centred(q, F.coalesce(pool["mean"], F.lit(0.0)))
    return forecast_columns(on_grid(fitted, calendar), "climatological_quantile", q)
