"""Backtest and scoring drivers: every fold and model in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import quantiles as qt
from tidecast.operators import folds as fo
from tidecast.operators import quality, rollup
from tidecast.operators import scores as so

Forecaster = Callable[[DataFrame, DataFrame], DataFrame]
Model = Callable[[DataFrame, DataFrame], DataFrame]


def guarded(model: Model) -> Forecaster:
    """A forecaster from a model that must not see the future: it maps (history, grid) to quantile rows.

    ``history`` has the rows of every fold up to its cut-off (fold_id, geo, date, casos, ...), ``grid`` the target
    weeks of every geo and fold (fold_id, geo, date, origin_date, horizon_weeks). The forecasts fail if a fold's
    history reaches past its cut-off or into the weeks between cut-off and target.
    """

    def forecaster(series: DataFrame, folds: DataFrame) -> DataFrame:
        history = fo.training(series, folds)
        clean = quality.require_history(history, folds)
        grid = fo.target_grid(series.select("geo").distinct(), folds)
        return model(history, grid).join(F.broadcast(clean), "fold_id")

    return forecaster


def run(forecasters: list[Forecaster], series: DataFrame, folds: DataFrame, geos: DataFrame | None = None) -> DataFrame:
    """Forecasts of several models, stacked by name.

    A forecaster maps (series, folds) to quantile rows and is handed the rows up to the last cut-off only: no model, not
    even one of this package, can read a week that no fold may train on, whatever its windows span. How it cuts the folds
    apart inside that is its own affair; ``causality`` proves that it does. Models that don't want to cut are written as
    (history, grid) and passed through ``guarded``. ``geos`` (geo) names geos that must get a forecast: those without a row
    in the dense ``series`` enter it as zeros.
    """
    if geos is not None:
        series = rollup.include_geos(series, geos)
    known = fo.seen(series, folds)
    parts = [f(known, folds) for f in forecasters]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def causality(forecasters: list[Forecaster], series: DataFrame, folds: DataFrame) -> DataFrame:
    """model, fold_id, rows, changed: the forecasts of each fold that change when every later value does (0 for a causal model).

    For each fold the values after its cut-off are replaced, and only that fold is forecast; its rows are compared with
    those of all folds forecast together, quantile by quantile.
    """
    unit = ["model", "fold_id", "geo", "date"]
    parts = []
    for f in forecasters:
        together = f(series, folds).select(*unit, F.col("q").alias("_q"))
        for one, cutoff in fo.cutoffs(folds):
            value = F.when(F.col("date") > F.lit(cutoff), F.col("casos") * 3 + 1000).otherwise(F.col("casos"))
            alone = f(series.withColumn("casos", value), folds.filter(F.col("fold_id") == one)).select(*unit, "q")
            parts.append(together.filter(F.col("fold_id") == one).join(alone, unit, "full_outer"))
    same = F.forall(F.arrays_zip("q", "_q"), lambda x: F.abs(x["q"] - x["_q"]) <= 1e-9 * (1 + F.abs(x["_q"])))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy("model", "fold_id").agg(
        F.count("*").alias("rows"), F.sum(F.when(same, 0).otherwise(1)).cast("bigint").alias("changed"))


def score(forecasts: DataFrame, series: DataFrame, folds: DataFrame) -> DataFrame:
    """Wide rows with observation and scores; weeks without an observation drop out."""
    observed = fo.target_window(series, folds).select("fold_id", "geo", "date", "casos")
    wide = qt.to_wide(forecasts)
    joined = wide.join(observed.withColumnRenamed("casos", "observed_value"), ["fold_id", "geo", "date"])
    return so.attach_scores(joined)
