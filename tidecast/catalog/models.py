"""Forecast operators and scoring drivers (section 2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.registry import query
from tidecast.constants import METRIC_COLUMNS, QUANTILE_COLUMNS
from tidecast.operators import scores as so
from tidecast.plans import backtest, baselines
from tidecast.plans.hierarchical import hierarchical
from tidecast.sources import star

_KEYS = "model, fold_id, geo, date, origin_date, horizon_weeks"


@query("m03_climatological_scored", f"""
SELECT model, fold_id, count(*) AS rows, {sql.r6('avg(wis)', 'mean_wis')},
       {sql.r6('sum(wis) / sum(observed_value)', 'normalized_wis')}
FROM v_clim_scored GROUP BY ALL""")
def m03_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = star.folds(spark)
    series = inp.state_series_raw(spark, sf_dir)
    scored = backtest.score(baselines.climatological(series, folds), series, folds)
    return scored.groupBy("model", "fold_id").agg(
        F.count("*").alias("rows"), F.round(F.avg("wis"), 6).alias("mean_wis"),
        F.round(so.ratio_of_sums(), 6).alias("normalized_wis"),
    )


def _forecast(df: DataFrame) -> DataFrame:
    return inp.rounded_quantiles(df)


@query("m01_naive", f"SELECT {_KEYS}, {sql.spread()} FROM v_naive")
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(baselines.naive(inp.state_series(spark, sf_dir), star.folds(spark)))


@query("m02_seasonal_naive", f"SELECT {_KEYS}, {sql.spread()} FROM v_snaive")
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(baselines.seasonal_naive(inp.state_series(spark, sf_dir), star.folds(spark)))


@query("m03_climatological_quantile", f"SELECT {_KEYS}, {sql.spread()} FROM v_clim")
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(baselines.climatological(inp.state_series(spark, sf_dir), star.folds(spark)))


@query("m04_hierarchical_climatology", f"SELECT {_KEYS}, {sql.spread()} FROM v_hier")
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(hierarchical(
        inp.state_series(spark, sf_dir), star.folds(spark), inp.state_population(spark, sf_dir),
        star.geo_map(spark, sf_dir),
    ))


def _ensemble_scored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns = ["model", "fold_id", "geo", "date", "horizon_weeks", "observed_value", *QUANTILE_COLUMNS, "wis"]
    chosen = inp.all_scored(spark, sf_dir).filter(F.col("model") == name)
    return inp.round_all(chosen.select(*columns))


def _ensemble_sql(name: str) -> str:
    wide = ", ".join(sql.r6(c, c) for c in QUANTILE_COLUMNS)
    return (
        f"SELECT model, fold_id, geo, date, horizon_weeks, observed_value, {wide}, {sql.r6('wis', 'wis')} "
        f"FROM v_ensembles_scored WHERE model = '{name}'"
    )


@query("m07_vincentised_ensemble", _ensemble_sql("ensemble_vincent"))
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scored(spark, sf_dir, "ensemble_vincent")


@query("m08_inverse_wis_ensemble", _ensemble_sql("ensemble_invwis"))
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scored(spark, sf_dir, "ensemble_invwis")


@query("m09_conformal_ensemble", _ensemble_sql("ensemble_conformal"))
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble_scored(spark, sf_dir, "ensemble_conformal")


@query("m10_backtest_driver", f"SELECT {_KEYS}, {sql.spread()} FROM v_members")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = star.folds(spark)
    population, geo_map = inp.state_population(spark, sf_dir), star.geo_map(spark, sf_dir)
    forecasters = [baselines.naive, baselines.seasonal_naive, baselines.climatological,
                   lambda s, f: hierarchical(s, f, population, geo_map)]
    return _forecast(backtest.run(forecasters, inp.state_series(spark, sf_dir), folds))


@query("m10_causality", "SELECT model, fold_id, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM v_members GROUP BY ALL")
def m10_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts that change with values after their fold's cut-off: none, for each built-in model."""
    population, geo_map = inp.state_population(spark, sf_dir), star.geo_map(spark, sf_dir)
    forecasters = [baselines.naive, baselines.seasonal_naive, baselines.climatological,
                   lambda s, f: hierarchical(s, f, population, geo_map)]
    return backtest.causality(forecasters, inp.state_series(spark, sf_dir), star.folds(spark))


@query("m12_scoring_driver", f"""
SELECT model, fold_id, geo, date, horizon_weeks, observed_value, {", ".join(sql.r6(c, c) for c in METRIC_COLUMNS[:5])},
       coverage_50, coverage_80, coverage_90, coverage_95 FROM v_scored""")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["model", "fold_id", "geo", "date", "horizon_weeks", "observed_value", *METRIC_COLUMNS]
    return inp.round_all(inp.members_scored(spark, sf_dir).select(*columns))
