"""Leakage guard, geo lists, fold counts, climate history, crowded quantiles and scale-free curve fits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import ensemble, order_stats, quality, rollup
from tidecast.operators import folds as fo
from tidecast.plans import backtest, baselines, panel, trajectories
from tidecast.plans.hierarchical import hierarchical

START = dt.date(1994, 1, 2)


@pytest.fixture(scope="module")
def folds(spark):
    year = F.col("id").cast("int") + F.lit(1996)
    return spark.range(1, 6, numPartitions=1).select(
        F.col("id").cast("int").alias("fold_id"), cal.epi_week_start(year, 25).alias("train_cutoff"),
        cal.epi_week_start(year, 41).alias("target_start"), cal.epi_week_start(year + 1, 40).alias("target_end"))


@pytest.fixture(scope="module")
def series(spark):
    rows = [(g, START + dt.timedelta(weeks=i), (i * k) % 37) for g, k in (("A", 5), ("B", 11)) for i in range(470)]
    return spark.createDataFrame(rows, "geo string, date date, casos long")


def _rows(df):
    return sorted((r.model, r.fold_id, r.geo, r.date, tuple(r.q)) for r in df.collect())


def test_five_folds_keep_flags_bounds_and_anomalies(spark, series, folds):
    flagged = fo.tag_flags(series, folds)
    assert "target_5" in flagged.columns
    got = {r.fold_id: r.train_cutoff for r in fo.boundaries(flagged).collect()}
    assert got == {r.fold_id: r.train_cutoff for r in folds.collect()}
    climate = series.select("geo", "date", *[F.col("casos").cast("double").alias(c) for c in ("temp_med", "precip_med", "rel_humid_med")])
    means = panel.fold_means(climate, folds).filter("geo = 'A' and epiweek = 10").first()["_means"]
    assert sorted(means) == [1, 2, 3, 4, 5]


def test_guarded_model_finds_no_later_rows(series, folds):
    def spy(history, grid):
        last = history.groupBy("fold_id", "geo").agg(F.max("date").alias("last"), F.max("train_cutoff").alias("cut"))
        joined = grid.join(last, ["fold_id", "geo"])
        q = F.array_repeat(F.datediff("last", "cut").cast("double"), 9)
        return baselines.forecast_columns(joined, "spy", q)

    rows = backtest.run([backtest.guarded(spy)], series, folds).select(F.col("q")[0].alias("v"), "geo", "fold_id").distinct().collect()
    assert {r.v for r in rows} == {0.0} and len(rows) == 10


def test_history_past_the_cutoff_fails(series, folds):
    late = series.join(F.broadcast(folds.select("fold_id", "train_cutoff")))
    with pytest.raises(Exception, match="after the cut-off"):
        quality.require_history(late, folds).collect()


def test_built_in_forecasters_ignore_later_values(series, folds):
    one = folds.filter("fold_id = 1")
    changed = series.crossJoin(F.broadcast(one.select("train_cutoff"))).withColumn(
        "casos", F.when(F.col("date") > F.col("train_cutoff"), F.lit(999).cast("long")).otherwise(F.col("casos"))).drop("train_cutoff")
    for forecaster in (baselines.naive, baselines.seasonal_naive, baselines.climatological):
        assert _rows(forecaster(series, one)) == _rows(forecaster(changed, one))


def test_listed_geos_without_cases_or_population_get_zeros(spark, series, folds):
    geos = spark.createDataFrame([("A",), ("C",)], "geo string")
    population = spark.createDataFrame([("A", 1994, 1000), ("A", 2003, 1000)], "geo string, year int, population long")
    regions = spark.createDataFrame([("A", "R"), ("B", "R"), ("C", "R")], "uf string, macroregion string")
    models = [baselines.naive, baselines.seasonal_naive, baselines.climatological,
              lambda s, f: hierarchical(s, f, population, regions)]
    weeks = fo.fold_calendar(folds.filter("fold_id = 1")).count()
    rows = backtest.run(models, series, folds.filter("fold_id = 1"), geos).groupBy("model", "geo").agg(
        F.count("*").alias("n"), F.max(F.array_max("q")).alias("top")).collect()
    assert len(rows) == 12 and {r.n for r in rows} == {weeks}
    assert {r.top for r in rows if r.geo == "C"} == {0.0}


def test_climate_is_smoothed_over_its_own_history(spark, series):
    climate = spark.createDataFrame(
        [("A", START + dt.timedelta(weeks=i), float(i), 1.0, 1.0) for i in range(-3, 5)],
        "geo string, date date, temp_med double, precip_med double, rel_humid_med double")
    population = spark.createDataFrame([("A", 1994, 1000), ("B", 1994, 1000)], "geo string, year int, population long")
    ocean = series.filter("geo = 'A'").select("date", *[F.lit(1.0).alias(i) for i in ("enso", "iod", "pdo")])
    first = panel.origin_series(series, population, climate, ocean).filter("geo = 'A'").orderBy("date").first()
    assert first.date == START and first.temp_med_roll4 == -1.5


def test_anchor_history_is_bounded(spark, series):
    population = spark.createDataFrame([("A", 1994, 1000), ("B", 1994, 1000)], "geo string, year int, population long")
    climate = series.select("geo", "date", *[F.lit(1.0).alias(c) for c in ("temp_med", "precip_med", "rel_humid_med")])
    ocean = series.filter("geo = 'A'").select("date", *[F.lit(1.0).alias(i) for i in ("enso", "iod", "pdo")])
    rows = panel.origin_series(series, population, climate, ocean)
    assert rows.agg(F.max(F.size("history"))).first()[0] == panel.ANCHOR_WEEKS


def test_exact_quantiles_of_crowded_values(spark):
    values = spark.range(20000).select((F.lit(1e6) + F.col("id") / 1000).alias("v")).unionByName(spark.range(1).select(F.lit(0.0).alias("v")))
    got = order_stats.exact_quantiles(values, [], "v", [0.025, 0.5, 0.975]).orderBy("quantile_level").collect()
    every = np.append(1e6 + np.arange(20000) / 1000, 0.0)
    assert np.allclose([r.v for r in got], np.quantile(every, [0.025, 0.5, 0.975]), rtol=0, atol=1e-9)


def test_curve_fit_does_not_depend_on_scale(spark):
    t = np.arange(1, 53)
    curve = (1 + np.exp(-0.4 * (t - 20))) ** -1.0
    steps = np.diff(curve, prepend=0.0)
    rows = [(k, int(s), float(x * scale)) for k, scale in (("big", 1e4), ("small", 0.01)) for s, x in zip(t, steps)]
    fits = trajectories.fit_growth(spark.createDataFrame(rows, "k string, slot int, v double"), ["k"], "v").collect()
    assert {(f.growth_rate, f.peak_week, f.shape_alpha) for f in fits} == {(0.4, 20, 1.0)}


def test_small_groups_keep_a_shift_of_zero(spark):
    calib = spark.range(10).select(F.lit("a").alias("k"), F.lit(50).alias("level"), F.col("id").cast("double").alias("score"))
    rows = ensemble.additive_shifts(calib, ["k"]).collect()
    assert [(r.n, r.shift) for r in rows] == [(10, 0.0)]


def test_included_geos_are_dense(spark, series):
    got = rollup.include_geos(series, spark.createDataFrame([("Z",)], "geo string")).filter("geo = 'Z'")
    assert got.agg(F.count("*"), F.sum("casos")).first()[:] == (470, 0)
