"""Invariants of every forecaster on the small tables, checked against brute force where that is cheap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.constants import QUANTILE_LEVELS
from tidecast.functions import calendar as cal
from tidecast.operators import folds as fo
from tidecast.plans import backtest, baselines, panel, tracks, trajectories
from tidecast.plans.hierarchical import hierarchical
from tidecast.sources import landing, star
from tidecast.streaming import weekly as stream


@pytest.fixture(scope="module")
def world(spark, sf_dir):
    return star.folds(spark), inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir), star.geo_map(spark, sf_dir)


def forecasters(population, geo_map):
    return {
        "naive": baselines.naive, "seasonal_naive": baselines.seasonal_naive, "climatological": baselines.climatological,
        "hierarchical": lambda s, f: hierarchical(s, f, population, geo_map),
        "mechanistic": lambda s, f: trajectories.mechanistic(s, f, population, draws=100),
    }


@pytest.mark.parametrize("name", ["naive", "seasonal_naive", "climatological", "hierarchical", "mechanistic"])
def test_forecasts_are_complete_ordered_and_not_negative(world, name):
    folds, series, population, geo_map = world
    rows = forecasters(population, geo_map)[name](series, folds).collect()
    geos = series.select("geo").distinct().count()
    assert len(rows) == 4 * 52 * geos
    q = np.array([r.q for r in rows], dtype=float)
    assert np.isfinite(q).all() and (q >= 0).all() and (np.diff(q, axis=1) >= -1e-9).all()


def test_climatology_against_brute_force(spark, world):
    folds, series, _, _ = world
    rows = baselines.climatological(series, folds).filter("fold_id = 2").collect()
    cutoff = folds.filter("fold_id = 2").first().train_cutoff
    pdf = series.withColumn("w", cal.epi_week(F.col("date"))).toPandas()
    pdf = pdf[pdf["date"] <= cutoff]
    weeks = {r.d: r.w for r in spark.createDataFrame([(r.date,) for r in rows], "d DATE").distinct().select(
        "d", cal.epi_week(F.col("d")).alias("w")).collect()}
    for r in rows:
        near = {(weeks[r.date] + k - 1) % 53 + 1 for k in range(-3, 2)}
        pool = pdf[(pdf.geo == r.geo) & (pdf.w.isin(near))].casos
        assert r.q == pytest.approx(np.quantile(pool, QUANTILE_LEVELS).tolist())


def test_naive_clamps_long_horizons(spark):
    rows = [("a", pd.Timestamp("1998-06-21").date() - pd.Timedelta(weeks=k).to_pytimedelta(), 10 + k) for k in range(5)]
    series = spark.createDataFrame(rows, "geo STRING, date DATE, casos BIGINT")
    got = baselines.naive(series, star.folds(spark).filter("fold_id = 1")).collect()
    # five weeks: every horizon uses the single 4-step difference, -4
    assert {tuple(r.q) for r in got} == {tuple([6.0] * 9)}


def test_future_rows_do_not_change_a_forecast(world):
    folds, series, _, _ = world
    cutoff = folds.filter("fold_id = 1").first().train_cutoff
    loud = series.withColumn("casos", F.when(F.col("date") > F.lit(cutoff), 10**6).otherwise(F.col("casos")).cast("bigint"))
    only = folds.filter("fold_id = 1")
    for model in (baselines.naive, baselines.seasonal_naive, baselines.climatological):
        keys = ["geo", "date"]
        a = {(r.geo, r.date): r.q for r in model(series, only).select(*keys, "q").collect()}
        b = {(r.geo, r.date): r.q for r in model(loud, only).select(*keys, "q").collect()}
        assert a == b


def test_noise_is_the_same_in_two_runs_and_partitionings(world):
    folds, series, population, _ = world
    a = trajectories.mechanistic(series, folds, population, draws=50).orderBy("fold_id", "geo", "date").collect()
    b = trajectories.mechanistic(series.repartition(3), folds, population, draws=50).orderBy("fold_id", "geo", "date").collect()
    assert [r.q for r in a] == [r.q for r in b]


def test_panel_uses_nothing_after_the_origin(spark, sf_dir, world):
    folds, series, population, _ = world
    _, climate, ocean, seasonal, static = inp.panel_inputs(spark, sf_dir)
    built = panel.build(series, folds, population, climate, ocean, seasonal, static, inp.MIN_ORIGIN)
    assert built.filter("target_date > train_cutoff").count() == 0
    values = {(r.geo, r.date): r.log_inc for r in panel.origin_series(series, population, climate, ocean).select("geo", "date", "log_inc").collect()}
    for r in built.filter("fold_id = 3 AND horizon_weeks IN (1, 30, 67)").select(
            "geo", "origin_date", "target_date", "lag_1", "lag_2", "label", "seasonal_anchor").limit(400).collect():
        assert r.lag_1 == pytest.approx(values[(r.geo, r.origin_date)])
        assert r.label == pytest.approx(values[(r.geo, r.target_date)])


def test_full_season_covers_the_partial_fold(world):
    folds, series, _, _ = world
    partial = folds.filter("fold_id = 4")
    weeks = tracks.full_season(series, partial).groupBy("geo").count().select("count").distinct().collect()
    assert [r[0] for r in weeks] == [52]
    assert tracks.observed_folds(series, folds).filter("fold_id = 4").first().weeks < 10


def test_custom_forecaster_runs_in_the_driver(world):
    folds, series, _, _ = world

    def flat(s, f):
        grid = fo.target_grid(s.select("geo").distinct(), f)
        return baselines.forecast_columns(grid, "flat", F.array_repeat(F.lit(1.0), 9))

    scored = backtest.score(backtest.run([flat, baselines.naive], series, folds), series, folds)
    assert {r.model for r in scored.select("model").distinct().collect()} == {"flat", "naive"}


def test_saved_state_predicts_the_same(spark, world, tmp_path):
    from tidecast.plans import output
    folds, series, _, _ = world
    pools = baselines.window_pools(series, folds)
    output.save_state(pools, str(tmp_path / "s"))
    key = ["fold_id", "geo", "target_week"]
    assert output.load_state(spark, str(tmp_path / "s")).orderBy(*key).collect() == pools.orderBy(*key).collect()


def test_build_or_read_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert landing.build_or_read(spark, str(tmp_path), "t", "k", build).count() == 3
    assert len(calls) == 1


def test_fingerprints_match_hashlib(spark, tmp_path):
    import hashlib
    hashes = []
    for name, body in {"a.bin": b"one", "b.bin": b"two" * 100000}.items():
        (tmp_path / name).write_bytes(body)
        hashes.append(hashlib.sha256(body).hexdigest())
    files = landing.file_fingerprints(spark, str(tmp_path), "*.bin")
    assert sorted(r.sha256 for r in files.collect()) == sorted(hashes)
    assert landing.combined_fingerprint(files).first().fingerprint == hashlib.sha256("".join(sorted(hashes)).encode()).hexdigest()[:16]


def test_weekly_stream_matches_the_batch_resample(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    star.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("accessed_disease")).write.parquet(str(source))
    events = stream.read_events(spark, str(source), "ts TIMESTAMP, accessed_disease STRING")
    query = stream.run_available(stream.weekly_access(events, "0 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {(r.accessed_disease, r.date): r.access_count for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from tidecast.operators import explore as ex
    want = {(r.accessed_disease, r.date): r.access_count for r in ex.weekly_resample(
        star.access(spark, sf_dir), "access_date", "access_count", ("accessed_disease",)).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    open_week = max(d for _, d in want)
    assert {k for k in want if k[1] < open_week} <= set(got)
