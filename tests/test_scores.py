import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.constants import INTERVAL_LEVELS, QUANTILE_COLUMNS, QUANTILE_LEVELS
from tidecast.functions import quantiles as qt
from tidecast.functions import scoring as sc
from tidecast.operators import ensemble as en
from tidecast.operators import scores as so

TOY = [0.0, 2.0, 4.0, 6.0, 10.0, 14.0, 16.0, 20.0, 24.0]


def wide(spark, rows, extra="observed_value DOUBLE"):
    schema = ", ".join(f"{c} DOUBLE" for c in QUANTILE_COLUMNS) + ", " + extra
    return spark.createDataFrame(rows, schema)


def test_toy_score_and_its_parts(spark):
    row = so.attach_scores(wide(spark, [(*TOY, 15.0)])).first()
    assert row.wis == pytest.approx(8.2 / 4.5)
    assert row.dispersion + row.overprediction + row.underprediction == pytest.approx(row.wis)
    assert (row.coverage_50, row.coverage_80, row.coverage_95) == (False, True, True)


def test_interval_and_quantile_forms_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(*np.sort(rng.gamma(2, 20, 9)).tolist(), float(rng.gamma(2, 20))) for _ in range(300)]
    y = F.col("observed_value")
    got = wide(spark, rows).select(sc.wis_from_intervals(y).alias("a"), sc.wis_from_quantiles(y, qt.wide_array()).alias("b"))
    for r in got.collect():
        assert r.a == pytest.approx(r.b)


def test_degenerate_forecasts(spark):
    rows = so.attach_scores(wide(spark, [(*[10.0] * 9, 17.0), (*[5.0] * 9, 5.0)])).collect()
    assert [r.wis for r in rows] == [pytest.approx(7.0), pytest.approx(0.0)]


def test_pinball_and_interval_values(spark):
    row = spark.range(1).select(
        sc.pinball(F.lit(10.0), F.lit(7.0), 0.5).alias("p"),
        sc.interval_score(F.lit(5.0), F.lit(15.0), F.lit(10.0), 0.1).alias("i")).first()
    assert (row.p, row.i) == (1.5, 10.0)


def test_peaks_take_the_first_maximum(spark):
    rows = [(1, h, float(o), float(p)) for h, (o, p) in enumerate(zip([1, 2, 10, 3, 10], [1, 2, 3, 10, 1]))]
    df = spark.createDataFrame(rows, "model INT, horizon_weeks INT, observed_value DOUBLE, pred DOUBLE")
    row = so.peaks(df, ["model"]).first()
    assert row.peak_timing_error == 1
    assert row.peak_magnitude_error == pytest.approx(math.log(0.3))


def test_relative_score_of_two_models(spark):
    rows = [("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 1.0), ("b", 2, 2.0), ("a", 3, 9.0)]
    df = spark.createDataFrame(rows, "model STRING, unit INT, wis DOUBLE")
    got = {r.model: r.relative_wis for r in so.relative_wis(df, "a", ["unit"], ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx(0.25)}


def test_normalized_score_with_and_without_a_fold(spark):
    rows = [("a", 1, 10.0, 100.0), ("a", 2, 40.0, 100.0), ("b", 1, 20.0, 100.0), ("b", 2, 20.0, 100.0)]
    df = spark.createDataFrame(rows, "model STRING, fold_id INT, wis DOUBLE, observed_value DOUBLE")
    every = {r.model: r.normalized_wis for r in so.normalized_wis(df, ["model"]).collect()}
    plain = {r.model: r.normalized_wis for r in so.normalized_wis(df, ["model"], (2,)).collect()}
    assert every == {"a": 0.25, "b": 0.2} and plain == {"a": 0.1, "b": 0.2}


def unit_rows(centres):
    offsets = [-9, -6, -4, -2, 0, 2, 4, 6, 9]
    return [(m, 1, g, "2024-01-07", 16, "2023-09-17", 100, *[float(c + o) for o in offsets])
            for m, c in centres.items() for g in ("X", "Y")]


UNIT_SCHEMA = ("model STRING, fold_id INT, geo STRING, date STRING, horizon_weeks INT, origin_date STRING, "
               "observed_value BIGINT, " + ", ".join(f"{c} DOUBLE" for c in QUANTILE_COLUMNS))


def test_median_and_weighted_ensembles(spark):
    members = spark.createDataFrame(unit_rows({"a": 100, "b": 120, "c": 140}), UNIT_SCHEMA)
    assert {r.pred for r in en.median_ensemble(members, ["a", "b", "c"]).collect()} == {120.0}
    assert {r.pred for r in en.median_ensemble(members, ["a"]).collect()} == {100.0}
    assert {r.pred for r in en.weighted_ensemble(members, en.equal_weights(members)).collect()} == {120.0}
    weights = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 1.0)], "model STRING, weight DOUBLE")
    assert [r.pred for r in en.weighted_ensemble(members, weights).collect()] == [pytest.approx(106.0)] * 2


def test_unobserved_weeks_keep_their_ensemble(spark):
    rows = [r[:6] + (None,) + r[7:] for r in unit_rows({"a": 100, "b": 120})]
    members = spark.createDataFrame(rows, UNIT_SCHEMA)
    assert en.median_ensemble(members, ["a", "b"]).count() == 2


def test_inverse_score_weights(spark):
    df = spark.createDataFrame([("good", 1, 1.0), ("bad", 1, 4.0), ("bad", 2, 0.1)], "model STRING, fold_id INT, wis DOUBLE")
    got = {r.model: r.weight for r in en.inverse_score_weights(df, ["good", "bad"]).collect()}
    assert got == {"good": pytest.approx(0.8), "bad": pytest.approx(0.2)}


def test_conformal_factors(spark):
    bounds = [-1.0] * 4 + [0.0] + [1.0] * 4
    calib = wide(spark, [(*bounds, k / 5) for k in range(1, 11)])
    got = {r.level: r.factor for r in en.widening_factors(calib).collect()}
    assert got == {50: pytest.approx(1.1), 80: pytest.approx(1.64), 90: pytest.approx(1.82), 95: pytest.approx(1.91)}


def test_widening_keeps_the_median_and_the_order(spark):
    row = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 18.0]
    factors = spark.createDataFrame([(v, 2.0) for v in INTERVAL_LEVELS], "level INT, factor DOUBLE")
    got = en.apply_widening(wide(spark, [(*row, 1.0)]), factors, "w").first()
    assert (got.pred, got.upper_50, got.lower_50) == (10.0, 14.0, 6.0)
    values = [got[c] for c in QUANTILE_COLUMNS]
    assert values == sorted(values)


def test_rearrangement_sorts_each_row(spark):
    got = qt.rearrange(wide(spark, [(*TOY[::-1], 1.0)])).first()
    assert [got[c] for c in QUANTILE_COLUMNS] == TOY


def test_pivot_refuses_a_missing_level(spark):
    rows = [(1, t, 1.0) for t in QUANTILE_LEVELS[:-1]]
    long = spark.createDataFrame(rows, "id INT, quantile_level DOUBLE, predicted_value DOUBLE")
    with pytest.raises(Exception, match="missing quantile levels"):
        so.complete_only(so.pivot_wide(long, ["id"])).collect()


def test_floor_keeps_missing_values_missing(spark):
    got = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, -1.0D AS b").select(
        qt.floor_zero(F.col("a")).alias("a"), qt.floor_zero(F.col("b")).alias("b")).first()
    assert got.a is None and got.b == 0.0


def test_nominal_coverage_of_a_calibrated_forecast(spark):
    rng = np.random.default_rng(3)
    z = [-1.959964, -1.644854, -1.281552, -0.67449, 0.0, 0.67449, 1.281552, 1.644854, 1.959964]
    rows = [(*[50 + 10 * q for q in z], float(50 + 10 * rng.standard_normal())) for _ in range(5000)]
    got = so.coverage(wide(spark, rows).withColumn("k", F.lit(1)), ["k"]).first()
    for level in INTERVAL_LEVELS:
        assert got[f"coverage_{level}"] == pytest.approx(level / 100, abs=0.03)
