"""Registered queries against their SQL on DuckDB at the smallest scale (tools/check.py runs them all)."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402

NAMES = [
    "a01_sum_to_state", "a02_population_weighted_mean", "a05_weighted_seasonal_forecast", "a20_relative_wis",
    "a27_conformal_factors", "a28_cqr_order_statistic", "a40_block_bootstrap", "a52_ensemble_subset_sweep",
    "j09_as_of_join", "j10_seasonal_anchor", "m01_naive", "m02_seasonal_naive", "m03_climatological_scored",
    "m04_hierarchical_climatology", "m05_trajectory_resampling", "m09_conformal_ensemble", "m13_growth_curve_fit",
    "m15_sequence_dataset", "o06_output_table_verdicts", "w08_gap_interpolation",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    ok, note = check.compare(spark, con, sf_dir, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_known_answer_shape(spark):
    rows = entry_points.entry(spark).collect()
    assert {r.fold_id for r in rows} == {1, 2, 3, 4}
