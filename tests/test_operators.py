import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.constants import QUANTILE_COLUMNS, QUANTILE_LEVELS
from tidecast.functions import transforms as tf
from tidecast.operators import bootstrap as bs
from tidecast.operators import folds as fo
from tidecast.operators import joins as jn
from tidecast.operators import order_stats as os_
from tidecast.operators import quality as ql
from tidecast.operators import rollup
from tidecast.operators import windows as wn
from tidecast.plans import output, sequences, trajectories
from tidecast.sources import star

D = dt.date


@pytest.mark.parametrize("values", [
    [0.0] * 400 + list(range(1, 50)), list(np.random.default_rng(0).lognormal(3, 2, 700)), [5.0],
    [-3.5, -3.5, 0.0, 2.0, 1e12], list(1000 + np.random.default_rng(5).random(300) * 1e-6),
])
def test_distributed_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", 3.0), ("h", None)], "k STRING, v DOUBLE")
    got = os_.exact_quantiles(df, ["k"], "v", QUANTILE_LEVELS, parts=5).collect()
    g = {r.quantile_level: r.v for r in got if r.k == "g"}
    for level in QUANTILE_LEVELS:
        assert g[level] == pytest.approx(float(np.quantile(values, level)), rel=1e-12, abs=1e-12)
    assert {r.n for r in got if r.k == "h"} == {2}


def test_distributed_quantiles_without_keys(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("v"))
    assert os_.exact_quantiles(df, [], "v", [0.5]).first().v == 501.0


def test_conformal_rank(spark):
    scores = list(range(1, 21))
    df = spark.createDataFrame([(float(s),) for s in scores], "v DOUBLE")
    got = {r.quantile_level: r.v for r in os_.exact_quantiles(df, [], "v", [0.5, 0.9, 0.99], rank=os_.conformal_rank).collect()}
    assert got == {0.5: 11.0, 0.9: 19.0, 0.99: 20.0}


def test_circular_pool_reaches_the_right_weeks(spark):
    df = spark.createDataFrame([(10,), (1,), (53,)], "epiweek INT")
    got = {}
    for r in os_.circular_week_pool(df, -3, 1).collect():
        got.setdefault(r.epiweek, set()).add(r.target_week)
    # a target week w pools w-3..w+1, so a sample in week s feeds s-1..s+3
    assert got == {10: {9, 10, 11, 12, 13}, 1: {53, 1, 2, 3, 4}, 53: {52, 53, 1, 2, 3}}


def test_densify_fills_holes_and_both_ends(spark):
    rows = [("a", D(2024, 1, 7), 5), ("a", D(2024, 1, 28), 7), ("b", D(2024, 1, 14), 1)]
    got = rollup.densify(spark.createDataFrame(rows, "geo STRING, date DATE, casos BIGINT")).orderBy("geo", "date").collect()
    assert [(r.geo, r.casos) for r in got] == [("a", 5), ("a", 0), ("a", 0), ("a", 7), ("b", 0), ("b", 1), ("b", 0), ("b", 0)]


def test_weighted_mean_counts_a_missing_weight_as_one(spark):
    climate = spark.createDataFrame([(1, D(2020, 1, 5), 10.0), (2, D(2020, 1, 5), 40.0)], "geocode BIGINT, date DATE, temp DOUBLE")
    population = spark.createDataFrame([(1, 2019, 9)], "geocode BIGINT, year INT, population BIGINT")
    geo = spark.createDataFrame([(1, "X"), (2, "X"), (2, "X")], "geocode BIGINT, uf STRING")
    got = rollup.weighted_mean(climate, population, geo, ["uf", "date"], ["temp"]).first()
    assert got.temp == pytest.approx((10 * 9 + 40) / 10)


def test_as_of_takes_the_latest_even_when_its_value_is_missing(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k STRING, t INT")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 4, None), ("a", 6, 60.0)], "k STRING, s INT, v DOUBLE")
    got = {(r.k, r.t): r.v for r in jn.as_of(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {("a", 5): None, ("a", 1): None, ("b", 9): None}
    assert jn.as_of(left.filter("t = 5"), right.filter("s < 4"), ["k"], "t", "s", ["v"]).first().v == 20.0


def test_interpolation_matches_numpy(spark):
    y = [None, 2.0, None, None, 8.0, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "k STRING, p INT, v DOUBLE")
    got = [r.v for r in wn.interpolate(df, ["k"], "p", "v").orderBy("p").collect()]
    assert got == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_lag_one_is_the_value_at_the_origin(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 7) + dt.timedelta(weeks=i), float(i)) for i in range(5)], "geo STRING, date DATE, x DOUBLE")
    row = df.withColumns(wn.autoregressive_lags("x", ["geo"], [1, 2])).orderBy(F.desc("date")).first()
    assert (row.lag_1, row.lag_2) == (4.0, 3.0)


def test_gap_weeks_leak_through_the_naive_filter(spark):
    folds = star.folds(spark)
    weeks = spark.sql("SELECT explode(sequence(DATE'1998-01-04', DATE'1999-12-26', INTERVAL 7 DAYS)) AS date")
    flagged = fo.tag_flags(weeks, folds)
    naive = ql.gap_rows(flagged.filter("NOT target_1"), folds.filter("fold_id = 1")).first()
    clean = ql.gap_rows(fo.training(weeks, folds).filter("fold_id = 1").select("fold_id", "date"), folds).first()
    assert (naive.gap_rows, clean.gap_rows) == (15, 0)


def test_fold_boundaries_come_back_from_the_flags(spark):
    folds = star.folds(spark)
    weeks = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2001-11-04', INTERVAL 7 DAYS)) AS date")
    got = fo.boundaries(fo.tag_flags(weeks, folds)).orderBy("fold_id").collect()
    assert (got[0].train_cutoff, got[0].target_start, got[0].target_end) == (D(1998, 6, 21), D(1998, 10, 11), D(1999, 10, 3))
    assert got[3].target_end == D(2001, 11, 4) and {r.gap_weeks for r in got} == {15}


def test_leak_makes_the_query_fail(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 8), D(2024, 1, 7))], "fold_id INT, date DATE, train_cutoff DATE")
    with pytest.raises(Exception, match="cut-off"):
        ql.require_no_leakage(ql.leakage(rows)).collect()


@pytest.mark.parametrize("units,replicates", [(300, 7), (16, 3), (1 << 14, 100)])
def test_sums_of_draws_equal_a_loop(spark, monkeypatch, units, replicates):
    monkeypatch.setattr(bs, "UNITS", units)
    monkeypatch.setattr(bs, "REPLICATES", replicates)
    rng = np.random.default_rng(4)
    values = {(i, g): float(rng.normal()) for i in range(250) for g in ("a", "b") if g == "a" or i % 3}
    table = spark.createDataFrame([(i, g, v, 1.0) for (i, g), v in values.items()], "unit_no long, g string, v double, one double").repartition(4)
    found = {(r.rep, r.g): (r.v, r.one) for r in bs.replicate_sums(table, 250, ["g"], ["v", "one"], 20).collect()}
    for rep in range(20):
        picked = []
        for i in range(250):
            x = pow((rep * 48271 + i * 69621 + 42 * 16807) % bs.PRIME, 5, bs.PRIME)
            picked.append(pow((x * 48271 + rep * 7919 + 12345) % bs.PRIME, 5, bs.PRIME) % 250)
        for g in "ab":
            own = [values[(i, g)] for i in picked if (i, g) in values]
            assert found[(rep, g)] == pytest.approx((sum(own), len(own)))


def test_draws_are_uniform_and_repeatable(spark):
    units = spark.range(200).select(F.concat(F.lit("u"), "id").alias("unit"))
    numbered = bs.number_units(units, F.col("unit"))
    assert sorted(r.unit_no for r in numbered.collect()) == list(range(200))
    moved = bs.number_units(units.repartition(7), F.col("unit"))

    def counted(table):
        # a unit is its own group, so its sum is the number of times it is drawn
        rows = bs.replicate_sums(table.select("unit_no", "unit", F.lit(1.0).alias("one")), 200, ["unit"], ["one"], 100).collect()
        numbers = {r.unit: r.unit_no for r in table.collect()}
        return {(r.rep, numbers[r.unit]): int(r.one) for r in rows if r.one}

    first, again = counted(numbered), counted(moved)
    assert first == again and sum(first.values()) == 20000
    per_unit = np.zeros(200)
    for (_, unit), times in first.items():
        per_unit[unit] += times
    assert abs(per_unit.mean() - 100) < 1e-9 and 60 < per_unit.var() < 150  # binomial variance is 99.5
    multiplicity = np.array(list(first.values()))
    assert 0.60 < len(first) / 20000 < 0.66 and multiplicity.max() < 10  # 1 - 1/e of the units per replicate


def tables(spark, edit=lambda rows: rows):
    weeks = [D(2023, 10, 8) + dt.timedelta(weeks=i) for i in range(52)]
    rows = [["t", 2024, "A", w, *[100.0 + i + o for o in (-40, -30, -20, -10, 0, 10, 20, 30, 40)]] for i, w in enumerate(weeks)]
    schema = "track STRING, season_year INT, geo STRING, date DATE, " + ", ".join(f"{c} DOUBLE" for c in QUANTILE_COLUMNS)
    return spark.createDataFrame([tuple(r) for r in edit(rows)], schema)


def spoil(row, column, value):
    def edit(rows):
        rows[row][4 + QUANTILE_COLUMNS.index(column)] = value
        return rows
    return edit


@pytest.mark.parametrize("edit, reason", [
    (lambda rows: rows, "ok"), (lambda rows: rows[:-1], "dates"), (lambda rows: [*rows[:-1], rows[0]], "dates"),
    (spoil(3, "pred", None), "non-finite"), (spoil(3, "pred", float("nan")), "non-finite"),
    (spoil(5, "lower_95", -1.0), "negative"), (spoil(6, "upper_90", 999.0), "nesting"),
])
def test_output_table_verdicts(spark, edit, reason):
    got = output.verdicts(tables(spark, edit)).first()
    assert (got.reason, got.valid) == (reason, reason == "ok")


def test_missing_columns_are_named(spark):
    assert ql.missing_columns(tables(spark).drop("pred")) == ["pred"]


def test_reindexed_table_shows_its_holes(spark):
    built = output.build_tables(tables(spark, lambda rows: rows[:10]))
    assert built.count() == 52 and built.filter("pred IS NULL").count() == 42


def test_only_valid_tables_are_written(spark, tmp_path):
    both = tables(spark).unionByName(tables(spark, spoil(5, "lower_95", -1.0)).withColumn("geo", F.lit("B")))
    output.write_valid(both, str(tmp_path / "out"))
    written = spark.read.csv(str(tmp_path / "out"), header=True)
    assert {r.geo for r in written.select("geo").distinct().collect()} == {"A"} and written.count() == 52


def test_growth_fit_recovers_the_curve(spark):
    t = np.arange(1, 53)
    cumulative = 10000 / np.power(1 + np.exp(-0.4 * (t - 20)), 1.0)
    weekly = np.diff(cumulative, prepend=0)
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, weekly)], "geo STRING, slot INT, v DOUBLE")
    fit = trajectories.fit_growth(df, ["geo"], "v").first()
    assert fit.final_size == pytest.approx(10000, rel=0.15) and abs(fit.obs_peak_week - 20) <= 4
    assert fit.growth_rate == pytest.approx(0.4)


def test_sequence_window_offset(spark):
    start = D(1996, 1, 7)
    rows = [(1, "a", start + dt.timedelta(weeks=i), i, 1000, float(i), 1.0 * i, 2.0 * i, 3.0 * i) for i in range(120)]
    weekly = spark.createDataFrame(rows, "x INT, geo STRING, date DATE, casos BIGINT, population BIGINT, log_inc DOUBLE, "
                                   "temp_med DOUBLE, precip_med DOUBLE, rel_humid_med DOUBLE").withColumn("epiweek", F.lit(1)).drop("x")
    folds = star.folds(spark).filter("fold_id = 1")
    train = sequences.sequence_dataset(weekly, folds, "1996-01-07")
    predict = sequences.sequence_dataset(weekly, folds, "1996-01-07", include_origin=True)
    a, b = train.orderBy("origin_date").first(), predict.orderBy("origin_date").first()
    assert a.origin_date == b.origin_date and len(a.window) == len(b.window) == 104
    assert b.window[-2].log_inc == pytest.approx(a.window[-1].log_inc)
    assert (sum(a.mask), a.labels[0], len(a.labels)) == (15, 105, 67)


def test_code_lookups(spark):
    row = spark.sql("SELECT 'SP' AS uf, 'chikungunya' AS d, 3541406 AS g").select(
        tf.uf_code(F.col("uf")).alias("uf"), tf.disease_code(F.col("d")).alias("d"),
        tf.city_state_code(F.col("g")).alias("g"), tf.uf_code(F.lit("XX")).alias("none")).first()
    assert (row.uf, row.d, row.g, row.none) == (35, "A92.0", "35", None)


def test_audit_reads_every_check(spark):
    a = spark.createDataFrame([(1, D(2024, 1, 7), 1), (2, D(2024, 1, 8), -1)], "geocode INT, date DATE, v INT")
    b = spark.createDataFrame([(2, D(2024, 1, 7), None), (3, D(2024, 1, 7), 4)], "geocode INT, date DATE, v INT")
    got = {(r.table, r.check): r.value for r in ql.audit({"a": (a, "date", "v"), "b": (b, "date", "v")}, "a").collect()}
    assert got[("a", "rows")] == 2 and got[("a", "not_sunday")] == 1 and got[("a", "negative")] == 1
    assert got[("b", "nulls")] == 1 and got[("b", "geos")] == 2 and got[("b", "missing_geos")] == 1
