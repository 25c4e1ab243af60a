"""Panel builder, sequence datasets, trajectories and the regressor (section 2.9, second half)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.inputs import r6, shared
from tidecast.catalog.registry import query
from tidecast.constants import SEQUENCE_LENGTH
from tidecast.operators import bootstrap as bs
from tidecast.operators import folds as fo
from tidecast.operators import rollup
from tidecast.operators import scores as so
from tidecast.plans import backtest, panel, regressor, sequences, trajectories
from tidecast.session import handoff
from tidecast.sources import star

_COLUMNS = [c for c in panel.FEATURES if c != "horizon_weeks"] + inp.PANEL_STATIC + ["label"]
# Means of few short decimals can end in an exact tie at six places, so these keep nine.
_SHORT = [*panel.SEASONAL_FEATURES, "temp_med_roll4", "precip_med_roll4"]
_DIGITS = {c: 9 if c in _SHORT else 6 for c in _COLUMNS}
_PROFILE = ", ".join(f"round(avg({c}), {d}) + 0.0 AS {c}" for c, d in _DIGITS.items())


@query("m14_panel_builder",
       f"SELECT fold_id, geo, horizon_weeks, count(*) AS rows, {_PROFILE} FROM v_train_panel GROUP BY ALL")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every feature and the label per fold, geo and horizon, over the whole panel."""
    built = panel.build(
        inp.state_series(spark, sf_dir), star.folds(spark), *inp.panel_inputs(spark, sf_dir), inp.MIN_ORIGIN)
    return built.groupBy("fold_id", "geo", "horizon_weeks").agg(
        F.count("*").alias("rows"), *[(F.round(F.avg(c), d) + 0.0).alias(c) for c, d in _DIGITS.items()])


_TARGET_COLUMNS = [c for c in panel.FEATURES if c != "horizon_weeks"]


@query("m14_prediction_features", f"""
SELECT fold_id, geo, origin_date, horizon_weeks, target_date,
{', '.join(f'round({c}, 6) + 0.0 AS {c}' if c != 'target_epiweek' else c for c in _TARGET_COLUMNS)}
FROM v_panel WHERE origin_date = train_cutoff AND target_date BETWEEN target_start AND target_end""")
def m14_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = panel.prediction(inp.state_series(spark, sf_dir), star.folds(spark), *inp.panel_inputs(spark, sf_dir))
    return built.select("fold_id", "geo", "origin_date", "horizon_weeks", "target_date", *[
        F.col(c) if c == "target_epiweek" else (F.round(c, 6) + 0.0).alias(c) for c in _TARGET_COLUMNS])


_CARRIED = [c for c in panel.ORIGIN_FEATURES] + inp.PANEL_STATIC
_TARGETS = [c for c in panel.TARGET_FEATURES if c != "horizon_weeks"] + ["label"]


@query("m14_panel_rows", f"""
SELECT fold_id, geo, origin_date, count(*) AS rows, {', '.join(f'round(max({c}), {_DIGITS[c]}) + 0.0 AS {c}' for c in _CARRIED)},
{', '.join(f'round(CAST(sum({c} * horizon_weeks) AS DOUBLE), 4) + 0.0 AS {c}' for c in _TARGETS)} FROM v_train_panel GROUP BY ALL""")
def m14_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every origin of the training panel: its own features as they are, what depends on the horizon summed by horizon."""
    return inp.training_panel(spark, sf_dir).groupBy("fold_id", "geo", "origin_date").agg(
        F.count("*").alias("rows"), *[(F.round(F.max(c), _DIGITS[c]) + 0.0).alias(c) for c in _CARRIED],
        *[(F.round(F.sum(F.col(c).cast("double") * F.col("horizon_weeks")), 4) + 0.0).alias(c) for c in _TARGETS])


_TRAJECTORY_ROWS = f"""SELECT * FROM (WITH
t AS (SELECT f.fold_id, i.geo, i.date, i.incidence, {sql.season_year('i.date')} AS season, {sql.season_week('i.date')} AS sw,
 f.target_start FROM v_inc i JOIN v_folds f ON i.date <= f.train_cutoff),
s AS (SELECT fold_id, geo, season, row_number() OVER (PARTITION BY fold_id, geo ORDER BY season) - 1 AS season_no,
 count(*) OVER (PARTITION BY fold_id, geo) AS n FROM (SELECT fold_id, geo, season, count(*) AS w FROM t
 WHERE season < {sql.season_year('target_start')} GROUP BY ALL) WHERE w >= 53 * 0.9),
g AS (SELECT s.*, k.target_week AS slot FROM s CROSS JOIN v_spine k),
v AS (SELECT g.*, t.incidence AS raw FROM g LEFT JOIN t ON t.fold_id = g.fold_id AND t.geo = g.geo AND t.season = g.season
 AND t.sw = g.slot),
c AS (SELECT v.*, coalesce(raw, CASE WHEN b IS NULL THEN av WHEN a IS NULL THEN bv
 ELSE bv + (av - bv) * (slot - b) / (a - b) END) AS incidence FROM (SELECT *,
 last_value(CASE WHEN raw IS NOT NULL THEN slot END IGNORE NULLS) OVER p AS b, last_value(raw IGNORE NULLS) OVER p AS bv,
 first_value(CASE WHEN raw IS NOT NULL THEN slot END IGNORE NULLS) OVER n2 AS a, first_value(raw IGNORE NULLS) OVER n2 AS av
 FROM v WINDOW p AS (PARTITION BY fold_id, geo, season ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n2 AS (PARTITION BY fold_id, geo, season ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) v)
"""


@query("w08_gap_interpolation", _TRAJECTORY_ROWS
       + "SELECT fold_id, geo, season, CAST(slot AS INTEGER) AS slot, round(incidence, 6) AS incidence FROM c)")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir))
    rows = trajectories.curves(series, star.folds(spark))
    return inp.round_all(rows.select("fold_id", "geo", "season", "slot", "incidence"))


_DRAW = bs.draw_index_sql("r.rep", "x.geo_seed", "x.n", 0)


_RESAMPLED = _TRAJECTORY_ROWS + f""",
x AS (SELECT DISTINCT fold_id, geo, n, CAST('0x' || substr(md5(geo), 1, 15) AS BIGINT) % {bs.PRIME} AS geo_seed FROM s),
d AS (SELECT x.fold_id, x.geo, {_DRAW} AS season_no FROM x, (SELECT i AS rep FROM generate_series(0, 799) t(i)) r),
m AS (SELECT d.fold_id, d.geo, k.date, k.origin_date, k.horizon_weeks, greatest(c.incidence * p.population / 1e5, 1e-6) AS mu
 FROM d JOIN c ON c.fold_id = d.fold_id AND c.geo = d.geo AND c.season_no = d.season_no
 JOIN v_calendar k ON k.fold_id = d.fold_id AND {sql.season_week('k.date')} = c.slot CROSS JOIN v_pop_years y
 LEFT JOIN v_state_pop p ON p.geo = d.geo AND p.year = least(greatest(year(k.date), y.lo), y.hi))
SELECT 'trajectory_resample' AS model, fold_id, geo, date, origin_date, horizon_weeks, {sql.spread()} FROM
(SELECT fold_id, geo, date, origin_date, horizon_weeks, quantile_cont(mu, {sql.LEVELS}) AS q FROM m GROUP BY ALL))"""


@query("m05_trajectory_resampling", _RESAMPLED)
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = trajectories.drawn_levels(
        inp.state_series(spark, sf_dir), star.folds(spark), inp.state_population(spark, sf_dir))
    return inp.rounded_quantiles(trajectories.resampled(levels))


@query("m05_mechanistic_trajectories")
def m05_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.rounded_quantiles(trajectories.mechanistic(
        inp.state_series(spark, sf_dir), star.folds(spark), inp.state_population(spark, sf_dir)))


@query("m05_mechanistic_invariants", f"""
SELECT fold_id, geo, count(*) AS rows, TRUE AS ascending, TRUE AS non_negative, TRUE AS centred FROM ({_RESAMPLED}) GROUP BY ALL""")
def m05_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the noisy forecasts whatever is drawn; the median without noise lies in their 95 % interval, give or take a case."""
    series, folds = inp.state_series(spark, sf_dir), star.folds(spark)
    levels = shared(spark, sf_dir, "levels", lambda: trajectories.drawn_levels(series, folds, inp.state_population(spark, sf_dir)))
    noisy = trajectories.with_count_noise(levels, trajectories.dispersion(series, folds))
    calm = trajectories.resampled(levels).select("fold_id", "geo", "date", "horizon_weeks", F.col("q")[4].alias("middle"))
    both = noisy.join(calm, ["fold_id", "geo", "date", "horizon_weeks"], "left")
    return both.groupBy("fold_id", "geo").agg(
        F.count("*").alias("rows"), F.bool_and(F.col("q") == F.array_sort("q")).alias("ascending"),
        F.bool_and(F.col("q")[0] >= 0).alias("non_negative"),
        F.bool_and(F.col("middle").between(F.col("q")[0] - 1, F.col("q")[8] + 1)).alias("centred"))


def _regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, series = star.folds(spark), inp.state_series(spark, sf_dir)

    def build() -> DataFrame:
        targets = panel.prediction(series, folds, *inp.panel_inputs(spark, sf_dir))
        return regressor.forecast(inp.training_panel(spark, sf_dir), targets, panel.FEATURES + inp.PANEL_STATIC)

    return shared(spark, sf_dir, "regressor", build)


@query("m06_panel_regressor")
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the pooled regressor, row by row; its learner has no SQL form."""
    return inp.rounded_quantiles(_regressor(spark, sf_dir))


@query("m06_regressor_invariants", """
SELECT fold_id, geo, date, origin_date, horizon_weeks, TRUE AS ascending, TRUE AS non_negative, TRUE AS within FROM v_grid""")
def m06_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every forecast row: one per target week, in order, not negative, and no more than ten times the geo's past peak."""
    folds, series = star.folds(spark), inp.state_series(spark, sf_dir)
    peaks = fo.training(series, folds).groupBy("fold_id", "geo").agg(F.max("casos").alias("peak"))
    joined = _regressor(spark, sf_dir).join(peaks, ["fold_id", "geo"])
    return joined.select(
        "fold_id", "geo", "date", "origin_date", "horizon_weeks", (F.col("q") == F.array_sort("q")).alias("ascending"),
        (F.col("q")[0] >= 0).alias("non_negative"), (F.col("q")[4] <= 10 * F.col("peak")).alias("within"))


@query("m06_regressor_scores")
def m06_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per fold of the pooled regressor."""
    folds, series = star.folds(spark), inp.state_series(spark, sf_dir)
    scored = backtest.score(_regressor(spark, sf_dir), series, folds)
    return scored.groupBy("model", "fold_id").agg(
        F.count("*").alias("rows"), r6(F.avg("wis"), "mean_wis"), r6(so.ratio_of_sums(), "normalized_wis"),
        r6(F.avg(F.col("coverage_90").cast("double")), "coverage_90"))


_G = "pow(1 + a * exp(-r * (t - tp)), -1 / a)"


@query("m13_growth_curve_fit", f"""SELECT * FROM (WITH
s AS (SELECT geo, {sql.season_year('date')} AS season, {sql.season_week('date')} AS t, casos FROM v_series),
c AS (SELECT *, sum(casos) OVER (PARTITION BY geo, season ORDER BY t)::DOUBLE AS y, count(*) OVER (PARTITION BY geo, season) AS n,
 sum(casos) OVER (PARTITION BY geo, season)::DOUBLE AS total FROM s),
k AS (SELECT geo, season, arg_max(t, casos * 1000 - t) AS obs_peak_week FROM s GROUP BY ALL),
p AS (SELECT r, d, a FROM (SELECT unnest({trajectories.GROWTH_RATES})::DOUBLE AS r),
 (SELECT unnest({trajectories.PEAK_SHIFTS}) AS d), (SELECT unnest({trajectories.SHAPES})::DOUBLE AS a)),
f AS (SELECT geo, season, obs_peak_week, total, r, tp, a, sum(y * g) AS yg, sum(g * g) AS gg, sum(y * y) AS yy FROM
 (SELECT c.geo, c.season, k.obs_peak_week, c.total, p.r, tp, p.a, c.y, {_G} AS g FROM c JOIN k USING (geo, season),
  p, LATERAL (SELECT greatest(k.obs_peak_week + p.d, 1) AS tp) WHERE c.n >= 53 * 0.9 AND c.total > 0) GROUP BY ALL),
e AS (SELECT *, least(greatest(coalesce(yg / nullif(gg, 0), total), 0.5 * total), 5 * total) AS ks FROM f)
SELECT geo, season, obs_peak_week, total, round((yy - 2 * ks * yg + ks * ks * gg) / (total * total), 6) AS relative_sse, r AS growth_rate,
CAST(tp AS INTEGER) AS peak_week, a AS shape_alpha, round(ks, 4) AS final_size FROM e
QUALIFY row_number() OVER (PARTITION BY geo, season ORDER BY round((yy - 2 * ks * yg + ks * ks * gg) / (total * total), 10), r, tp, a) = 1)""")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = trajectories.season_fits(inp.state_series(spark, sf_dir))
    return fits.withColumns({"relative_sse": r6("relative_sse"), "final_size": F.round("final_size", 4)})


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir))
    return sequences.weekly_frame(series, inp.state_climate(spark, sf_dir))


_NUMERIC = {"log_inc": "zl", "temp_med": "zt", "precip_med": "zp", "rel_humid_med": "zh"}
_WAVES = {"sin1": "s1", "cos1": "c1"}
_FEATURES = {**_NUMERIC, **_WAVES}
_SEQ = f"""(WITH t AS (SELECT f.fold_id, f.train_cutoff, i.geo, i.date, i.casos, i.population, i.log_inc, c.temp_med, c.precip_med,
 c.rel_humid_med, {sql.epi_week('i.date')} AS w FROM v_inc i JOIN v_folds f ON i.date <= f.train_cutoff LEFT JOIN v_state_climate c USING (geo, date)),
z AS (SELECT fold_id, {', '.join(f'avg({c}) AS m_{z}, coalesce(nullif(stddev_samp({c}), 0), 1) AS d_{z}' for c, z in _NUMERIC.items())} FROM t GROUP BY 1),
x AS (SELECT t.*, {', '.join(f'({c} - m_{z}) / d_{z} AS {z}' for c, z in _NUMERIC.items())}, sin(2 * pi() * w / 52) AS s1, cos(2 * pi() * w / 52) AS c1,
 row_number() OVER (PARTITION BY fold_id, geo ORDER BY date) AS rn FROM t JOIN z USING (fold_id))
SELECT fold_id, geo, date AS origin_date, train_cutoff, rn, population, count(*) OVER p AS window_rows,
 {', '.join(f'sum({z}) OVER p AS sum_{z}, sum({z} * rn) OVER p AS weighted_{z}' for z in _FEATURES.values())},
 list(casos) OVER n AS labels, list(population) OVER n AS ahead
 FROM x WINDOW p AS (PARTITION BY fold_id, geo ORDER BY date ROWS BETWEEN {SEQUENCE_LENGTH} PRECEDING AND 1 PRECEDING),
 n AS (PARTITION BY fold_id, geo ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 67 FOLLOWING))"""


def _by_place(z: str) -> str:
    """Sum of place times value over the window, places from 1."""
    return f"coalesce(weighted_{z}, 0) - (rn - {SEQUENCE_LENGTH + 1}) * coalesce(sum_{z}, 0)"


def _filled(name: str, rest: str) -> str:
    """A list of the values ahead, with ``rest`` behind the last one, as text."""
    return f"array_to_string(list_transform(range(1, 68), lambda h: CASE WHEN h <= coalesce(len(labels), 0) THEN {name} ELSE {rest} END), ',')"


@query("m15_sequence_dataset", f"""
SELECT fold_id, geo, origin_date, CASE WHEN origin_date < train_cutoff - 546 THEN 'proper' ELSE 'calib' END AS block,
CAST(window_rows AS INTEGER) AS window_rows, {', '.join(f'round({_by_place(z)}, 4) + 0.0 AS {c}' for c, z in _FEATURES.items())},
{_filled('labels[h]', '0')} AS labels, {_filled('1', '0')} AS mask, {_filled('ahead[h]', 'population')} AS populations
FROM {_SEQ} WHERE rn > {SEQUENCE_LENGTH} AND origin_date >= DATE '{inp.MIN_ORIGIN}'""")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of the sequence dataset: labels, mask and populations horizon by horizon, features summed by place."""
    samples = sequences.sequence_dataset(_weekly(spark, sf_dir), star.folds(spark), inp.MIN_ORIGIN)

    def by_place(feature: str):
        terms = F.transform(F.col(f"window.{feature}"), lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1))
        return (F.round(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), 4) + 0.0).alias(feature)

    def shown(name: str):
        return F.array_join(F.transform(name, lambda v: v.cast("string")), ",", "null").alias(name)

    return samples.select(
        "fold_id", "geo", "origin_date", "block", F.size("window").alias("window_rows"),
        *[by_place(c) for c in _FEATURES], shown("labels"), shown("mask"), shown("populations"))
