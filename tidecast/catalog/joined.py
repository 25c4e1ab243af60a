"""Joins, windows, sorts and set operations (sections 2.4, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.inputs import r6
from tidecast.catalog.registry import query
from tidecast.constants import CLIMATE_COLUMNS, INDEX_LAGS, INDICES, MAX_HORIZON
from tidecast.functions import calendar as cal
from tidecast.operators import explore as ex
from tidecast.operators import folds as fo
from tidecast.operators import joins as jn
from tidecast.operators import quality as ql
from tidecast.operators import rollup
from tidecast.operators import scores as so
from tidecast.operators import windows as wn
from tidecast.plans import backtest, baselines
from tidecast.plans.hierarchical import region_of
from tidecast.sources import star


@query("j01_fact_geography", "SELECT geocode, date, uf, casos FROM v_cases")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = star.geo_map(spark, sf_dir).select("geocode", "uf").dropDuplicates()
    return star.weekly_counts(spark, sf_dir).join(geo, "geocode")


@query("j02_clamped_year_municipal", "SELECT geocode, date, w AS weight FROM v_climate_w")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = star.climate(spark, sf_dir).join(
        star.geo_map(spark, sf_dir).filter(F.col("uf") != star.EXCLUDED), "geocode", "left_semi")
    weighted = rollup.attach_population(kept, star.population(spark, sf_dir), key="geocode", as_name="weight",
                                        years=star.population_years(spark, sf_dir))
    return weighted.select("geocode", "date", F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"))


@query("j03_clamped_year_state", "SELECT geo, date, population FROM v_inc")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = rollup.attach_population(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir))
    return joined.select("geo", "date", "population")


@query("j04_weekly_covariate", f"SELECT geo, date, casos, {', '.join(sql.r6(c, c) for c in CLIMATE_COLUMNS)} "
       "FROM v_series LEFT JOIN v_state_climate USING (geo, date)")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(inp.state_series(spark, sf_dir).join(inp.state_climate(spark, sf_dir), ["geo", "date"], "left"))


@query("j05_national_covariate", f"SELECT geo, date, casos, {', '.join(sql.r6(c, c) for c in INDICES)} "
       "FROM v_series LEFT JOIN v_ocean USING (date)")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(inp.state_series(spark, sf_dir).join(F.broadcast(star.ocean(spark, sf_dir)), "date", "left"))


@query("j06_origin_features", """
SELECT g.fold_id, g.geo, g.origin_date, g.horizon_weeks, s.casos AS origin_casos FROM v_grid g
LEFT JOIN v_series s ON s.geo = g.geo AND s.date = g.origin_date""")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = inp.state_series(spark, sf_dir)
    grid = fo.target_grid(series.select("geo").distinct(), star.folds(spark))
    origin = series.select("geo", F.col("date").alias("origin_date"), F.col("casos").alias("origin_casos"))
    joined = grid.join(origin, ["geo", "origin_date"], "left")
    return joined.select("fold_id", "geo", "origin_date", "horizon_weeks", "origin_casos")


@query("j07_label_self_join", """
SELECT s.geo, CAST(h AS INTEGER) AS horizon_weeks, count(*) AS pairs, count(y.casos) AS labels,
CAST(sum(y.casos) AS BIGINT) AS label_sum FROM v_series s CROSS JOIN generate_series(1, 67) t(h)
LEFT JOIN v_series y ON y.geo = s.geo AND y.date = s.date + CAST(7 * h AS INTEGER) GROUP BY ALL""")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by horizon. On a dense series the equi self-join is a look at the following rows."""
    ahead = wn.leading_values("casos", ["geo"], MAX_HORIZON)
    rows = inp.state_series(spark, sf_dir).select("geo", ahead.alias("ahead"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(MAX_HORIZON)), lambda h: F.struct(
        h.alias("horizon_weeks"), F.get("ahead", h - 1).alias("label")))
    pairs = rows.select("geo", F.inline(steps))
    return pairs.groupBy("geo", "horizon_weeks").agg(
        F.count("*").alias("pairs"), F.count("label").alias("labels"), F.sum("label").alias("label_sum"))


@query("j08_static_zero_fill", f"""
SELECT n_name AS geo, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in inp.PANEL_STATIC)}
FROM nation LEFT JOIN v_static ON geo = n_name""")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    geos = star.table(spark, sf_dir, "nation").select(F.col("n_name").alias("geo"))
    joined = geos.join(inp.static_shares(spark, sf_dir), "geo", "left")
    return inp.round_all(joined.na.fill(0.0, inp.PANEL_STATIC).select("geo", *inp.PANEL_STATIC))


@query("j09_as_of_join", """
SELECT o.geo, o.origin_month, o.target_month, round(i.seasonal_temp, 9) AS temp_med, round(i.seasonal_humid, 9) AS umid_med,
round(i.seasonal_precip, 9) AS precip_tot FROM (SELECT geo, m AS origin_month, CAST(m + to_months(CAST(k AS INTEGER)) AS DATE) AS target_month FROM
 (SELECT DISTINCT geo, CAST(date_trunc('month', date) AS DATE) AS m FROM v_series), generate_series(1, 6) t(k)) o
LEFT JOIN v_issued i USING (geo, origin_month, target_month)""")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = inp.state_series(spark, sf_dir).select("geo", cal.month_start(F.col("date")).alias("origin_month")).distinct()
    wanted = origins.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(6)))).select(
        "geo", "origin_month", F.add_months("origin_month", F.col("_k")).alias("target_month"))
    values = inp.SEASONAL_VALUES
    seasonal = inp.state_seasonal(spark, sf_dir).select("geo", "target_month", "reference_month", *values)
    joined = jn.as_of(wanted, seasonal, ["geo", "target_month"], "origin_month", "reference_month", values)
    return inp.round_all(joined.select("geo", "origin_month", "target_month", *values), 9)


@query("j10_seasonal_anchor", f"""
SELECT o.geo, o.target_epiweek, count(*) AS origins, count(y.log_inc) AS anchored, round(avg(y.log_inc), 6) AS mean_anchor
FROM (SELECT DISTINCT geo, date AS origin_date, {sql.epi_week('(date + CAST(7 * h AS INTEGER))')} AS target_epiweek
 FROM v_series, generate_series(1, 67) t(h)) o
LEFT JOIN (SELECT a.date AS origin_date, e AS target_epiweek, max(w.date) AS anchor FROM v_weeks a, v_weeks w,
 LATERAL (SELECT {sql.epi_week('w.date')} AS e) WHERE w.date <= a.date GROUP BY ALL) k
 ON k.origin_date = o.origin_date AND k.target_epiweek = o.target_epiweek
LEFT JOIN v_inc y ON y.geo = o.geo AND y.date = k.anchor GROUP BY ALL""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir)).select(
        "geo", "date", "log_inc")
    pairs = jn.horizon_expansion(series.select("geo", F.col("date").alias("origin_date")), MAX_HORIZON)
    origins = pairs.select("geo", "origin_date", cal.epi_week(F.col("target_date")).alias("target_epiweek")).distinct()
    anchored = jn.seasonal_anchor(origins, series, "log_inc")
    return anchored.groupBy("geo", "target_epiweek").agg(
        F.count("*").alias("origins"), F.count("seasonal_anchor").alias("anchored"),
        r6(F.avg("seasonal_anchor"), "mean_anchor"))


@query("j11_target_grid", "SELECT geo, fold_id, origin_date, date, horizon_weeks FROM v_grid")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    geos = inp.state_series(spark, sf_dir).select("geo").distinct()
    return fo.target_grid(geos, star.folds(spark)).select("geo", "fold_id", "origin_date", "date", "horizon_weeks")


@query("j12_horizon_expansion", """
SELECT CAST(h AS INTEGER) AS horizon_weeks, count(*) AS pairs, min(date + CAST(7 * h AS INTEGER)) AS first_target,
max(date + CAST(7 * h AS INTEGER)) AS last_target FROM v_series, generate_series(1, 67) t(h) GROUP BY 1""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = inp.state_series(spark, sf_dir).select("geo", F.col("date").alias("origin_date"))
    return jn.horizon_expansion(origins, MAX_HORIZON).groupBy("horizon_weeks").agg(
        F.count("*").alias("pairs"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"))


@query("j13_forecast_observation", f"""
SELECT fold_id, geo, date, {sql.r6('pred', 'pred')}, observed_value FROM v_clim_scored""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, series = star.folds(spark), inp.state_series(spark, sf_dir)
    scored = backtest.score(baselines.climatological(series, folds), series, folds)
    return inp.round_all(scored.select("fold_id", "geo", "date", "pred", "observed_value"))


@query("j14_forecast_grid", f"""
SELECT m.fold_id, m.geo, m.date, round(m.q[5], 6) AS pred, g.horizon_weeks FROM v_snaive m
LEFT JOIN v_grid g USING (fold_id, geo, date)""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, series = star.folds(spark), inp.state_series(spark, sf_dir)
    forecasts = baselines.seasonal_naive(series, folds).select("fold_id", "geo", "date", r6(F.col("q")[4], "pred"))
    grid = fo.target_grid(series.select("geo").distinct(), folds).select("fold_id", "geo", "date", "horizon_weeks")
    return forecasts.join(grid, ["fold_id", "geo", "date"], "left")


@query("j15_key_aligned_concat", """
SELECT CAST(a.year AS INTEGER) AS year, a.casos, round(o.enso, 6) AS enso FROM
(SELECT year(date) AS year, CAST(sum(casos) AS BIGINT) AS casos FROM v_state GROUP BY 1) a
JOIN (SELECT year(date) AS year, avg(enso) AS enso FROM v_ocean GROUP BY 1) o ON o.year = a.year""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("date").alias("year")
    totals = inp.state_cases(spark, sf_dir).groupBy(year).agg(F.sum("casos").alias("casos"))
    index = star.ocean(spark, sf_dir).groupBy(year).agg(r6(F.avg("enso"), "enso"))
    return totals.join(index, "year", "full").dropna()


@query("j16_reindex", f"""
SELECT s.geo, s.season_year, s.date, c.casos FROM (SELECT geo, season_year,
CAST(unnest(generate_series({sql.epi_start('season_year - 1', 41)}, {sql.epi_start('season_year', 40)}, INTERVAL 7 DAY)) AS DATE) AS date
FROM (SELECT DISTINCT geo, {sql.season_year('date')} + 1 AS season_year FROM v_state)) s LEFT JOIN v_state c USING (geo, date)""")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = inp.state_cases(spark, sf_dir)
    groups = state.select("geo", (cal.season_start_year(F.col("date")) + 1).alias("season_year")).distinct()
    return jn.reindex(state, jn.season_spine(groups), ["geo", "date"]).select("geo", "season_year", "date", "casos")


@query("j17_anti_join", "SELECT s.geo, s.date FROM v_series s ANTI JOIN v_state c USING (geo, date)")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = inp.state_series(spark, sf_dir).select("geo", "date")
    return expected.join(inp.state_cases(spark, sf_dir), ["geo", "date"], "left_anti")


@query("j18_step_differences", """
SELECT fold_id, geo, h, count(*) AS n, CAST(sum(diff) AS BIGINT) AS total, min(diff) AS low, max(diff) AS high
FROM v_diffs GROUP BY ALL""")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = fo.training(baselines.step_differences(inp.state_series(spark, sf_dir)), star.folds(spark))
    return steps.groupBy("fold_id", "geo", "h").agg(
        F.count("*").alias("n"), F.sum("diff").alias("total"), F.min("diff").alias("low"), F.max("diff").alias("high"))


@query("j19_region_lookup", """
SELECT region, count(*) AS rows, CAST(sum(casos) AS BIGINT) AS casos FROM v_series LEFT JOIN v_region USING (geo) GROUP BY 1""")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = inp.state_series(spark, sf_dir).join(region_of(star.geo_map(spark, sf_dir)), "geo", "left")
    return joined.groupBy("region").agg(F.count("*").alias("rows"), F.sum("casos").alias("casos"))


@query("j20_metric_table_join", """
SELECT model, round(sum(wis) / sum(observed_value), 6) AS nwis_all, round(sum(wis) FILTER (fold_id <> 2)
/ sum(observed_value) FILTER (fold_id <> 2), 6) AS nwis_without_outlier FROM v_all_scored GROUP BY 1""")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.two_leaderboards(inp.all_scored(spark, sf_dir)))


@query("j21_skill_by_region", """
SELECT n_name AS geo, round(s.nwis, 6) AS normalized_wis FROM nation LEFT JOIN (SELECT geo, sum(wis) / sum(observed_value) AS nwis
FROM v_all_scored WHERE model = 'ensemble_conformal' GROUP BY 1) s ON s.geo = n_name""")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = inp.all_scored(spark, sf_dir).filter(F.col("model") == "ensemble_conformal")
    geos = star.table(spark, sf_dir, "nation").select(F.col("n_name").alias("geo"))
    return inp.round_all(geos.join(so.normalized_wis(chosen, ["geo"]), "geo", "left"))


@query("j22_lag_scale", """
SELECT geo, round(avg(abs(step)), 6) AS scale FROM (SELECT geo, casos - lag(casos, 52) OVER (PARTITION BY geo ORDER BY date)
AS step FROM v_series) GROUP BY 1""")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.lag_scale(inp.state_series(spark, sf_dir), ["geo"]))


# ---- windows ----

def _log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir))


def _rounded(names: list[str]) -> str:
    return ", ".join(sql.r6(n, n) for n in names)


_LAG_NAMES = ["lag_1", "lag_2", "lag_3", "lag_4", "lag_8", "lag_52"]


@query("w01_autoregressive_lags", f"SELECT geo, date, {_rounded(_LAG_NAMES)} FROM v_origin")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _log_series(spark, sf_dir).withColumns(wn.autoregressive_lags("log_inc", ["geo"]))
    return inp.round_all(df.select("geo", "date", *_LAG_NAMES))


def _rolling(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    df = _log_series(spark, sf_dir).withColumns(wn.rolling("log_inc", ["geo"]))
    return inp.round_all(df.select("geo", "date", *names))


@query("w02_rolling_mean", f"SELECT geo, date, {_rounded(['roll_mean_4', 'roll_mean_8'])} FROM v_origin")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, ["roll_mean_4", "roll_mean_8"])


@query("w03_rolling_std", f"SELECT geo, date, {_rounded(['roll_std_4'])} FROM v_origin")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, ["roll_std_4"])


@query("w04_rolling_max", f"SELECT geo, date, {_rounded(['roll_max_12'])} FROM v_origin")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir, ["roll_max_12"])


_ROLL4 = [f"{c}_roll4" for c in CLIMATE_COLUMNS]


@query("w05_rolling_climate", f"SELECT geo, date, {_rounded(_ROLL4)} FROM v_origin")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = inp.state_climate(spark, sf_dir).withColumns(wn.climate_rolling(["geo"])).select("geo", "date", *_ROLL4)
    return inp.round_all(inp.state_series(spark, sf_dir).select("geo", "date").join(smooth, ["geo", "date"], "left"))


@query("w06_temperature_anomaly", "SELECT fold_id, geo, date, round(temp_anomaly, 6) + 0.0 AS temp_anomaly FROM v_origin_fold")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, folds = ["fold_id", "geo", "date"], star.folds(spark)
    known = fo.training(wn.with_epi_week(inp.state_climate(spark, sf_dir)), folds)
    value = F.round(wn.anomaly("temp_med", ["fold_id", "geo"]), 6) + 0.0
    cut = fo.training(inp.state_series(spark, sf_dir), folds).select(*keys)
    return cut.join(known.select(*keys, value.alias("temp_anomaly")), keys, "left")


_INDEX_NAMES = [f"{i}_lag{k}" for i in INDICES for k in INDEX_LAGS]


@query("w07_national_lags", f"SELECT date, {_rounded(_INDEX_NAMES)} FROM v_ocean_lags")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(wn.index_lags(star.ocean(spark, sf_dir)))


@query("w09_cumulative_season_curve", f"""
SELECT geo, season, date, CAST(sum(casos) OVER w AS BIGINT) AS cumulative, casos - lag(casos, 1, 0) OVER w AS difference
FROM (SELECT *, {sql.season_year('date')} AS season FROM v_series) WINDOW w AS (PARTITION BY geo, season ORDER BY date)""")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = inp.state_series(spark, sf_dir).withColumn("season", cal.season_start_year(F.col("date")))
    curve = wn.cumulative(tagged, ["geo", "season"], "casos")
    return curve.select("geo", "season", "date", "cumulative", "difference")


@query("w10_sequence_window", """
SELECT geo, date, CAST(n AS INTEGER) AS rows, round(total, 6) AS log_inc_sum, round(first_value, 6) AS oldest FROM
(SELECT geo, date, count(*) OVER w AS n, sum(log_inc) OVER w AS total, first_value(log_inc) OVER w AS first_value FROM v_inc
 WINDOW w AS (PARTITION BY geo ORDER BY date ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING)) WHERE n = 104""")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = wn.trailing_sequence(["log_inc", "casos"], ["geo"], 104, include_origin=False)
    rows = _log_series(spark, sf_dir).select("geo", "date", window.alias("w")).filter(F.col("w").isNotNull())
    total = F.aggregate("w.log_inc", F.lit(0.0), lambda s, v: s + v)
    return rows.select("geo", "date", F.size("w").alias("rows"), r6(total, "log_inc_sum"),
                       r6(F.col("w")[0]["log_inc"], "oldest"))


@query("w11_label_array", """
SELECT geo, date, coalesce(array_to_string(list(casos) OVER w, ','), '') AS labels, CAST(count(*) OVER w AS INTEGER) AS valid
FROM v_series WINDOW w AS (PARTITION BY geo ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 67 FOLLOWING)""")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label array of every week, position by position."""
    rows = inp.state_series(spark, sf_dir).select("geo", "date", wn.leading_values("casos", ["geo"], 67).alias("labels"))
    shown = F.array_join(F.transform("labels", lambda v: v.cast("string")), ",", "null")
    return rows.select("geo", "date", shown.alias("labels"), F.size("labels").alias("valid"))


@query("w12_model_ranks", """
SELECT model, round(wis, 6) AS wis, round(nwis, 6) AS nwis, (rank() OVER (ORDER BY wis) + (count(*) OVER (PARTITION BY wis) - 1) / 2)
AS wis_rank, (rank() OVER (ORDER BY nwis) + (count(*) OVER (PARTITION BY nwis) - 1) / 2) AS nwis_rank FROM
(SELECT model, avg(wis) AS wis, sum(wis) / sum(observed_value) AS nwis FROM v_all_scored GROUP BY 1)""")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = inp.all_scored(spark, sf_dir).groupBy("model").agg(
        F.avg("wis").alias("wis"), so.ratio_of_sums().alias("nwis"))
    return inp.round_all(so.average_rank(board, ["wis", "nwis"]))


@query("w13_group_total", """
SELECT geo, date, casos, CAST(sum(casos) OVER (PARTITION BY date) AS BIGINT) AS national FROM v_state""")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.state_cases(spark, sf_dir).withColumn("national", wn.group_total("casos", ["date"]))


# ---- sorts and set operations ----

@query("t01_sorted_leaderboard", "SELECT model, round(avg(wis), 6) AS wis FROM v_all_scored GROUP BY 1 ORDER BY wis")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(inp.all_scored(spark, sf_dir).groupBy("model").agg(F.avg("wis").alias("wis"))).orderBy("wis")


@query("t02_top_groups", """
SELECT s.geo, count(*) AS weeks, CAST(sum(casos) AS BIGINT) AS total FROM v_state s WHERE geo IN (SELECT geo FROM v_state
GROUP BY 1 ORDER BY sum(casos) DESC, geo LIMIT 6) GROUP BY 1""")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = inp.state_cases(spark, sf_dir)
    kept = state.join(ex.top_groups(state, 6).select("geo"), "geo", "left_semi")
    return kept.groupBy("geo").agg(F.count("*").alias("weeks"), F.sum("casos").alias("total"))


@query("t03_drop_duplicates", "SELECT DISTINCT geocode, uf FROM v_cases")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.cases(spark, sf_dir).select("geocode", "uf").dropDuplicates()


@query("u01_union_by_name", """
SELECT model, disease, count(*) AS rows, count(origin_date) AS with_origin FROM
(SELECT model, 'dengue' AS disease, origin_date FROM v_scored UNION ALL SELECT model, NULL, NULL FROM v_ensembles_scored)
GROUP BY ALL""")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = inp.members_scored(spark, sf_dir).withColumn("disease", F.lit("dengue"))
    combined = inp.ensembles(spark, sf_dir).drop("origin_date")
    stacked = members.unionByName(combined, allowMissingColumns=True)
    return stacked.groupBy("model", "disease").agg(F.count("*").alias("rows"), F.count("origin_date").alias("with_origin"))


@query("u02_set_equality", """
SELECT (SELECT count(*) FROM (SELECT geocode FROM v_cities EXCEPT SELECT geocode FROM v_flagged WHERE target_city)) = 0 AND
(SELECT count(*) FROM (SELECT geocode FROM v_flagged WHERE target_city EXCEPT SELECT geocode FROM v_cities)) = 0 AS equal""")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = star.flagged_cases(spark, sf_dir).filter("target_city").select("geocode")
    expected = star.target_cities(spark, sf_dir)
    differing = flagged.subtract(expected).unionByName(expected.subtract(flagged))
    return differing.agg((F.count("*") == 0).alias("equal"))


@query("u03_set_difference", """
SELECT count(*) FILTER (b.geocode IS NULL) AS missing, count(*) FILTER (a.geocode IS NULL) AS extra FROM
(SELECT DISTINCT geocode FROM v_cases) a FULL JOIN (SELECT DISTINCT geocode FROM v_access) b ON a.geocode = b.geocode""")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.set_difference(star.weekly_counts(spark, sf_dir), star.access(spark, sf_dir), "geocode")
