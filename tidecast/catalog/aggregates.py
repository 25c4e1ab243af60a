"""Aggregations (section 2.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.inputs import MEMBERS, r6
from tidecast.catalog.registry import query
from tidecast.constants import CLIMATE_COLUMNS, INTERVAL_LEVELS, METRIC_COLUMNS, QUANTILE_COLUMNS, QUANTILE_LEVELS
from tidecast.functions import quantiles as qt
from tidecast.functions import scoring as sc
from tidecast.operators import bootstrap as bs
from tidecast.operators import ensemble as en
from tidecast.operators import explore as ex
from tidecast.operators import folds as fo
from tidecast.operators import order_stats as os_
from tidecast.operators import quality as ql
from tidecast.operators import rollup
from tidecast.operators import scores as so
from tidecast.plans import baselines, trajectories
from tidecast.plans.hierarchical import shrinkage_weights, volumes
from tidecast.plans.sequences import standardisation
from tidecast.sources import star


@query("a01_sum_to_state", "SELECT * FROM v_state")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.state_cases(spark, sf_dir)


def _weighted_sql(keys: str) -> str:
    cols = ", ".join(sql.r6(f"sum({c} * w) / sum(w)", c) for c in CLIMATE_COLUMNS)
    return f"SELECT {keys}, {cols} FROM v_climate_w GROUP BY {keys}"


def _weighted(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    return inp.round_all(rollup.weighted_mean(
        star.climate(spark, sf_dir), star.population(spark, sf_dir), star.geo_map(spark, sf_dir), by,
        CLIMATE_COLUMNS, star.EXCLUDED, star.population_years(spark, sf_dir)))


@query("a02_population_weighted_mean", _weighted_sql("uf, date"))
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir, ["uf", "date"])


@query("a03_national_weighted_mean", _weighted_sql("date"))
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir, ["date"])


@query("a04_state_population", "SELECT * FROM v_state_pop")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.state_population(star.population(spark, sf_dir), star.geo_map(spark, sf_dir))


@query("a05_weighted_seasonal_forecast", f"""
SELECT geo, reference_month, forecast_months_ahead, target_month,
       {', '.join(f'round({c}, 9) AS {c}' for c in inp.SEASONAL_VALUES)} FROM v_seasonal""")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(inp.state_seasonal(spark, sf_dir), 9)


_SHARES = ", ".join(
    sql.r6(f"coalesce(sum(CASE WHEN {col} = '{v}' THEN w ELSE 0 END)::DOUBLE / nullif(sum(w), 0), 0)",
           f"{col}_frac_{v.replace(' ', '_')}")
    for col, values in (("koppen", star.KOPPEN), ("biome", star.BIOMES)) for v in values
)


@query("a06_category_shares", f"""
SELECT uf AS geo, {_SHARES} FROM (SELECT e.*, g.uf, coalesce(p.population, 0) AS w FROM v_environment e
JOIN v_geo g USING (geocode) LEFT JOIN v_pop p ON p.geocode = e.geocode AND p.year = 2000) GROUP BY uf""")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(inp.static_shares(spark, sf_dir))


@query("a07_fold_boundaries", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS fold_id, max(CASE WHEN train_{i} THEN date END) AS train_cutoff, "
    f"min(CASE WHEN target_{i} THEN date END) AS target_start, max(CASE WHEN target_{i} THEN date END) AS target_end, "
    f"CAST((min(CASE WHEN target_{i} THEN date END) - max(CASE WHEN train_{i} THEN date END)) // 7 - 1 AS INTEGER) "
    f"AS gap_weeks FROM v_flagged" for i in range(1, 5)) + ")")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.boundaries(star.flagged_cases(spark, sf_dir))


@query("a08_forecast_origin", "SELECT max(date) AS forecast_origin FROM v_cases")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.forecast_origin(star.cases(spark, sf_dir))


@query("a09_last_value", "SELECT * FROM v_last")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.last_values(inp.state_series(spark, sf_dir), star.folds(spark))


@query("a10_quantile_vector",
       f"SELECT geo, {sql.spread()} FROM (SELECT geo, quantile_cont(casos, {sql.LEVELS}) AS q FROM v_series GROUP BY geo)")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inp.state_series(spark, sf_dir).groupBy("geo").agg(os_.quantile_vector(F.col("casos")).alias("q"))
    return inp.rounded_quantiles(vectors)


@query("a10_distributed_quantiles", "SELECT l_returnflag, quantile_level, CAST(n AS BIGINT) AS n, "
       "round(CASE quantile_level " + " ".join(
           f"WHEN {v} THEN q[{i + 1}]" for i, v in enumerate(QUANTILE_LEVELS)) + " END, 6) AS l_extendedprice FROM "
       f"(SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, {sql.LEVELS}) AS q FROM lineitem GROUP BY 1), "
       f"(SELECT unnest({sql.LEVELS})::DOUBLE AS quantile_level)")
def a10_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return inp.round_all(os_.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", QUANTILE_LEVELS))


@query("a11_week_median", f"SELECT fold_id, geo, epiweek, {sql.r6('median', 'median')} FROM v_week_median")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(baselines.weekly_medians(inp.state_series(spark, sf_dir), star.folds(spark)))


@query("a12_residual_pool_quantiles", f"SELECT fold_id, geo, {sql.spread()} FROM v_resid_q")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.rounded_quantiles(baselines.residual_pools(inp.state_series(spark, sf_dir), star.folds(spark)).select("fold_id", "geo", "q"))


@query("a13_circular_window_quantiles",
       f"SELECT fold_id, geo, target_week, {sql.r6('mean', 'mean')}, {sql.spread()} FROM v_pools")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = baselines.window_pools(inp.state_series(spark, sf_dir), star.folds(spark))
    return inp.rounded_quantiles(pools.withColumn("mean", F.round("mean", 6)))


@query("a14_metric_summary", f"SELECT model, fold_id, {sql.METRICS} FROM v_all_scored WHERE fold_id <> 4 GROUP BY ALL")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.metric_summary(inp.all_scored(spark, sf_dir), ["model", "fold_id"], (4,)))


_NWIS = sql.r6("sum(wis) / sum(observed_value)", "normalized_wis")


@query("a15_normalized_wis", f"SELECT model, {_NWIS} FROM v_all_scored GROUP BY 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.normalized_wis(inp.all_scored(spark, sf_dir), ["model"]))


@query("a16_coverage", "SELECT model, geo, " + ", ".join(
    sql.r6(f"avg((observed_value >= lower_{v} AND observed_value <= upper_{v})::DOUBLE)", f"coverage_{v}")
    for v in INTERVAL_LEVELS) + " FROM v_scored GROUP BY ALL")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.coverage(inp.members_scored(spark, sf_dir), ["model", "geo"]))


@query("a17_mase", """
SELECT model, fold_id, geo, round(mae / CASE WHEN scale >= 1e-9 THEN scale END, 6) AS mase FROM
(SELECT model, fold_id, geo, avg(ae_median) AS mae FROM v_scored GROUP BY ALL) JOIN
(SELECT fold_id, geo, avg(abs(step)) AS scale FROM (SELECT fold_id, geo, casos - lag(casos, 52) OVER
 (PARTITION BY fold_id, geo ORDER BY date) AS step FROM v_train) GROUP BY ALL) USING (fold_id, geo)""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fo.training(inp.state_series(spark, sf_dir), star.folds(spark))
    scored = inp.members_scored(spark, sf_dir)
    return inp.round_all(so.mase(scored, train, ["model", "fold_id", "geo"], ["fold_id", "geo"]))


_PEAK_ROWS = """(SELECT *, row_number() OVER (PARTITION BY model, fold_id, geo ORDER BY observed_value DESC, date) AS o,
row_number() OVER (PARTITION BY model, fold_id, geo ORDER BY pred DESC, date) AS f FROM v_scored)"""


@query("a18_peak_timing_error", f"""
SELECT model, fold_id, geo, max(CASE WHEN f = 1 THEN horizon_weeks END) - max(CASE WHEN o = 1 THEN horizon_weeks END)
AS peak_timing_error FROM {_PEAK_ROWS} GROUP BY ALL""")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = so.peaks(inp.members_scored(spark, sf_dir), ["model", "fold_id", "geo"])
    return peaks.select("model", "fold_id", "geo", "peak_timing_error")


@query("a19_peak_magnitude_error", f"""
SELECT model, fold_id, geo, round(CASE WHEN observed_value >= 1e-9 AND pred >= 1e-9 THEN ln(pred / observed_value) END, 6)
AS peak_magnitude_error FROM {_PEAK_ROWS} WHERE o = 1""")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = so.peaks(inp.members_scored(spark, sf_dir), ["model", "fold_id", "geo"])
    return peaks.select("model", "fold_id", "geo", r6("peak_magnitude_error"))


@query("a20_relative_wis", """
WITH u AS (SELECT fold_id, geo, horizon_weeks, model, ln(greatest(wis, 1e-9)) AS s FROM v_all_scored),
full_units AS (SELECT fold_id, geo, horizon_weeks FROM u GROUP BY ALL HAVING count(DISTINCT model) =
 (SELECT count(DISTINCT model) FROM u)),
k AS (SELECT u.* FROM u JOIN full_units USING (fold_id, geo, horizon_weeks)),
pairs AS (SELECT a.model, b.model AS rival, avg(a.s - b.s) AS d FROM k a JOIN k b USING (fold_id, geo, horizon_weeks)
 WHERE a.model <> b.model GROUP BY ALL),
theta AS (SELECT model, exp(avg(d)) AS t FROM pairs GROUP BY 1)
SELECT model, round(t / (SELECT t FROM theta WHERE model = 'naive'), 6) AS relative_wis FROM theta""".replace("WITH u", "SELECT * FROM (WITH u") + ")")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ["naive", *MEMBERS, *inp.ENSEMBLES]
    scored = inp.all_scored(spark, sf_dir)
    return inp.round_all(so.relative_wis(scored, "naive", ["fold_id", "geo", "horizon_weeks"], models))


@query("a21_overdispersion", f"""
SELECT fold_id, round(coalesce(quantile_cont(a, 0.5), 0.1), 6) AS dispersion FROM
(SELECT fold_id, least(greatest((v - m) / (m * m), 1e-3), 10) AS a FROM
 (SELECT fold_id, geo, {sql.season_week('date')} AS w, avg(casos) AS m, var_samp(casos) AS v FROM v_train GROUP BY ALL)
 WHERE m > 5 AND v IS NOT NULL) GROUP BY 1""")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(trajectories.dispersion(inp.state_series(spark, sf_dir), star.folds(spark)).drop("pool"))


@query("a22_long_to_wide",
       f"SELECT model, fold_id, geo, date, {', '.join(sql.r6(c, c) for c in QUANTILE_COLUMNS)} FROM v_scored")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["model", "fold_id", "geo", "date"]
    long = qt.to_long(inp.members_scored(spark, sf_dir).select(*keys, qt.wide_array().alias("q")))
    return inp.round_all(so.complete_only(so.pivot_wide(long, keys)))


@query("a23_cross_tab", "SELECT model, " + ", ".join(
    sql.r6(f"avg(CASE WHEN fold_id = {i} THEN wis END)", f"fold_{i}") for i in range(1, 5))
    + " FROM v_all_scored GROUP BY 1")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = inp.all_scored(spark, sf_dir).groupBy("model").pivot("fold_id", [1, 2, 3, 4]).agg(F.avg("wis"))
    return table.select("model", *[r6(F.col(str(i)), f"fold_{i}") for i in range(1, 5)])


_WIDE_KEYS = ["fold_id", "geo", "date", "horizon_weeks"]
_ROUNDED_WIDE = ", ".join(sql.r6(c, c) for c in QUANTILE_COLUMNS)


@query("a24_median_ensemble", f"SELECT {', '.join(_WIDE_KEYS)}, {_ROUNDED_WIDE} FROM v_vincent")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensemble = en.median_ensemble(inp.members_scored(spark, sf_dir), MEMBERS)
    return inp.round_all(ensemble.select(*_WIDE_KEYS, *QUANTILE_COLUMNS))


@query("a25_inverse_score_weights", f"SELECT model, {sql.r6('weight', 'weight')} FROM v_weights")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(en.inverse_score_weights(inp.members_scored(spark, sf_dir), MEMBERS))


_EQUAL = ", ".join(f"avg({c}) AS {c}" for c in QUANTILE_COLUMNS)


@query("a26_weighted_mean_ensemble", f"SELECT {', '.join(_WIDE_KEYS)}, {_ROUNDED_WIDE} FROM ("
       + sql.sorted_wide(f"SELECT {', '.join(_WIDE_KEYS)}, {_EQUAL} FROM v_scored WHERE model IN ({sql.MEMBER_LIST}) "
                         f"GROUP BY {', '.join(_WIDE_KEYS)}", ", ".join(_WIDE_KEYS)) + ")")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = inp.members_scored(spark, sf_dir).filter(F.col("model").isin(MEMBERS))
    averaged = en.weighted_ensemble(scored, en.equal_weights(scored), "ensemble_mean")
    return inp.round_all(averaged.select(*_WIDE_KEYS, *QUANTILE_COLUMNS))


@query("a27_conformal_factors", f"SELECT CAST(level AS INTEGER) AS level, {sql.r6('factor', 'factor')} FROM v_factors")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensemble = en.median_ensemble(inp.members_scored(spark, sf_dir), MEMBERS)
    return inp.round_all(en.widening_factors(ensemble.filter("fold_id = 1")))


_CQR_ROWS = " UNION ALL ".join(
    f"SELECT model, fold_id, {v} AS level, greatest(lower_{v} - observed_value, observed_value - upper_{v}) AS score "
    "FROM v_scored" for v in INTERVAL_LEVELS)


@query("a28_cqr_order_statistic", f"""
SELECT model, fold_id, CAST(level AS INTEGER) AS level, n, {sql.r6('CASE WHEN n > 200 THEN score ELSE 0 END', 'shift')} FROM
(SELECT *, row_number() OVER (PARTITION BY model, fold_id, level ORDER BY score) AS rk,
 count(*) OVER (PARTITION BY model, fold_id, level) AS n FROM ({_CQR_ROWS}))
WHERE rk = least(ceil((n + 1) * (level / 100.0::DOUBLE)), n)""")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("observed_value")
    pairs = F.array(*[
        F.struct(F.lit(v).alias("level"), sc.conformity(y, F.col(f"lower_{v}"), F.col(f"upper_{v}")).alias("score"))
        for v in INTERVAL_LEVELS])
    rows = inp.members_scored(spark, sf_dir).select("model", "fold_id", F.inline(pairs))
    return inp.round_all(en.additive_shifts(rows, ["model", "fold_id"]))


@query("a29_national_annual_totals", """
SELECT c.year, c.casos, round(o.enso, 6) AS mean_enso FROM
(SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(casos) AS BIGINT) AS casos FROM v_state GROUP BY 1) c
LEFT JOIN (SELECT year(date) AS year, avg(enso) AS enso FROM v_ocean GROUP BY 1) o ON o.year = c.year""")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = inp.state_cases(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.sum("casos").alias("casos"))
    index = star.ocean(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(r6(F.avg("enso"), "mean_enso"))
    return totals.join(index, "year", "left")


@query("a30_climatology_band", """
SELECT CAST(weekofyear(date) AS INTEGER) AS week, round(quantile_cont(casos, 0.5), 6) AS median,
round(quantile_cont(casos, 0.25), 6) AS q25, round(quantile_cont(casos, 0.75), 6) AS q75 FROM
(SELECT date, CAST(sum(casos) AS BIGINT) AS casos FROM v_state GROUP BY 1) WHERE weekofyear(date) <= 52 GROUP BY 1""")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(ex.climatology_band(ex.national(inp.state_cases(spark, sf_dir))))


_YEAR_PEAK = """(SELECT geo, CAST(year(date) AS INTEGER) AS year, date, casos, CAST(weekofyear(date) AS INTEGER) AS week
FROM v_state QUALIFY row_number() OVER (PARTITION BY geo, year(date) ORDER BY casos DESC, date) = 1)"""


@query("a31_group_argmax", f"SELECT * FROM {_YEAR_PEAK}")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.yearly_peaks(inp.state_cases(spark, sf_dir))


@query("a32_peak_week_distribution", f"""
SELECT week, count(*) AS peaks, round((SELECT quantile_cont(week, 0.5) FROM {_YEAR_PEAK}), 6) AS median,
round((SELECT quantile_cont(week, 0.25) FROM {_YEAR_PEAK}), 6) AS q25,
round((SELECT quantile_cont(week, 0.75) FROM {_YEAR_PEAK}), 6) AS q75 FROM {_YEAR_PEAK} GROUP BY week""")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = ex.yearly_peaks(inp.state_cases(spark, sf_dir)).groupBy("week").agg(F.count("*").alias("peaks"))
    spread = histogram.agg(F.percentile("week", [0.5, 0.25, 0.75], F.col("peaks")).alias("p"))
    return histogram.join(F.broadcast(spread)).select(
        "week", "peaks", *[r6(F.col("p")[i], n) for i, n in enumerate(["median", "q25", "q75"])])


@query("a33_pearson_correlation", """
SELECT round(corr(ln(1 + a), ln(1 + b)), 6) AS r, count(*) AS n FROM
(SELECT geo, year(date) AS y, sum(casos) AS a FROM v_state GROUP BY ALL) JOIN
(SELECT geo, year(date) AS y, sum(casos) AS b FROM v_state_chik GROUP BY ALL) USING (geo, y) WHERE a > 0 AND b > 0""")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = star.cases_all(spark, sf_dir).filter(F.col("uf") != star.EXCLUDED)
    yearly = both.groupBy("uf", F.year("date").alias("year")).pivot("disease", list(star.DISEASES)).agg(F.sum("casos"))
    return inp.round_all(ex.log_correlation(yearly.dropna(), *star.DISEASES))


_LAG_ROWS = """(SELECT d.date, ln(1 + d.casos) AS a, c.temp_med AS b, row_number() OVER (ORDER BY d.date) AS rn FROM
(SELECT date, sum(casos) AS casos FROM v_state GROUP BY 1) d JOIN
(SELECT date, sum(temp_med * w) / sum(w) AS temp_med FROM v_climate_w GROUP BY 1) c USING (date))"""
_LAGS = f"""(SELECT l.lag, corr(x.a, z.b) AS r FROM (SELECT CAST(i AS INTEGER) AS lag FROM generate_series(-20, 20) t(i)) l
JOIN {_LAG_ROWS} x ON true JOIN {_LAG_ROWS} z ON z.rn = x.rn - l.lag GROUP BY 1)"""


def _lag_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ex.national(inp.state_cases(spark, sf_dir)).select("date", F.log1p("casos").alias("a"))
    climate = rollup.weighted_mean(
        star.climate(spark, sf_dir), star.population(spark, sf_dir), star.geo_map(spark, sf_dir), ["date"],
        ["temp_med"], star.EXCLUDED, star.population_years(spark, sf_dir))
    return ex.lagged_correlation(counts.join(climate, "date"), "a", "temp_med")


@query("a34_lagged_cross_correlation", f"SELECT lag, {sql.r6('r', 'r')} FROM {_LAGS}")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(_lag_correlations(spark, sf_dir))


@query("a34_best_lag", f"SELECT lag AS best_lag FROM {_LAGS} WHERE lag >= 0 ORDER BY round(abs(r), 9) DESC, lag LIMIT 1")
def a34_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.best_lag(_lag_correlations(spark, sf_dir))


@query("a35_weekly_resample", """
SELECT accessed_disease, CAST(date_trunc('week', access_date) AS DATE) + 6 AS date,
CAST(sum(access_count) AS BIGINT) AS access_count FROM v_access GROUP BY ALL""")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.weekly_resample(star.access(spark, sf_dir), "access_date", "access_count", ("accessed_disease",))


_RATES = """(SELECT e.koppen, c.casos::DOUBLE / p.population * 1e5 AS incidence FROM
(SELECT geocode, year(date) AS y, sum(casos) AS casos FROM v_cases GROUP BY ALL) c
JOIN v_pop p ON p.geocode = c.geocode AND p.year = 2000 LEFT JOIN v_environment e ON e.geocode = c.geocode)"""


@query("a36_incidence_by_category", f"""
SELECT koppen, round(quantile_cont(incidence, 0.5), 6) AS median_incidence, count(*) AS municipality_years,
round(avg(least(incidence, (SELECT quantile_cont(incidence, 0.99) FROM {_RATES}))), 6) AS mean_capped
FROM {_RATES} GROUP BY 1""")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = rollup.fixed_year_weight(star.population(spark, sf_dir), 2000)
    return inp.round_all(ex.incidence_by_category(
        star.cases(spark, sf_dir), weights, star.environment(spark, sf_dir), "koppen"))


@query("a37_grid_completeness", """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS geos, min(w) AS min_weeks, quantile_cont(w, 0.5) AS median_weeks,
max(w) AS max_weeks, (SELECT count(DISTINCT date) FROM v_cases) AS weeks,
round(sum(n)::DOUBLE / (count(*) * (SELECT count(DISTINCT date) FROM v_cases)), 6) AS complete
FROM (SELECT geocode, count(*) AS n, count(DISTINCT date) AS w FROM v_cases GROUP BY 1)""")
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(ql.grid_completeness(star.cases(spark, sf_dir), "geocode", "date"))


_LEFT_JOINED = "v_cases LEFT JOIN v_customer_w USING (geocode)"


@query("a38_null_counts", 'SELECT * FROM (' + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM {_LEFT_JOINED}"
    for c in ("geocode", "uf", "date", "casos", "population")) + ") WHERE nulls > 0")
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = star.cases(spark, sf_dir).join(star.customer_weight(spark, sf_dir), "geocode", "left")
    return ql.null_counts(joined)


@query("a39_leaderboard", f"""
SELECT model, {sql.r6('avg(wis)', 'wis')}, {sql.r6('sum(wis) / sum(observed_value)', 'nwis')},
{', '.join(sql.r6(f'avg(coverage_{v}::DOUBLE) * 100', f'c{v}') for v in INTERVAL_LEVELS)} FROM v_all_scored GROUP BY 1""")
def a39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.leaderboard(inp.all_scored(spark, sf_dir)))


_UNITS_NUMBERED = "row_number() OVER (ORDER BY md5({k})) - 1 AS i, count(*) OVER () AS n"
_BLOCKS = f"""b AS (SELECT geo || '_' || fold_id AS block, model, sum(wis) AS s, sum(observed_value)::DOUBLE AS o,
 count(*) AS c FROM v_all_scored GROUP BY ALL),
k AS (SELECT block, {_UNITS_NUMBERED.format(k='block')} FROM (SELECT DISTINCT block FROM b)),
d AS (SELECT r.rep, {bs.draw_index_sql('r.rep', 'k.i', 'k.n')} AS i FROM k, (SELECT i AS rep FROM generate_series(0, 1999) t(i)) r),
m AS (SELECT b.model, d.rep, sum(s) / sum(c) AS wis, sum(s) / sum(o) AS nwis FROM d JOIN k ON k.i = d.i JOIN b USING (block)
 GROUP BY ALL)"""


@query("a40_block_bootstrap", f"""SELECT * FROM (WITH {_BLOCKS}
SELECT model, round(quantile_cont(wis, 0.025), 6) AS wis_low, round(quantile_cont(wis, 0.975), 6) AS wis_high,
round(quantile_cont(nwis, 0.025), 6) AS nwis_low, round(quantile_cont(nwis, 0.975), 6) AS nwis_high FROM m GROUP BY 1)""")
def a40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(bs.block_bootstrap(inp.all_scored(spark, sf_dir)))


@query("a41_paired_bootstrap", f"""SELECT * FROM (WITH
p AS (SELECT geo || '_' || fold_id || '_' || horizon_weeks AS unit, avg(wis) FILTER (model = 'ensemble_conformal')
 - avg(wis) FILTER (model = 'ensemble_vincent') AS gap FROM v_all_scored WHERE model IN ('ensemble_conformal', 'ensemble_vincent')
 GROUP BY geo, fold_id, horizon_weeks),
k AS (SELECT unit, gap, {_UNITS_NUMBERED.format(k='unit')} FROM p WHERE gap IS NOT NULL),
d AS (SELECT r.rep, {bs.draw_index_sql('r.rep', 'k.i', 'k.n')} AS i FROM k, (SELECT i AS rep FROM generate_series(0, 1999) t(i)) r),
m AS (SELECT d.rep, avg(gap) AS difference FROM d JOIN k ON k.i = d.i GROUP BY 1)
SELECT 'ensemble_conformal' AS model_a, 'ensemble_vincent' AS model_b, (SELECT count(*) FROM k) AS units,
round((SELECT avg(gap) FROM k), 6) AS mean_difference, round(quantile_cont(difference, 0.025), 6) AS difference_low,
round(quantile_cont(difference, 0.975), 6) AS difference_high FROM m)""")
def a41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(bs.paired_bootstrap(
        inp.all_scored(spark, sf_dir), "ensemble_conformal", "ensemble_vincent", replicates=2000))


@query("a42_nwis_by_horizon_bin", f"""
SELECT model, CASE WHEN horizon_weeks > 15 AND horizon_weeks <= 27 THEN '16-27' WHEN horizon_weeks <= 39 THEN '28-39'
WHEN horizon_weeks <= 51 THEN '40-51' WHEN horizon_weeks <= 67 THEN '52-67' END AS horizon_bin, {_NWIS}
FROM v_all_scored WHERE fold_id <> 2 GROUP BY ALL""")
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = inp.all_scored(spark, sf_dir).withColumn("horizon_bin", so.horizon_bin(F.col("horizon_weeks")))
    return inp.round_all(so.normalized_wis(binned, ["model", "horizon_bin"], (2,)))


@query("a43_decomposition_by_fold", "SELECT fold_id, " + ", ".join(
    sql.r6(f"avg({c})", c) for c in METRIC_COLUMNS[1:4])
    + " FROM v_all_scored WHERE model = 'ensemble_conformal' GROUP BY 1")
def a43(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = inp.all_scored(spark, sf_dir).filter(F.col("model") == "ensemble_conformal")
    return inp.round_all(so.decomposition(scored, ["fold_id"]))


@query("a44_near_complete_seasons", """
SELECT fold_id, geo, season, weeks FROM (SELECT t.fold_id, t.geo, """ + sql.season_year("t.date") + """ AS season,
count(DISTINCT """ + sql.season_week("t.date") + """) AS weeks FROM v_train t GROUP BY ALL) JOIN v_folds f USING (fold_id)
WHERE weeks >= 53 * 0.9 AND season < """ + sql.season_year("f.target_start"))
def a44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.complete_seasons(inp.state_series(spark, sf_dir), star.folds(spark))


@query("a45_shrinkage_weight", f"SELECT fold_id, geo, {sql.r6('weight', 'weight')} FROM v_shrink")
def a45(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir)).filter("population > 0")
    return inp.round_all(shrinkage_weights(volumes(usable, fo.Nested(star.folds(spark)))))


@query("a46_standardisation", """
SELECT fold_id, round(avg(log_inc), 6) AS mean, round(coalesce(nullif(stddev_samp(log_inc), 0), 1), 6) AS std
FROM v_inc JOIN v_folds f ON date <= f.train_cutoff GROUP BY 1""")
def a46(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir))
    stats = standardisation(fo.training(df, star.folds(spark)), ["log_inc"])
    return stats.select("fold_id", r6("log_inc_mean", "mean"), r6("log_inc_std", "std"))


@query("a47_reordering_rate", """
SELECT a.model, round(avg((q <> list_sort(q))::DOUBLE), 6) AS rate FROM (SELECT model, [lower_95, lower_90, lower_80,
lower_50, pred + (observed_value - pred) / 2, upper_50, upper_80, upper_90, upper_95] AS q FROM v_scored) a GROUP BY 1""")
def a47(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = inp.members_scored(spark, sf_dir).withColumn("pred", F.col("pred") + (F.col("observed_value") - F.col("pred")) / 2)
    return shifted.groupBy("model").agg(r6(ex.share(qt.needs_reordering()), "rate"))


@query("a48_season_curve_summary", f"""
SELECT geo, season, final_size, peak_week FROM (SELECT geo, season, season_week AS peak_week,
CAST(sum(casos) OVER (PARTITION BY geo, season) AS BIGINT) AS final_size,
row_number() OVER (PARTITION BY geo, season ORDER BY casos DESC, season_week) AS rk FROM
(SELECT *, {sql.season_year('date')} AS season, {sql.season_week('date')} AS season_week FROM v_series)) WHERE rk = 1""")
def a48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.season_curve(inp.state_series(spark, sf_dir))


@query("a49_reliability_curve", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT model, {v / 100}::DOUBLE AS nominal, {sql.r6(f'avg(coverage_{v}::DOUBLE)', 'empirical')} FROM v_all_scored "
    "GROUP BY 1" for v in INTERVAL_LEVELS) + ")")
def a49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(so.reliability(inp.all_scored(spark, sf_dir)))


@query("a50_quality_counters", """
SELECT count(*) AS rows, count(DISTINCT geocode) AS geos, count(DISTINCT uf) AS ufs, min(date) AS first_date,
max(date) AS last_date FROM v_cases""")
def a50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.counters(star.cases(spark, sf_dir), "geocode", "uf", "date")


@query("a51_weight_robustness", f"SELECT fold_id, model, {sql.r6('weight', 'weight')} FROM v_fold_weights WHERE fold_id <= 3")
def a51(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = inp.members_scored(spark, sf_dir).filter("fold_id <= 3")
    return inp.round_all(en.weights_by_fold(scored, MEMBERS))


def _subset_sql() -> str:
    keys = "fold_id, geo, date, horizon_weeks"
    parts = " UNION ALL ".join(
        f"SELECT {mask} AS subset, {keys}, max(observed_value) AS observed_value, "
        + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in QUANTILE_COLUMNS)
        + f" FROM v_scored WHERE model IN ({', '.join(repr(m) for m in chosen)}) GROUP BY {keys}"
        for mask, chosen in en.subsets(MEMBERS))
    multiples = sql.multiples("e", "fold_id = 1", "subset, ")
    factor = "CASE level " + " ".join(f"WHEN {v} THEN quantile_cont(multiple, {v / 100})" for v in INTERVAL_LEVELS)
    cols = ", ".join(
        "pred" if c == "pred" else f"pred + (SELECT factor FROM f WHERE f.level = {c.split('_')[1]} AND "
        f"f.subset = e.subset) * ({c} - pred) AS {c}" for c in QUANTILE_COLUMNS)
    moved = sql.sorted_wide(f"SELECT subset, fold_id, observed_value AS y, {cols} FROM e", "subset, fold_id, y")
    return (
        f"SELECT * FROM (WITH e AS ({parts}), f AS (SELECT subset, level, {factor} END AS factor FROM ({multiples}) "
        f"GROUP BY subset, level), w AS ({moved}) SELECT subset, {sql.r6(f'avg({sql.WIS})', 'mean_wis')}, "
        f"{sql.r6(f'sum({sql.WIS}) / sum(y)', 'normalized_wis')} FROM w GROUP BY subset)"
    )


@query("a52_ensemble_subset_sweep", _subset_sql())
def a52(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = en.subset_ensembles(inp.members_scored(spark, sf_dir), MEMBERS)
    factors = en.widening_factors(combined.filter("fold_id = 1"), ["subset"])
    scored = so.attach_scores(en.apply_widening(combined, factors, "ensemble_subset", ["subset"]))
    return scored.groupBy("subset").agg(
        r6(F.avg("wis"), "mean_wis"), r6(so.ratio_of_sums(), "normalized_wis"))
