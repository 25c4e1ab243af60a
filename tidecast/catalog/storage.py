"""Sources and sinks (sections 2.1 and 2.2): tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.inputs import r6
from tidecast.catalog.registry import query
from tidecast.constants import CLIMATE_COLUMNS, QUANTILE_COLUMNS
from tidecast.functions import calendar as cal
from tidecast.operators import ensemble, rollup
from tidecast.operators import folds as fo
from tidecast.plans import backtest, baselines, output, refresh, tracks
from tidecast.plans.hierarchical import hierarchical, shrinkage_weights, volumes
from tidecast.session import new_path, scratch_dir
from tidecast.sources import landing, readers, star


def _csv(spark: SparkSession, df: DataFrame, label: str) -> str:
    """Write a derived table as gzip CSV, the format the raw tables come in."""
    path = new_path(spark, label)
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return path


_FLAGS = [f"{k}_{i}" for i in range(1, 5) for k in ("train", "target")]


@query("s01_case_scan", f"SELECT geocode, date, casos, uf, {', '.join(_FLAGS)}, target_city FROM v_flagged")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["geocode", "date", "casos", "uf", *_FLAGS, "target_city"]
    path = _csv(spark, star.flagged_cases(spark, sf_dir).select(*columns), "cases")
    return readers.cases(spark, path)


@query("s02_climate_scan", f"""
SELECT geocode, date, {sql.epi_week('date')} AS epiweek, {', '.join(f'round({c}, 9) AS {c}' for c in CLIMATE_COLUMNS)} FROM v_climate""")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    climate = star.climate(spark, sf_dir).select(
        "geocode", "date", cal.epi_week(F.col("date")).alias("epiweek"), *CLIMATE_COLUMNS)
    return inp.round_all(readers.climate(spark, _csv(spark, climate, "climate")), 9)


@query("s03_mixed_date_scan", """
SELECT geocode, reference_month, forecast_months_ahead, round(temp_med, 9) AS temp_med, round(umid_med, 9) AS umid_med,
round(precip_tot, 9) AS precip_tot FROM v_seasonal_raw""")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("reference_month").cast("string")
    mixed = F.when(F.col("geocode") % 2 == 0, day).otherwise(F.concat(day, F.lit(" 00:00:00")))
    raw = star.seasonal_forecast(spark, sf_dir).withColumn("reference_month", mixed)
    return inp.round_all(readers.seasonal_forecast(spark, _csv(spark, raw, "seasonal")), 9)


@query("s04_ocean_scan", "SELECT date, round(enso, 6) AS enso, round(iod, 6) AS iod, round(pdo, 6) AS pdo FROM v_ocean")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.round_all(readers.ocean(spark, _csv(spark, star.ocean(spark, sf_dir), "ocean")))


@query("s05_environment_scan", "SELECT * FROM v_environment")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.environment(spark, _csv(spark, star.environment(spark, sf_dir), "environment"))


@query("s06_population_scan", "SELECT * FROM v_pop")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.population(spark, _csv(spark, star.population(spark, sf_dir), "population"))


@query("s07_access_scan_filtered", "SELECT * FROM v_access WHERE accessed_disease = 'click'")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.access(spark, _csv(spark, star.access(spark, sf_dir), "access"), "click")


@query("s07_access_pushdown", """
SELECT event_type AS accessed_disease, count(*) AS access_count FROM events WHERE event_type = 'click' GROUP BY 1""")
def s07_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter on Parquet: it reaches the scan as a pushed predicate."""
    events = star.table(spark, sf_dir, "events").withColumnRenamed("event_type", "accessed_disease")
    return readers.only_topic(events, "click").groupBy("accessed_disease").agg(F.count("*").alias("access_count"))


@query("s08_geography_scan", "SELECT * FROM v_geo")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.geo_map(spark, _csv(spark, star.geo_map(spark, sf_dir), "geo"))


@query("s09_scored_scan_coerced", f"""
SELECT model, fold_id, geo, date, observed_value::DOUBLE AS observed_value,
CASE WHEN horizon_weeks % 5 <> 0 THEN round(wis, 6) END AS wis, {sql.r6('pred', 'pred')} FROM v_scored""")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("horizon_weeks") % 10 == 0, "n/a").otherwise("NaN")
    text = F.when(F.col("horizon_weeks") % 5 == 0, bad).otherwise(F.col("wis").cast("string"))
    rows = inp.members_scored(spark, sf_dir).select(
        "model", "fold_id", "geo", "date", "observed_value", text.alias("wis"), "pred")
    return inp.round_all(readers.scored(spark, _csv(spark, rows, "scored")))


@query("s10_build_or_read", "SELECT year, CAST(sum(population) AS BIGINT) AS population, count(*) AS geos FROM v_state_pop GROUP BY 1")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built on the first call, read on the second; the name carries the fingerprint of the inputs."""
    files = landing.listing_fingerprints(spark, sf_dir, "{lineitem,supplier,nation}*.parquet")
    key = landing.combined_fingerprint(files).first()["fingerprint"]

    def build() -> DataFrame:
        return inp.state_population(spark, sf_dir)

    root = scratch_dir(spark)
    landing.build_or_read(spark, root, "state_population", key, build)
    table = landing.build_or_read(spark, root, "state_population", key, build)
    return table.groupBy("year").agg(F.sum("population").alias("population"), F.count("*").alias("geos"))


@query("s11_file_fingerprints")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.file_fingerprints(spark, sf_dir, "*.parquet")


@query("s11_combined_fingerprint")
def s11_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.combined_fingerprint(landing.file_fingerprints(spark, sf_dir, "*.parquet"))


@query("s11_weekly_fingerprint", """
SELECT count(*) AS files, substr(sha256(string_agg(h, '' ORDER BY h)), 1, 16) AS fingerprint FROM
(SELECT sha256(concat_ws('|', CAST(date AS VARCHAR), CAST(CAST(sum(casos) AS BIGINT) AS VARCHAR))) AS h FROM v_cases GROUP BY date)""")
def s11_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of ``combined_fingerprint`` over one hash a week, which SQL can repeat; the calendar bounds its rows."""
    weeks = star.cases(spark, sf_dir).groupBy("date").agg(F.sum("casos").cast("bigint").alias("casos"))
    return landing.combined_fingerprint(weeks.select(F.sha2(F.concat_ws("|", F.col("date").cast("string"), F.col("casos").cast("string")), 256).alias("sha256")))


@query("s01_landed_by_year", """
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, CAST(sum(casos) AS BIGINT) AS casos FROM v_cases
WHERE date >= DATE '2000-01-01' GROUP BY 1""")
def s01_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed by year: the filter on the partition column prunes folders before any file is opened."""
    path = new_path(spark, "landed")
    landing.land(star.cases(spark, sf_dir), path, "date")
    landed = spark.read.parquet(path).filter("year >= 2000")
    return landed.groupBy("year").agg(F.count("*").alias("rows"), F.sum("casos").alias("casos"))


# ---- sinks ----

@query("k01_score_sink", "SELECT model, fold_id, count(*) AS rows, round(avg(wis), 6) AS mean_wis FROM v_scored GROUP BY ALL")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, board_path = new_path(spark, "scores"), new_path(spark, "board")
    output.write_scores(inp.members_scored(spark, sf_dir), path)
    written = spark.read.parquet(path)
    board = written.groupBy("model", "fold_id").agg(F.count("*").alias("rows"), r6(F.avg("wis"), "mean_wis"))
    output.write_leaderboard(board, board_path)
    return spark.read.csv(board_path, header=True, schema=board.schema)


@query("k01_incremental_refresh", """
SELECT model, fold_id, count(*) AS rows, round(avg(wis), 6) AS mean_wis, fold_id = 3 AS refreshed FROM v_scored
WHERE model IN ('naive', 'climatological_quantile') GROUP BY ALL""")
def k01_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored backtest whose third fold began with another cut-off: bringing it up to date forecasts that fold alone."""
    folds, series = star.folds(spark), inp.state_series(spark, sf_dir)
    models = {"naive": baselines.naive, "climatological_quantile": baselines.climatological}
    earlier = F.when(F.col("fold_id") == 3, F.date_sub("train_cutoff", 28)).otherwise(F.col("train_cutoff"))
    path = new_path(spark, "refresh")
    refresh.refresh(path, models, series, folds.withColumn("train_cutoff", earlier))
    stored, again = refresh.refresh(path, models, series, folds)
    done = F.concat_ws("|", "model", "fold_id").isin([f"{m}|{f}" for m, f in again])
    return stored.groupBy("model", "fold_id").agg(F.count("*").alias("rows"), r6(F.avg("wis"), "mean_wis")).withColumn("refreshed", done)


_SEASON = f"{sql.season_year('f.target_start')} + 1"


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest rows of one model as output tables; the partly observed fold lacks weeks."""
    scored = inp.all_scored(spark, sf_dir).filter(F.col("model") == "ensemble_vincent")
    tagged = tracks.with_season_year(scored, star.folds(spark)).withColumn("track", F.lit("dengue"))
    return output.build_tables(tagged)


_TABLE = "date DATE, " + ", ".join(f"{c} DOUBLE" for c in QUANTILE_COLUMNS) + ", track STRING, season_year INT, geo STRING"


def _written(spark: SparkSession, tables: DataFrame, label: str, fmt: str) -> DataFrame:
    """The valid tables as they stand in the files."""
    path = new_path(spark, label)
    output.write_valid(tables, path, fmt)
    reader = spark.read.schema(_TABLE)
    rows = reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)
    return inp.round_all(rows)


def _season_rows(track: str, view: str, where: str = "true") -> str:
    """The rows of the full-season tables of one model view."""
    return (f"SELECT '{track}' AS track, CAST({_SEASON} AS INTEGER) AS season_year, geo, date, {sql.spread()} "
            f"FROM {view} JOIN v_folds f USING (fold_id) WHERE {where}")


@query("k02_valid_season_sink", f"""
SELECT 'dengue' AS track, CAST({_SEASON} AS INTEGER) AS season_year, geo, date, {", ".join(sql.r6(c, c) for c in QUANTILE_COLUMNS)}
FROM v_ensembles_scored e JOIN v_folds f USING (fold_id) WHERE model = 'ensemble_vincent'
QUALIFY count(*) OVER (PARTITION BY fold_id, geo) = 52""")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, _published(spark, sf_dir), "season", "csv")


@query("k03_city_sink", _season_rows("dengue_cities", "v_dengue_city_clim"))
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = {"dengue_cities": (inp.city_series(spark, sf_dir), baselines.climatological)}
    return _written(spark, output.build_tables(tracks.season_tables(cities, star.folds(spark))), "city", "parquet")


@query("k04_best_of_tracks", " UNION ALL ".join([
    _season_rows("d_state", "v_dengue_state_clim"), _season_rows("d_city", "v_dengue_city_snaive"),
    _season_rows("c_state", "v_chikungunya_state_naive"), _season_rows("c_city", "v_chikungunya_city_clim")]))
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-season tables of all tracks, each from the model chosen for it, validated and written together."""
    best = {
        "d_state": (inp.state_series(spark, sf_dir), baselines.climatological),
        "d_city": (inp.city_series(spark, sf_dir), baselines.seasonal_naive),
        "c_state": (inp.state_series(spark, sf_dir, "chikungunya"), baselines.naive),
        "c_city": (inp.city_series(spark, sf_dir, "chikungunya"), baselines.climatological),
    }
    return _written(spark, output.build_tables(tracks.season_tables(best, star.folds(spark))), "tracks", "parquet")


@query("k04_scores_of_chosen", """
SELECT track, model, fold_id, count(*) AS rows FROM v_tracks JOIN (VALUES ('dengue', 'state', 'climatological_quantile', 'd_state'),
('dengue', 'city', 'seasonal_naive', 'd_city'), ('chikungunya', 'state', 'naive', 'c_state'),
('chikungunya', 'city', 'climatological_quantile', 'c_city')) t(disease, level, model, track) USING (disease, level, model)
GROUP BY ALL""")
def k04_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.createDataFrame([
        ("dengue", "state", "climatological_quantile", "d_state"), ("dengue", "city", "seasonal_naive", "d_city"),
        ("chikungunya", "state", "naive", "c_state"), ("chikungunya", "city", "climatological_quantile", "c_city"),
    ], "disease STRING, level STRING, model STRING, track STRING")
    best = output.best_of_tracks(inp.tracks_scored(spark, sf_dir), chosen)
    return best.groupBy("track", "model", "fold_id").agg(F.count("*").alias("rows"))


@query("k05_full_season_sink", _season_rows("dengue", "v_clim", "fold_id = 4"))
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weeks of the season that is only partly observed."""
    folds = star.folds(spark).filter("fold_id = 4")
    states = {"dengue": (inp.state_series(spark, sf_dir), baselines.climatological)}
    return _written(spark, output.build_tables(tracks.season_tables(states, folds)), "full", "parquet")


@query("k06_fitted_state", f"SELECT fold_id, geo, target_week, {sql.spread()} FROM v_pools")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted week pools saved as a table and loaded again."""
    pools = baselines.window_pools(inp.state_series(spark, sf_dir), star.folds(spark)).select(
        "fold_id", "geo", "target_week", "q")
    path = new_path(spark, "state")
    output.save_state(pools, path)
    return inp.rounded_quantiles(output.load_state(spark, path))


@query("k06_conformal_state", f"SELECT level, {sql.r6('factor', 'factor')} FROM v_factors")
def k06_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted conformal factors saved as a table and loaded again."""
    members = inp.members_scored(spark, sf_dir).filter("fold_id = 1")
    fitted = ensemble.widening_factors(ensemble.median_ensemble(members, inp.MEMBERS).filter("observed_value is not null"))
    path = new_path(spark, "state")
    output.save_state(fitted, path)
    return inp.round_all(output.load_state(spark, path))


@query("k06_shrinkage_state", f"SELECT fold_id, geo, {sql.r6('weight', 'weight')} FROM v_shrink")
def k06_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted shrinkage weights of the hierarchical model saved as a table and loaded again."""
    usable = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir)).filter("population > 0")
    path = new_path(spark, "state")
    output.save_state(shrinkage_weights(volumes(usable, fo.Nested(star.folds(spark)))), path)
    return inp.round_all(output.load_state(spark, path))


@query("m11_full_season_forecast", f"""
SELECT geo, CAST({_SEASON} AS INTEGER) AS season_year, d AS date, CAST((d - f.train_cutoff) // 7 AS INTEGER) AS horizon_weeks,
{sql.spread('p.q')} FROM (SELECT *, CAST(unnest(generate_series(target_start, target_end, INTERVAL 7 DAY)) AS DATE) AS d FROM v_folds) f
JOIN v_pools p ON p.fold_id = f.fold_id AND p.target_week = {sql.epi_week('d')}""")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = tracks.full_season(inp.state_series(spark, sf_dir), star.folds(spark))
    return inp.rounded_quantiles(full.select("geo", "season_year", "date", "horizon_weeks", "q"))


_MEDIANS = ", ".join(f"quantile_cont(q[{i + 1}], 0.5) AS {c}" for i, c in enumerate(QUANTILE_COLUMNS))
_SEASON_ENSEMBLE = sql.sorted_wide(
    f"SELECT fold_id, geo, date, horizon_weeks, {_MEDIANS} FROM v_members WHERE model IN ({sql.MEMBER_LIST}) GROUP BY ALL",
    "fold_id, geo, date, horizon_weeks")


@query("m11_full_season_ensemble", f"""
SELECT geo, CAST({_SEASON} AS INTEGER) AS season_year, date, horizon_weeks, {", ".join(sql.r6(c, c) for c in QUANTILE_COLUMNS)}
FROM ({_SEASON_ENSEMBLE}) JOIN v_folds f USING (fold_id)""")
def m11_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    population, geo_map = inp.state_population(spark, sf_dir), star.geo_map(spark, sf_dir)
    members = [baselines.climatological, baselines.seasonal_naive, lambda s, f, c: hierarchical(s, f, population, geo_map, c)]
    wide = tracks.full_season_ensemble(inp.state_series(spark, sf_dir), star.folds(spark), members)
    return inp.round_all(wide.select("geo", "season_year", "date", "horizon_weeks", *QUANTILE_COLUMNS))


_TRACK_KEYS = "disease, level, model, fold_id, geo, date, horizon_weeks"


@query("m16_track_runner", f"""
SELECT {_TRACK_KEYS}, observed_value, {', '.join(sql.r6(c, c) for c in QUANTILE_COLUMNS)}, {sql.r6('wis', 'wis')} FROM v_tracks""")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members that SQL can express, and their ensemble, on all four tracks, row by row."""
    kept = inp.tracks_scored(spark, sf_dir).filter(F.col("model") != "mechanistic_traj")
    return inp.round_all(kept.select(*_TRACK_KEYS.split(", "), "observed_value", *QUANTILE_COLUMNS, "wis"))


@query("m16_track_members", f"""
SELECT disease, level, fold_id, geo, count(*) AS rows, TRUE AS ascending, TRUE AS non_negative FROM v_tracks
WHERE model = 'climatological_quantile' GROUP BY ALL""")
def m16_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the season trajectories of every track, whatever is drawn."""
    noisy = inp.tracks_scored(spark, sf_dir).filter(F.col("model") == "mechanistic_traj")
    q = F.array(*[F.col(c) for c in QUANTILE_COLUMNS])
    return noisy.groupBy("disease", "level", "fold_id", "geo").agg(
        F.count("*").alias("rows"), F.bool_and(q == F.array_sort(q)).alias("ascending"), F.bool_and(q[0] >= 0).alias("non_negative"))


@query("m16_observed_folds", """
SELECT fold_id, count(DISTINCT date) AS weeks FROM v_series s JOIN v_folds f ON s.date BETWEEN f.target_start AND f.target_end
GROUP BY 1""")
def m16_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.observed_folds(inp.state_series(spark, sf_dir), star.folds(spark))


@query("d01_model_protocol", f"""
SELECT 'last_season' AS model, g.fold_id, g.geo, g.date, s.casos::DOUBLE AS pred FROM v_grid g
JOIN v_train s ON s.fold_id = g.fold_id AND s.geo = g.geo AND s.date = g.date - 728""")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own model: any function (history, grid) -> quantile rows runs guarded in the backtest driver."""
    def last_season(history: DataFrame, grid: DataFrame) -> DataFrame:
        past = history.select("fold_id", "geo", F.date_add("date", 728).alias("date"), "casos")
        joined = past.join(grid, ["fold_id", "geo", "date"])
        return baselines.forecast_columns(joined, "last_season", F.array_repeat(F.col("casos").cast("double"), 9))

    forecasts = backtest.run([backtest.guarded(last_season)], inp.state_series(spark, sf_dir), star.folds(spark))
    return forecasts.select("model", "fold_id", "geo", "date", F.col("q")[4].alias("pred"))
