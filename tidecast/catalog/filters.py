"""Projections, filters and predicates (section 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.registry import query
from tidecast.constants import MAX_HORIZON
from tidecast.functions import transforms as tf
from tidecast.operators import folds as fo
from tidecast.operators import joins as jn
from tidecast.operators import quality as ql
from tidecast.plans import panel, trajectories
from tidecast.sources import star


@query("f01_cutoff_filter", "SELECT fold_id, geo, date, casos FROM v_train")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fo.training(inp.state_series(spark, sf_dir), star.folds(spark))
    return cut.select("fold_id", "geo", "date", "casos")


@query("f02_issue_month_filter", """
SELECT f.fold_id, s.geo, s.reference_month, s.forecast_months_ahead FROM v_seasonal s JOIN v_folds f
ON s.reference_month <= CAST(date_trunc('month', f.train_cutoff) AS DATE)""")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = fo.issued(inp.state_seasonal(spark, sf_dir), star.folds(spark))
    return issued.select("fold_id", "geo", "reference_month", "forecast_months_ahead")


@query("f03_target_window", """
SELECT f.fold_id, s.geo, s.date, s.casos FROM v_series s JOIN v_folds f ON s.date BETWEEN f.target_start AND f.target_end""")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = fo.target_window(inp.state_series(spark, sf_dir), star.folds(spark))
    return window.select("fold_id", "geo", "date", "casos")


@query("f04_naive_not_target_filter", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS fold_id, count(*) AS gap_rows FROM v_flagged, v_folds f WHERE f.fold_id = {i} "
    f"AND NOT target_{i} AND date > f.train_cutoff AND date < f.target_start" for i in range(1, 5)) + ")")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array(*[
        F.struct(F.lit(i).alias("fold_id"), F.col(f"target_{i}").alias("in_target")) for i in range(1, 5)])
    rows = star.flagged_cases(spark, sf_dir).select("date", F.inline(flags))
    return ql.gap_rows(rows.filter(~F.col("in_target")), star.folds(spark))


@query("f05_excluded_state", "SELECT uf, count(*) AS rows, CAST(sum(casos) AS BIGINT) AS casos FROM v_cases "
       "WHERE uf <> 'NATION_7' GROUP BY 1")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = star.cases(spark, sf_dir).filter(F.col("uf") != star.EXCLUDED)
    return kept.groupBy("uf").agg(F.count("*").alias("rows"), F.sum("casos").alias("casos"))


@query("f06_membership", """
SELECT CASE WHEN geocode IN (SELECT geocode FROM v_cities) THEN 'city' ELSE 'other' END AS part, count(*) AS rows,
CAST(sum(casos) AS BIGINT) AS casos FROM v_cases WHERE uf IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1""")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = star.cases(spark, sf_dir).filter(F.col("uf").isin("NATION_1", "NATION_2", "NATION_3"))
    cities = star.target_cities(spark, sf_dir)
    inside = cases.join(cities, "geocode", "left_semi").withColumn("part", F.lit("city"))
    outside = cases.join(cities, "geocode", "left_anti").withColumn("part", F.lit("other"))
    both = inside.unionByName(outside)
    return both.groupBy("part").agg(F.count("*").alias("rows"), F.sum("casos").alias("casos"))


@query("f07_origin_floor", f"SELECT geo, date AS origin_date FROM v_series WHERE date >= DATE '{inp.MIN_ORIGIN}'")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = inp.state_series(spark, sf_dir).filter(F.col("date") >= F.lit(inp.MIN_ORIGIN).cast("date"))
    return series.select("geo", F.col("date").alias("origin_date"))


@query("f08_label_observed", """
SELECT f.fold_id, CAST(h AS INTEGER) AS horizon_weeks, count(*) AS pairs FROM v_series s JOIN v_folds f ON s.date <= f.train_cutoff,
generate_series(1, 67) t(h) WHERE s.date + CAST(7 * h AS INTEGER) <= f.train_cutoff GROUP BY ALL""")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fo.training(inp.state_series(spark, sf_dir), star.folds(spark))
    pairs = jn.horizon_expansion(cut.withColumnRenamed("date", "origin_date"), MAX_HORIZON)
    kept = pairs.filter(F.col("target_date") <= F.col("train_cutoff"))
    return kept.groupBy("fold_id", "horizon_weeks").agg(F.count("*").alias("pairs"))


@query("f09_null_row_drop", """
SELECT geo, count(*) AS rows FROM v_series LEFT JOIN v_state_climate USING (geo, date)
WHERE temp_med IS NOT NULL AND precip_med IS NOT NULL GROUP BY 1""")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = inp.state_series(spark, sf_dir).join(inp.state_climate(spark, sf_dir), ["geo", "date"], "left")
    kept = joined.dropna(how="any", subset=["temp_med", "precip_med"])
    return kept.groupBy("geo").agg(F.count("*").alias("rows"))


@query("f10_fixed_year_slice", "SELECT geocode, population FROM v_pop WHERE year = 2000")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.population(spark, sf_dir).filter("year = 2000").select("geocode", "population")


@query("f11_geography_relabel", "SELECT geo, date, casos FROM v_city_state")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = star.cases(spark, sf_dir).join(star.target_cities(spark, sf_dir), "geocode", "left_semi")
    return cities.select(F.col("geocode").cast("string").alias("geo"), "date", "casos")


@query("f12_lineage_tagging", """
SELECT 'seasonal_naive' AS model, 'dengue' AS disease, fold_id, geo, date, train_cutoff AS origin_date FROM v_train
JOIN v_folds USING (fold_id)""")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fo.training(inp.state_series(spark, sf_dir), star.folds(spark))
    tagged = cut.withColumns({"model": F.lit("seasonal_naive"), "disease": F.lit("dengue")})
    return tagged.select("model", "disease", "fold_id", "geo", "date", F.col("train_cutoff").alias("origin_date"))


@query("f13_code_mapping", """
SELECT CASE l_returnflag WHEN 'R' THEN 'A92.0' ELSE 'A90' END AS disease_code, CAST(s_nationkey AS INTEGER) AS adm_1,
substr(CAST(l_suppkey AS VARCHAR), 1, 2) AS city_prefix, count(*) AS rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY ALL""")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    disease = F.when(F.col("l_returnflag") == "R", "chikungunya").otherwise("dengue")
    lines = star.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), disease.alias("d")).agg(
        F.count("*").alias("n"))
    mapped = lines.join(star.table(spark, sf_dir, "supplier"), "s_suppkey")
    return mapped.groupBy(
        tf.disease_code(F.col("d")).alias("disease_code"), F.col("s_nationkey").alias("adm_1"),
        tf.city_state_code(F.col("s_suppkey")).alias("city_prefix"),
    ).agg(F.sum("n").alias("rows"))


@query("f14_calibration_split", """
SELECT fold_id, CASE WHEN date < train_cutoff - 546 THEN 'proper' ELSE 'calib' END AS block, count(*) AS rows,
min(date) AS first_origin, max(date) AS last_origin FROM v_train JOIN v_folds USING (fold_id) GROUP BY ALL""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fo.training(inp.state_series(spark, sf_dir), star.folds(spark))
    block = fo.calibration_block(F.col("date"), F.col("train_cutoff"))
    return cut.groupBy("fold_id", block.alias("block")).agg(
        F.count("*").alias("rows"), F.min("date").alias("first_origin"), F.max("date").alias("last_origin"))


@query("f15_season_in_range", f"""
SELECT t.fold_id, t.geo, t.season, count(*) AS weeks FROM (SELECT *, {sql.season_year('date')} AS season FROM v_train) t
JOIN v_folds f USING (fold_id) WHERE season < {sql.season_year('f.target_start')} GROUP BY ALL""")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = trajectories.past_seasons(inp.state_series(spark, sf_dir), star.folds(spark))
    in_range = past.filter(F.col("season_week").between(1, 53))
    return in_range.groupBy("fold_id", "geo", "season").agg(F.count("*").alias("weeks"))


_PROJECTED = [c for c in panel.ORIGIN_FEATURES if c != "temp_anomaly"]  # the anomaly depends on the fold
_PLACES = {c: 9 if c in ("temp_med_roll4", "precip_med_roll4") else 6 for c in [*_PROJECTED, *inp.PANEL_STATIC]}


@query("f16_feature_projection", f"""
SELECT geo, date, {', '.join(f'round({c}, {d}) + 0.0 AS {c}' for c, d in _PLACES.items())}
FROM v_origin JOIN v_static USING (geo) LEFT JOIN v_ocean_lags USING (date)""")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    population, climate, ocean, _, static = inp.panel_inputs(spark, sf_dir)
    origins = panel.origin_series(inp.state_series(spark, sf_dir), population, climate, ocean)
    return origins.join(static, "geo").select("geo", "date", *[(F.round(c, d) + 0.0).alias(c) for c, d in _PLACES.items()])


@query("f17_positive_pairs", """
SELECT a.geo, CAST(a.y AS INTEGER) AS year, a.casos AS dengue, b.casos AS chikungunya FROM
(SELECT geo, year(date) AS y, CAST(sum(casos) AS BIGINT) AS casos FROM v_state GROUP BY ALL) a JOIN
(SELECT geo, year(date) AS y, CAST(sum(casos) AS BIGINT) AS casos FROM v_state_chik GROUP BY ALL) b
ON a.geo = b.geo AND a.y = b.y WHERE a.casos > 0 AND b.casos > 0""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = star.cases_all(spark, sf_dir).filter(F.col("uf") != star.EXCLUDED)
    yearly = both.groupBy(F.col("uf").alias("geo"), F.year("date").alias("year")).pivot(
        "disease", list(star.DISEASES)).agg(F.sum("casos"))
    return yearly.filter((F.col("dengue") > 0) & (F.col("chikungunya") > 0))
