"""Data-quality operators (section 2.10) and the bounded failure list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.registry import query
from tidecast.operators import folds as fo
from tidecast.operators import quality as ql
from tidecast.plans import output, tracks
from tidecast.sources import star


@query("o01_no_leakage", """
SELECT fold_id, max(date) AS last_date, CAST(sum((date > train_cutoff)::INT) AS BIGINT) AS rows_after_cutoff
FROM v_train JOIN v_folds USING (fold_id) GROUP BY 1""")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fo.training(inp.state_series(spark, sf_dir), star.folds(spark))
    return ql.require_no_leakage(ql.leakage(train))


@query("o02_gap_weeks", """
SELECT fold_id, CAST(0 AS BIGINT) AS gap_rows FROM v_train t JOIN v_folds f USING (fold_id) GROUP BY 1
HAVING count(*) FILTER (t.date > f.train_cutoff AND t.date < f.target_start) = 0""")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = star.folds(spark)
    train = fo.training(inp.state_series(spark, sf_dir), folds).select("fold_id", "date")
    return ql.gap_rows(train, folds)


@query("o03_all_sundays", "SELECT CAST(sum((dayofweek(date) <> 0)::INT) AS BIGINT) AS not_sunday, count(*) AS rows FROM v_cases")
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.cases(spark, sf_dir).agg(ql.not_sunday().alias("not_sunday"), F.count("*").alias("rows"))


@query("o04_key_uniqueness", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE))""")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = star.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return ql.duplicate_rows(events, ["user_id", "day"])


@query("o05_non_negative", "SELECT CAST(sum((c_acctbal < 0)::INT) AS BIGINT) AS negative FROM customer")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "customer").agg(ql.negative_rows("c_acctbal").alias("negative"))


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output tables of one model, some of them broken in a known way."""
    scored = inp.all_scored(spark, sf_dir).filter(F.col("model") == "ensemble_invwis")
    tagged = tracks.with_season_year(scored, star.folds(spark)).withColumn("track", F.lit("dengue"))
    tables = output.build_tables(tagged)
    week = F.weekofyear("date")
    return tables.filter(~((F.col("geo") == "NATION_1") & (week == 10))).withColumns({
        "lower_95": F.when((F.col("geo") == "NATION_2") & (week == 12), -1.0).otherwise(F.col("lower_95")),
        "upper_90": F.when((F.col("geo") == "NATION_3") & (week == 20), F.col("upper_95") + 1).otherwise(F.col("upper_90")),
    })


_VERDICT = f"""SELECT 'dengue' AS track, CAST({sql.season_year('f.target_start')} + 1 AS INTEGER) AS season_year, g.geo,
count(*) FILTER (keep) AS rows, CASE WHEN count(*) FILTER (keep) <> count(*) THEN 'dates'
WHEN count(*) FILTER (keep AND pred IS NULL) > 0 THEN 'non-finite' WHEN count(*) FILTER (keep AND l95 < 0) > 0 THEN 'negative'
WHEN count(*) FILTER (keep AND u95 - u90 < -1e-6) > 0 THEN 'nesting' ELSE 'ok' END AS reason
FROM (SELECT g.*, e.pred, NOT (g.geo = 'NATION_1' AND weekofyear(g.date) = 10) AS keep,
 CASE WHEN g.geo = 'NATION_2' AND weekofyear(g.date) = 12 THEN -1.0 ELSE e.lower_95 END AS l95, e.upper_95 AS u95,
 CASE WHEN g.geo = 'NATION_3' AND weekofyear(g.date) = 20 THEN e.upper_95 + 1 ELSE e.upper_90 END AS u90
 FROM v_grid g LEFT JOIN (SELECT * FROM v_ensembles WHERE model = 'ensemble_invwis'
  AND observed_value IS NOT NULL) e USING (fold_id, geo, date)) g JOIN v_folds f USING (fold_id) GROUP BY ALL"""


@query("o06_output_table_verdicts", f"SELECT track, season_year, geo, rows, reason, reason = 'ok' AS valid FROM ({_VERDICT})")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.verdicts(_spoiled(spark, sf_dir))


@query("o06_table_report", f"""
SELECT track, count(*) FILTER (reason = 'ok') AS ok, count(*) FILTER (reason <> 'ok') AS failed FROM ({_VERDICT}) GROUP BY 1""")
def o06_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.write_report(_spoiled(spark, sf_dir))


@query("t04_first_failures", f"""
SELECT track, season_year, geo, reason FROM ({_VERDICT}) WHERE reason <> 'ok' ORDER BY track, season_year, geo LIMIT 10""")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.first_failures(_spoiled(spark, sf_dir))


_AUDIT = {
    "cases": "SELECT count(*) AS rows, count(DISTINCT geocode) AS geos, CAST(sum((dayofweek(date) <> 0)::INT) AS BIGINT) AS not_sunday, "
             "CAST(sum((casos < 0)::INT) AS BIGINT) AS negative, count(*) - count(casos) AS nulls FROM v_cases",
    "climate": "SELECT count(*) AS rows, count(DISTINCT geocode) AS geos, CAST(sum((dayofweek(date) <> 0)::INT) AS BIGINT) AS not_sunday, "
               "CAST(sum((temp_med < 0)::INT) AS BIGINT) AS negative, count(*) - count(temp_med) AS nulls FROM v_climate",
    "access": "SELECT count(*) AS rows, count(DISTINCT geocode) AS geos, CAST(sum((dayofweek(access_date) <> 0)::INT) AS BIGINT) AS not_sunday, "
              "CAST(sum((access_count < 0)::INT) AS BIGINT) AS negative, count(*) - count(access_count) AS nulls FROM v_access",
}
_AUDIT_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", \"check\", value FROM (UNPIVOT ({body}) ON rows, geos, not_sunday, negative, nulls "
    "INTO NAME \"check\" VALUE value)" for t, body in _AUDIT.items()
) + """ UNION ALL SELECT 'access', 'missing_geos', count(*) FROM (SELECT DISTINCT geocode FROM v_cases EXCEPT SELECT geocode FROM v_access)
UNION ALL SELECT 'climate', 'missing_geos', count(*) FROM (SELECT DISTINCT geocode FROM v_cases EXCEPT SELECT geocode FROM v_climate)"""


@query("o07_audit_report", f"SELECT * FROM ({_AUDIT_SQL})")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every check for every table, stacked as (table, check, value)."""
    return ql.audit({
        "cases": (star.cases(spark, sf_dir), "date", "casos"),
        "climate": (star.climate(spark, sf_dir), "date", "temp_med"),
        "access": (star.access(spark, sf_dir), "access_date", "access_count"),
    }, "cases")
