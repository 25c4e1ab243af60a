import datetime as dt

from pyspark.sql import functions as F

from tidecast.functions import calendar as cal


def first_sunday(year):
    jan4 = dt.date(year, 1, 4)
    return jan4 - dt.timedelta(days=(jan4.weekday() + 1) % 7)


def brute(day):
    year = day.year + 1
    while first_sunday(year) > day:
        year -= 1
    return year, (day - first_sunday(year)).days // 7 + 1


def test_epi_week_matches_brute_force_over_forty_years(spark):
    days = spark.range(14600).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = days.select("d", cal.epi_year(F.col("d")).alias("y"), cal.epi_week(F.col("d")).alias("w")).collect()
    assert [(r.y, r.w) for r in rows] == [brute(r.d) for r in rows]


def one(spark, text, fn):
    return spark.sql(f"SELECT DATE'{text}' AS d").select(fn(F.col("d")).alias("v")).first().v


def test_season_week_known_answers(spark):
    assert one(spark, "2022-10-09", cal.season_week) == 1
    assert one(spark, "2023-10-01", cal.season_week) == 52
    assert one(spark, "2026-01-04", cal.season_week) == 14


def test_season_week_is_injective_in_a_53_week_season(spark):
    weeks = spark.sql("SELECT explode(sequence(DATE'2025-10-05', DATE'2026-10-04', INTERVAL 7 DAYS)) AS d")
    rows = [r.w for r in weeks.select(cal.season_week(F.col("d")).alias("w")).collect()]
    assert sorted(rows) == list(range(1, 54))


def test_season_dates_of_2024(spark):
    dates = spark.range(1).select(cal.season_dates(F.lit(2024)).alias("d")).first().d
    assert (dates[0], dates[-1], len(dates)) == (dt.date(2023, 10, 8), dt.date(2024, 9, 29), 52)


def test_resample_label_is_the_closing_sunday(spark):
    assert one(spark, "2024-01-01", cal.resample_sunday) == dt.date(2024, 1, 7)
    assert one(spark, "2024-01-07", cal.resample_sunday) == dt.date(2024, 1, 7)
