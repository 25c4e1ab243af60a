"""Nulls and zero totals: values keep their place, missing observations score null, and no division stops a query."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions import scoring as sc
from tidecast.operators import ensemble, rollup
from tidecast.operators import windows as wn


def test_leading_values_keep_nulls_in_place(spark):
    values = [0, 1, None, 3, 4, 5]
    series = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "geo string, i int, v long").withColumn(
        "date", F.date_add(F.lit("2001-01-07").cast("date"), F.col("i") * 7))
    rows = series.withColumn("ahead", wn.leading_values("v", ["geo"], 3)).orderBy("i").collect()
    assert [r.ahead for r in rows] == [[1, None, 3], [None, 3, 4], [3, 4, 5], [4, 5], [5], []]
    frame = W.partitionBy("geo").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    assert series.select(wn.collected("v", frame).alias("h")).orderBy(F.size("h").desc()).first().h == values


def test_missing_observation_scores_null(spark):
    wide = spark.range(1).select(*[F.lit(float(-v)).alias(f"lower_{v}") for v in (50, 80, 90, 95)], F.lit(0.0).alias("pred"),
                                 *[F.lit(float(v)).alias(f"upper_{v}") for v in (50, 80, 90, 95)], F.lit(None).cast("double").alias("y"))
    y = F.col("y")
    row = wide.select(sc.interval_score(F.lit(0.0), F.lit(2.0), y, 0.5), sc.overprediction(y), sc.underprediction(y), sc.wis_from_intervals(y)).first()
    assert list(row) == [None] * 4


def test_zero_totals_give_null(spark):
    scored = spark.createDataFrame([(1, "a", 0.0), (1, "b", 2.0)], "fold_id int, model string, wis double")
    assert {r.model: r.weight for r in ensemble.weights_by_fold(scored, ["a", "b"]).collect()} == {"a": None, "b": 1.0}
    climate = spark.createDataFrame([("1", "X", 3.0)], "geocode string, other string, t double").withColumn("date", F.lit("2001-01-07").cast("date"))
    geo = spark.createDataFrame([("1", "X")], "geocode string, uf string")
    population = spark.createDataFrame([("1", 2001, 0)], "geocode string, year int, population long")
    assert rollup.weighted_mean(climate, population, geo, ["uf", "date"], ["t"]).first().t is None
