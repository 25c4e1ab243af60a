"""Readers for the raw CSV tables.

A gzip file cannot be split, so one file is one task: the readers project and filter right after the
scan, and ``landing.land`` rewrites the result as Parquet, partitioned by year, for every later query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.sources import schemas


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def cases(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CASES)


def climate(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CLIMATE)


def mixed_date(text: Column) -> Column:
    """A date written either as a day or as a day with a midnight time."""
    return F.to_date(F.substring(text, 1, 10))


def seasonal_forecast(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, schemas.SEASONAL_FORECAST)
    return raw.withColumn("reference_month", mixed_date(F.col("reference_month")))


def ocean(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.OCEAN)


def environment(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.ENVIRONMENT)


def population(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.POPULATION)


def only_topic(df: DataFrame, topic: str | None) -> DataFrame:
    return df if topic is None else df.filter(F.col("accessed_disease") == topic)


def access(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Access log of one topic, or of all when ``topic`` is None."""
    return only_topic(_csv(spark, path, schemas.ACCESS), topic)


def geo_map(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.GEO_MAP)


def coerce_double(text: Column) -> Column:
    """Numeric value of a text cell, missing when it is not a finite number."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def scored(spark: SparkSession, path: str) -> DataFrame:
    """Scores written by an earlier stage; cells that do not parse become missing."""
    raw = _csv(spark, path, schemas.SCORED)
    return raw.select(
        "model", F.col("fold_id").try_cast("int").alias("fold_id"), "geo",
        F.col("date").try_cast("date").alias("date"),
        *[coerce_double(F.col(c)).alias(c) for c in ("observed_value", "wis", "pred")],
    )
