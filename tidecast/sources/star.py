"""The data model's raw tables, derived from the star-schema Parquet tables.

Each function is one lazy plan. Facts are pre-aggregated on their own key before any join, so a
supplier with a third of all lines reaches the join as at most one row per week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators.folds import tag_flags

EXCLUDED = "NATION_7"
FOLD_YEARS = (1998, 1999, 2000, 2001)
DISEASES = ("dengue", "chikungunya")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ship_week() -> Column:
    return cal.week_start(F.col("l_shipdate").cast("date"))


#: Rows of a map of geocodes that are broadcast at most.
MAP_ROWS = 1_000_000


def geo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode, uf, macroregion; to be broadcast up to ``MAP_ROWS`` rows, so that weekly facts meet it where they are."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    supplier = table(spark, sf_dir, "supplier")
    mapped = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("geocode"), F.col("n_name").alias("uf"), F.col("r_name").alias("macroregion"))
    return F.broadcast(mapped) if supplier.count() <= MAP_ROWS else mapped


def weekly_counts(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """geocode, date, casos, before the geography is attached."""
    lines = table(spark, sf_dir, "lineitem")
    if disease == "chikungunya":
        lines = lines.filter(F.col("l_returnflag") == "R")
    return (
        lines.select(F.col("l_suppkey").alias("geocode"), _ship_week().alias("date"), "l_quantity")
        .groupBy("geocode", "date").agg(F.sum("l_quantity").cast("bigint").alias("casos"))
    )


def cases(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """geocode, uf, date, casos of one disease."""
    counts = weekly_counts(spark, sf_dir, disease)
    return counts.join(geo_map(spark, sf_dir).select("geocode", "uf"), "geocode").select(
        "geocode", "uf", "date", "casos"
    )


def cases_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """disease, geocode, uf, date, casos of both diseases from a single scan."""
    quantity = F.col("l_quantity")
    counts = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("geocode"), _ship_week().alias("date"), "l_quantity", "l_returnflag")
        .groupBy("geocode", "date")
        .agg(F.sum(quantity).alias("a"), F.sum(F.when(F.col("l_returnflag") == "R", quantity)).alias("r"))
    )
    joined = counts.join(geo_map(spark, sf_dir).select("geocode", "uf"), "geocode")
    both = F.array(
        F.struct(F.lit(DISEASES[0]).alias("disease"), F.col("a").cast("bigint").alias("casos")),
        F.struct(F.lit(DISEASES[1]).alias("disease"), F.col("r").cast("bigint").alias("casos")),
    )
    return joined.select("geocode", "uf", "date", F.inline(both)).filter(F.col("casos").isNotNull())


def flagged_cases(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """Cases with the train_i, target_i and target_city flags of the published layout."""
    flagged = tag_flags(cases(spark, sf_dir, disease), folds(spark))
    return flagged.join(
        target_cities(spark, sf_dir, disease).withColumn("target_city", F.lit(True)), "geocode", "left"
    ).withColumn("target_city", F.coalesce("target_city", F.lit(False)))


def folds(spark: SparkSession) -> DataFrame:
    """fold_id, train_cutoff, target_start, target_end: one row per backtest season."""
    year = F.col("id").cast("int") + F.lit(FOLD_YEARS[0] - 1)
    return spark.range(1, len(FOLD_YEARS) + 1, numPartitions=1).select(
        F.col("id").cast("int").alias("fold_id"),
        cal.epi_week_start(year, 25).alias("train_cutoff"),
        cal.epi_week_start(year, 41).alias("target_start"),
        cal.epi_week_start(year + 1, 40).alias("target_end"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode, year, population."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("geocode"), F.year("l_shipdate").alias("year"))
        .agg((F.count("*") + 1000).alias("population"))
    )


def population_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years the population table covers, from one column and without its grouping."""
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"))


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode, date and three weekly measures."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("geocode"), _ship_week().alias("date"))
        .agg(
            F.avg(100 * F.col("l_discount")).alias("temp_med"),
            F.avg(100 * F.col("l_tax")).alias("precip_med"),
            F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("rel_humid_med"),
        )
    )


def ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and three national indices."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(cal.week_start(F.col("o_orderdate").cast("date")).alias("date"))
        .agg(
            (F.avg("o_totalprice") / 1e5).alias("enso"),
            F.count("*").cast("double").alias("iod"),
            (F.stddev_samp("o_totalprice") / 1e5).alias("pdo"),
        )
    )


def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode (customer), reference_month, forecast_months_ahead and three monthly measures."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("geocode"),
            cal.month_start(F.col("o_orderdate").cast("date")).alias("reference_month"),
            (F.col("o_orderkey") % 6 + 1).cast("int").alias("forecast_months_ahead"),
        )
        .agg(
            (F.avg("o_totalprice") / 1e5).alias("temp_med"),
            F.count("*").cast("double").alias("umid_med"),
            (F.max("o_totalprice") / 1e5).alias("precip_tot"),
        )
    )


def customer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode (customer) and uf, the geography of the seasonal forecast."""
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("geocode"), F.col("n_name").alias("uf"))


def customer_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode (customer) and a fixed weight; customers without a positive balance have none."""
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("geocode"), F.ceil("c_acctbal").cast("bigint").alias("population")
    )


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode, koppen, biome."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("geocode"),
        F.concat(F.lit("K"), (key % 9).cast("string")).alias("koppen"),
        F.concat(F.lit("biome "), (key % 6).cast("string")).alias("biome"),
    )


KOPPEN = [f"K{i}" for i in range(9)]
BIOMES = [f"biome {i}" for i in range(6)]


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geocode, access_date, accessed_disease, access_count."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("geocode"), F.col("ts").cast("date").alias("access_date"),
                 F.col("event_type").alias("accessed_disease"))
        .agg(F.count("*").alias("access_count"))
    )


#: Target cities of each disease, as (first, count) in order of their keys; the lists overlap, as published ones do.
CITIES = {"dengue": (0, 15), "chikungunya": (5, 10)}


def target_cities(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """The target cities of a disease: a fixed list, so a top-k by design. Operators take any table (geocode) instead."""
    first, count = CITIES[disease]
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("geocode"))
    return keys.orderBy("geocode").offset(first).limit(count)
