"""Roll-ups across the geography hierarchy and the dense weekly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.functions import transforms as tf


def sum_to_state(cases: DataFrame, exclude: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weekly sums per state; the excluded state is dropped before anything is summed."""
    kept = cases.filter(F.col("uf") != exclude) if exclude else cases
    return kept.groupBy(*keys, F.col("uf").alias("geo"), "date").agg(F.sum("casos").alias("casos"))


def by_geo(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Partition by geo once, so that the windows and aggregates per geo that follow add no exchange.

    Into ``spark.sql.shuffle.partitions`` parts whatever the size of the cluster: set it to a few times the cores.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "geo")


def densify(series: DataFrame, keys: tuple[str, ...] = (), value: str = "casos") -> DataFrame:
    """Every geo on every Sunday between the first and last week of the data, holes filled with zero.

    Each row fills the hole up to its successor, so one window per geo replaces a grid join. The
    result is left partitioned by geo, which the per-geo windows that follow reuse. The number of
    partitions is set by hand: what follows multiplies rows, so merging these small inputs would
    leave the heavy part to a few tasks.
    """
    series = by_geo(series, keys)
    # Whole rows go into min and max so that both uses of the series read the same shuffle files.
    row = F.struct("date", value)
    span_cols = [F.min(row)["date"].alias("_first"), F.max(row)["date"].alias("_last")]
    if keys:
        span = series.groupBy(*keys).agg(*span_cols)
        bounded = series.join(F.broadcast(span), list(keys))
    else:
        bounded = series.join(F.broadcast(series.agg(*span_cols)))
    w = W.partitionBy(*keys, "geo").orderBy("date")
    start = F.when(F.lag("date").over(w).isNull(), F.col("_first")).otherwise(F.col("date"))
    stop = F.coalesce(F.date_sub(F.lead("date").over(w), 7), F.col("_last"))
    filled = bounded.select(
        *keys, "geo", F.col("date").alias("_seen"), F.col(value).alias("_value"),
        F.sequence(start, stop, F.expr("interval 7 days")).alias("_weeks"),
    ).select(*keys, "geo", "_seen", "_value", F.explode("_weeks").alias("date"))
    amount = F.when(F.col("date") == F.col("_seen"), F.coalesce("_value", F.lit(0))).otherwise(F.lit(0))
    return filled.select(*keys, "geo", "date", amount.cast("bigint").alias(value))


def include_geos(series: DataFrame, geos: DataFrame, value: str = "casos") -> DataFrame:
    """The dense series with a row of zeros a week for every geo of ``geos`` that it lacks."""
    missing = geos.select("geo").distinct().join(series.select("geo").distinct(), "geo", "left_anti")
    span = series.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    weeks = F.explode(F.sequence("_first", "_last", F.expr("interval 7 days"))).alias("date")
    zeros = missing.join(F.broadcast(span)).select("geo", weeks).withColumn(value, F.lit(0).cast("bigint"))
    return by_geo(series.select("geo", "date", value).unionByName(zeros))


def state_population(population: DataFrame, geo_map: DataFrame) -> DataFrame:
    """geo, year, population."""
    return (
        population.join(geo_map.select("geocode", "uf").distinct(), "geocode")
        .groupBy(F.col("uf").alias("geo"), "year").agg(F.sum("population").alias("population"))
    )


def clamp_to(years: DataFrame, year: Column) -> Column:
    """Clamp a year to the range covered by ``years``; the range is a scalar subquery, not a join."""
    low = years.select(F.min("year").alias("v")).scalar()
    high = years.select(F.max("year").alias("v")).scalar()
    return cal.clamp_year(year, low, high)


def attach_population(df: DataFrame, population: DataFrame, date: str = "date", key: str = "geo",
                      as_name: str = "population", years: DataFrame | None = None) -> DataFrame:
    """Left join of the population of the row's year, clamped to the years that exist.

    ``years`` may name a cheaper table with the same years, so that finding the range does not build
    the whole population table once more.
    """
    side = population.select(key, F.col("year").alias("pop_year"), F.col("population").alias(as_name))
    return df.withColumn("pop_year", clamp_to(population if years is None else years, F.year(date))).join(side, [key, "pop_year"], "left")


def add_incidence(series: DataFrame, population: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Population, incidence per 100,000 and its log1p for every row."""
    joined = attach_population(series, population, years=years)
    return joined.withColumns({
        "incidence": tf.incidence(F.col("casos"), F.col("population")),
        "log_inc": tf.log_incidence(F.col("casos"), F.col("population")),
    })


def weighted_mean(climate: DataFrame, population: DataFrame, geo_map: DataFrame, by: list[str],
                  values: list[str], exclude: str | None = None, years: DataFrame | None = None) -> DataFrame:
    """Population-weighted mean of every value column; a missing weight counts as 1.

    A missing value leaves the numerator while its weight stays in the denominator.
    """
    mapped = climate.join(geo_map.select("geocode", "uf").distinct(), "geocode")
    if exclude:
        mapped = mapped.filter(F.col("uf") != exclude)
    weighted = attach_population(mapped, population, key="geocode", as_name="w", years=years)
    weighted = weighted.withColumn("w", F.coalesce("w", F.lit(1)))
    sums = [F.sum(F.col(v) * F.col("w")).alias(v) for v in values]
    grouped = weighted.groupBy(*by).agg(*sums, F.sum("w").alias("w"))
    return grouped.select(*by, *[F.try_divide(F.col(v), F.col("w")).alias(v) for v in values])


def weighted_seasonal(forecast: DataFrame, weights: DataFrame, geo_map: DataFrame,
                      values: list[str]) -> DataFrame:
    """Weighted seasonal forecast per (geo, reference month, months ahead) with its target month.

    Here a missing weight counts as 0, and a zero total gives a missing value.
    """
    joined = forecast.join(geo_map.select("geocode", "uf").distinct(), "geocode").join(weights, "geocode", "left")
    w = F.coalesce(F.col("population"), F.lit(0))
    keys = [F.col("uf").alias("geo"), "reference_month", "forecast_months_ahead"]
    total = joined.groupBy(*keys).agg(
        *[F.sum(F.col(v) * w).alias(v) for v in values], F.sum(w).alias("w")
    )
    return total.select(
        "geo", "reference_month", "forecast_months_ahead",
        F.add_months("reference_month", F.col("forecast_months_ahead")).alias("target_month"),
        *[(F.col(v) / F.nullif(F.col("w"), F.lit(0))).alias(v) for v in values],
    )


def category_shares(environment: DataFrame, weights: DataFrame, geo_map: DataFrame,
                    categories: dict[str, list[str]]) -> DataFrame:
    """Population share of each category per geo, one column each; absent categories are 0.

    ``categories`` maps a column to its known values, so the output schema never depends on a scan.
    """
    joined = environment.join(geo_map.select("geocode", "uf").distinct(), "geocode").join(weights, "geocode", "left")
    w = F.coalesce(F.col("population"), F.lit(0))
    shares = []
    for column, names in categories.items():
        for name in names:
            label = f"{column}_frac_" + name.replace(" ", "_").replace("â", "a")
            part = F.sum(F.when(F.col(column) == name, w).otherwise(F.lit(0)))
            shares.append(F.coalesce(part / F.nullif(F.sum(w), F.lit(0)), F.lit(0.0)).alias(label))
    return joined.groupBy(F.col("uf").alias("geo")).agg(*shares)


def fixed_year_weight(population: DataFrame, year: int) -> DataFrame:
    return population.filter(F.col("year") == year).select("geocode", "population")
