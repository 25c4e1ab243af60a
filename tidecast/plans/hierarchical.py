"""Seasonal climatology in incidence space, shrunk toward the macroregion by case volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.constants import INCIDENCE_SCALE, QUANTILE_LEVELS
from tidecast.functions import quantiles as qt
from tidecast.operators import folds as fo
from tidecast.operators import order_stats as os_
from tidecast.operators import rollup
from tidecast.plans.baselines import KEYS, forecast_columns, last_values, on_grid, pooled_weeks, week_counts, zeros


def region_of(geo_map: DataFrame) -> DataFrame:
    """geo, region: exactly one region per geo (the last by name when the map disagrees)."""
    return geo_map.groupBy(F.col("uf").alias("geo")).agg(F.max("macroregion").alias("region"))


def volumes(usable: DataFrame, nested: fo.Nested) -> DataFrame:
    """fold_id, geo, volume: cases up to each fold's cut-off."""
    spans = nested.trained(usable).groupBy("geo", "_span").agg(F.sum("casos").alias("_casos"))
    sums = spans.groupBy("geo").agg(*[F.sum(F.when(nested.until(i), F.col("_casos"))).cast("double").alias(f"v_{i}") for i in nested.ids])
    return sums.select("geo", nested.rows(volume="v")).filter("volume is not null")


def shrinkage_weights(volume: DataFrame, kappa: float | None = None, pool: Column | None = None) -> DataFrame:
    """fold_id, geo, weight = volume / (volume + kappa); kappa defaults to the median volume of the fold (and pool of geos)."""
    if kappa is None:
        volume = volume.withColumn("pool", F.lit("") if pool is None else pool)
        middle = os_.exact_quantiles(volume, ["fold_id", "pool"], "volume", [0.5]).select(
            "fold_id", "pool", F.col("volume").alias("kappa")
        )
        volume = volume.join(middle, ["fold_id", "pool"])
    else:
        volume = volume.withColumn("kappa", F.lit(float(kappa)))
    return volume.select(*KEYS, F.try_divide("volume", F.col("volume") + F.col("kappa")).alias("weight"))


def _by_week(vectors: DataFrame, key: str) -> DataFrame:
    """fold_id, key, map week -> quantiles."""
    return vectors.groupBy("fold_id", key).agg(F.map_from_entries(F.collect_list(F.struct("target_week", "q"))).alias(f"{key}_q"))


def regional_vectors(counts: DataFrame, nested: fo.Nested, value: str, lo: int, hi: int, parts: int | None = None) -> DataFrame:
    """fold_id, region, target_week, q from weekly histograms (region, epiweek, value, n_1, ...).

    A region's pool grows with its geos, so its ranks are searched in value ranges, all folds in one pass.
    """
    merged = counts.groupBy("region", "epiweek", value).agg(*[F.sum(f"n_{i}").alias(f"n_{i}") for i in nested.ids])
    keys = ["region", "target_week"]
    sets = [os_.QuantileSet(keys, QUANTILE_LEVELS, f"n_{i}", str(i)) for i in nested.ids]
    found = os_.exact_quantile_sets(os_.circular_week_pool(merged, lo, hi), value, sets, parts=parts)[0]
    return os_.vectors(found.withColumn("fold_id", F.col("set").cast("int")), ["fold_id", *keys], value)


def hierarchical(series: DataFrame, folds: DataFrame, population: DataFrame, geo_map: DataFrame,
                 calendar: DataFrame | None = None, kappa: float | None = None, window: int = 2,
                 pool: Column | None = None, years: DataFrame | None = None) -> DataFrame:
    """Blend of a geo's and its region's incidence quantiles, back in counts of the target year.

    Every geo of the series gets rows; one without a population gets zeros. ``pool`` tells apart, by geo, sets of geos
    that share nothing, such as the tracks of a stacked series. ``years`` has the years that populations cover, where
    ``population`` holds the series' geos only.
    """
    calendar = fo.fold_calendar(folds) if calendar is None else calendar
    nested = fo.Nested(folds)
    usable = rollup.add_incidence(series, population, years).filter(F.col("population") > 0)
    counts = week_counts(usable, nested, "incidence")
    own = _by_week(pooled_weeks(counts, nested, "incidence", -window, window), "geo")
    regional = _by_week(regional_vectors(counts.join(region_of(geo_map), "geo"), nested, "incidence", -window, window), "region")
    every = last_values(series, folds).select(*KEYS)
    fitted = (
        every.join(own, KEYS, "left").join(shrinkage_weights(volumes(usable, nested), kappa, pool), KEYS, "left")
        .join(region_of(geo_map), "geo", "left").join(regional, ["fold_id", "region"], "left")
    )
    week = F.col("epiweek")
    blended = qt.blend(
        F.coalesce("weight", F.lit(0.5)), F.coalesce(F.col("geo_q")[week], zeros()),
        F.coalesce(F.col("region_q")[week], zeros()),
    )
    grid = on_grid(fitted, calendar).withColumn("_inc", blended).drop("geo_q", "region_q")
    grid = rollup.attach_population(grid, population, years=years)
    q = F.transform("_inc", lambda v: F.greatest(v * F.col("population") / INCIDENCE_SCALE, F.lit(0.0)))
    return forecast_columns(grid, "hierarchical_climatological",
                            F.when(F.col("population").isNotNull(), q).otherwise(zeros()))
