"""Origin x horizon panel: every synthetic origin of every fold with features, anchors and labels.

Everything that looks backward is computed once on the full history and then cut per fold; only the
temperature anomaly depends on the fold. Labels, seasonal anchors, seasonal forecasts and target-year
population are looked up in arrays and maps carried by the origin row, so the wide panel (67 rows per
origin) is exploded last and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import AR_LAGS, CLIMATE_COLUMNS, INDEX_LAGS, INDICES, MAX_HORIZON
from tidecast.functions import calendar as cal
from tidecast.functions import transforms as tf
from tidecast.operators import folds as fo
from tidecast.operators import rollup
from tidecast.operators import windows as wn

ORIGIN_FEATURES = (
    [f"lag_{k}" for k in AR_LAGS]
    + ["roll_mean_4", "roll_std_4", "roll_mean_8", "roll_max_12"]
    + [f"{c}_roll4" for c in CLIMATE_COLUMNS] + ["temp_anomaly"]
    + [f"{i}_lag{k}" for i in INDICES for k in INDEX_LAGS]
)
SEASONAL_FEATURES = ["seasonal_temp", "seasonal_humid", "seasonal_precip"]
TARGET_FEATURES = (
    ["horizon_weeks", "target_epiweek", "sin1", "cos1", "sin2", "cos2", "seasonal_anchor", "log_pop"]
    + SEASONAL_FEATURES
)
FEATURES = ORIGIN_FEATURES + TARGET_FEATURES
#: Weeks an anchor can lie back at most: years of 53 weeks are at most seven apart.
ANCHOR_WEEKS = 7 * 53


def origin_series(series: DataFrame, population: DataFrame, climate: DataFrame, ocean: DataFrame,
                  horizons: int = MAX_HORIZON, attach: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """geo, date with backward features, the values ahead and the last ``ANCHOR_WEEKS`` values (fold-free).

    Climate is smoothed over its own history, then looked up. All joins, ``attach`` included, run on narrow rows before the windows: once a row carries its
    history, it neither moves nor gets sorted again.
    """
    smooth = climate.withColumns(wn.climate_rolling(["geo"])).drop("precip_med", "rel_humid_med")
    joined = rollup.add_incidence(series, population).join(smooth, ["geo", "date"], "left")
    joined = attach(joined.withColumn("epiweek", cal.epi_week(F.col("date"))))
    joined = joined.join(F.broadcast(wn.index_lags(ocean)), "date", "left")
    w = wn.series_window(["geo"])
    return joined.withColumns({
        **wn.autoregressive_lags("log_inc", ["geo"]), **wn.rolling("log_inc", ["geo"]),
        "ahead": wn.leading_values("log_inc", ["geo"], horizons),
        "history": wn.collected("log_inc", w.rowsBetween(1 - ANCHOR_WEEKS, 0)),
    })


def fold_means(climate: DataFrame, folds: DataFrame) -> DataFrame:
    """geo, epiweek, map fold -> mean temperature of that week over all climate rows up to the fold's cut-off."""
    cut = fo.training(wn.with_epi_week(climate), folds)
    means = cut.groupBy("geo", "epiweek", "fold_id").agg(F.avg("temp_med").alias("m"))
    entries = F.collect_list(F.struct("fold_id", "m"))
    return means.groupBy("geo", "epiweek").agg(F.map_from_entries(entries).alias("_means"))


def with_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """The fold table as one array per row.

    Rows are partitioned by geo here, with a fixed count: they are few and narrow, but each becomes
    hundreds in the expansion, which runs in the same stage.
    """
    fold = F.struct("fold_id", "train_cutoff", "target_start", "target_end")
    table = folds.agg(F.array_sort(F.collect_list(fold)).alias("_folds"))
    return rollup.by_geo(df.join(F.broadcast(table)))


def per_fold(origins: DataFrame) -> DataFrame:
    """Origins up to each fold's cut-off, with the anomaly against the fold's own training span."""
    others = [c for c in origins.columns if c not in ("_folds", "_means")]
    tagged = origins.select(*others, "_means", F.explode("_folds").alias("_fold"))
    cut = tagged.filter(F.col("date") <= F.col("_fold.train_cutoff"))
    departure = F.col("temp_med") - F.col("_means")[F.col("_fold.fold_id")]
    return cut.select(*others, "_fold.*", departure.alias("temp_anomaly"))


def carried_origins(series: DataFrame, folds: DataFrame, population: DataFrame, climate: DataFrame,
                    ocean: DataFrame, seasonal: DataFrame, static: DataFrame, horizons: int) -> DataFrame:
    """Origin rows of all folds with everything the expansion looks up."""

    def attach(df: DataFrame) -> DataFrame:
        dated = df.withColumn("origin_month", cal.month_start(F.col("date")))
        joined = dated.join(seasonal_by_origin_month(seasonal), ["geo", "origin_month"], "left")
        joined = joined.join(fold_means(climate, folds), ["geo", "epiweek"], "left")
        return with_folds(joined.join(geo_dimension(static, population), "geo", "left"), folds)

    return per_fold(origin_series(series, population, climate, ocean, horizons, attach))


def horizon_calendar(weeks: DataFrame, horizons: int = MAX_HORIZON) -> DataFrame:
    """date, steps: for every origin week and horizon the target and how far back its anchor lies.

    The anchor is the latest week at or before the origin with the target's week number. The table
    depends on the calendar alone.
    """
    origins = weeks.select("date").distinct()
    pairs = origins.withColumn("horizon_weeks", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    pairs = pairs.withColumn("target_date", cal.add_weeks(F.col("date"), F.col("horizon_weeks")))
    pairs = pairs.withColumn("target_epiweek", cal.epi_week(F.col("target_date")))
    past = origins.select(F.col("date").alias("_past"), cal.epi_week(F.col("date")).alias("target_epiweek"))
    keys = ["date", "horizon_weeks", "target_date", "target_epiweek"]
    anchored = pairs.join(past, "target_epiweek", "left").groupBy(*keys).agg(
        F.max(F.when(F.col("_past") <= F.col("date"), F.col("_past"))).alias("_anchor")
    )
    back = F.floor(F.datediff("date", "_anchor") / 7).cast("int").alias("back")
    step = F.struct("horizon_weeks", "target_date", "target_epiweek", back)
    return anchored.groupBy("date").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def seasonal_by_origin_month(seasonal: DataFrame) -> DataFrame:
    """geo, origin_month, map target month -> latest forecast issued by the origin month.

    A forecast reaches at most six months ahead, so it is valid for at most seven origin months and a
    map holds at most seven entries.
    """
    months = F.sequence("reference_month", "target_month", F.expr("interval 1 month"))
    valid = seasonal.withColumn("origin_month", F.explode(months))
    values = F.struct(*[F.col(a).alias(b) for a, b in zip(["temp_med", "umid_med", "precip_tot"], SEASONAL_FEATURES)])
    latest = valid.groupBy("geo", "origin_month", "target_month").agg(F.max_by(values, "reference_month").alias("v"))
    return latest.groupBy("geo", "origin_month").agg(
        F.map_from_entries(F.collect_list(F.struct("target_month", "v"))).alias("seasonal")
    )


def geo_dimension(static: DataFrame, population: DataFrame) -> DataFrame:
    """One row per geo: static shares and a map year -> population."""
    by_year = population.groupBy("geo").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "population"))).alias("pop_by_year")
    )
    return by_year.join(static, "geo", "left").na.fill(0.0, [c for c in static.columns if c != "geo"])


def expand(origins: DataFrame, weeks: DataFrame, static: list[str], population: DataFrame, until: Column,
           horizons: int = MAX_HORIZON) -> DataFrame:
    """Explode origins to the horizons whose target lies at or before ``until``, and look up the rest."""
    low = population.select(F.min("year")).scalar()
    high = population.select(F.max("year")).scalar()
    carried = origins.join(F.broadcast(horizon_calendar(weeks, horizons)), "date").withColumns({"_low": low, "_high": high})
    fixed = ["fold_id", "geo", F.col("date").alias("origin_date"), "train_cutoff", "target_start", "target_end",
             *ORIGIN_FEATURES, *static]
    # Exploding, filtering and the lookups share one generated stage, so the arrays are read in place.
    rows = carried.select(
        *fixed, "history", "ahead", "seasonal", "pop_by_year", "_low", "_high", F.inline("steps")
    ).filter(F.col("target_date") <= until)
    year = cal.clamp_year(F.year("target_date"), F.col("_low"), F.col("_high"))
    future = F.col("seasonal")[cal.month_start(F.col("target_date"))]
    looked_up = rows.withColumns({
        "seasonal_anchor": F.get("history", F.size("history") - 1 - F.col("back")),
        "label": F.get("ahead", F.col("horizon_weeks") - 1),
        "population_at_target": F.col("pop_by_year")[year],
        **{c: future[c] for c in SEASONAL_FEATURES},
        **tf.harmonics(F.col("target_epiweek")),
    }).drop("history", "ahead", "seasonal", "pop_by_year", "_low", "_high", "back")
    return looked_up.withColumn("log_pop", F.log(F.col("population_at_target").cast("double")))


def build(series: DataFrame, folds: DataFrame, population: DataFrame, climate: DataFrame, ocean: DataFrame,
          seasonal: DataFrame, static: DataFrame, min_origin: str) -> DataFrame:
    """Training panel of all folds: every origin and horizon whose label is observed by the cut-off."""
    origins = carried_origins(series, folds, population, climate, ocean, seasonal, static, MAX_HORIZON)
    kept = origins.filter(F.col("date") >= F.lit(min_origin).cast("date"))
    panel = expand(kept, series, _share_columns(static), population, F.col("train_cutoff"))
    return panel.filter(F.col("label").isNotNull())


def prediction(series: DataFrame, folds: DataFrame, population: DataFrame, climate: DataFrame, ocean: DataFrame,
               seasonal: DataFrame, static: DataFrame) -> DataFrame:
    """Features of the real targets: origin at the cut-off, horizons of the target window."""
    longest = MAX_HORIZON + 1
    origins = carried_origins(series, folds, population, climate, ocean, seasonal, static, longest)
    kept = origins.filter(F.col("date") == F.col("train_cutoff"))
    targets = expand(kept, series, _share_columns(static), population, F.col("target_end"), longest)
    return targets.filter(F.col("target_date") >= F.col("target_start")).drop("label")


def _share_columns(static: DataFrame) -> list[str]:
    return [c for c in static.columns if c != "geo"]
