"""Datasets for sequence learners: fixed-length input windows with labels, mask and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import MAX_HORIZON, SEQUENCE_LENGTH
from tidecast.functions import calendar as cal
from tidecast.functions import transforms as tf
from tidecast.operators import folds as fo
from tidecast.operators import windows as wn

NUMERIC = ["log_inc", "temp_med", "precip_med", "rel_humid_med"]
FEATURES = [*NUMERIC, "sin1", "cos1"]


def standardisation(train: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample deviation per fold over all geos; a zero deviation becomes 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"),
                 F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std")]
    return train.groupBy("fold_id").agg(*aggs)


def weekly_frame(series_inc: DataFrame, climate: DataFrame) -> DataFrame:
    """Weekly features per geo: log incidence, climate and week of the year."""
    joined = series_inc.join(climate, ["geo", "date"], "left")
    return joined.withColumn("epiweek", cal.epi_week(F.col("date")))


def sequence_dataset(weekly: DataFrame, folds: DataFrame, min_origin: str, length: int = SEQUENCE_LENGTH,
                     horizons: int = MAX_HORIZON, include_origin: bool = False) -> DataFrame:
    """One row per (fold, geo, origin): window, labels, mask and population for every horizon.

    Training windows end one week before the origin, prediction windows at the origin
    (``include_origin``). Labels past the fold's cut-off are 0 with mask 0.
    """
    train = fo.training(weekly, folds)
    scale = standardisation(train, NUMERIC)
    scaled = train.join(F.broadcast(scale), "fold_id")
    for c in NUMERIC:
        scaled = scaled.withColumn(c, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
    waves = tf.harmonics(F.col("epiweek"))
    scaled = scaled.withColumns({"sin1": waves["sin1"], "cos1": waves["cos1"]})
    keys = ["fold_id", "geo"]
    built = scaled.select(
        *keys, F.col("date").alias("origin_date"), "train_cutoff", "population",
        wn.trailing_sequence(FEATURES, keys, length, include_origin).alias("window"),
        wn.leading_values("casos", keys, horizons).alias("_next"),
        wn.leading_values("population", keys, horizons).alias("_next_pop"),
        F.row_number().over(W.partitionBy(*keys).orderBy("date")).alias("_rn"),
    )
    # An origin needs `length` earlier rows either way, so both variants keep the same origins.
    kept = built.filter(
        F.col("window").isNotNull() & (F.col("_rn") > length) & (F.col("origin_date") >= F.lit(min_origin).cast("date"))
    )
    steps = F.sequence(F.lit(0), F.lit(horizons - 1))
    return kept.select(
        *keys, "origin_date", fo.calibration_block(F.col("origin_date"), F.col("train_cutoff")).alias("block"), "window",
        F.transform(steps, lambda i: F.coalesce(F.get("_next", i), F.lit(0))).alias("labels"),
        F.transform(steps, lambda i: F.when(i < F.size("_next"), 1).otherwise(0)).alias("mask"),
        F.transform(steps, lambda i: F.coalesce(F.get("_next_pop", i), F.col("population"))).alias("populations"),
    )
