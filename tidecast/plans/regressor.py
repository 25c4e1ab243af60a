"""Pooled panel regressor: boosted trees on the panel, quantiles from residuals, conformal widening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.constants import INTERVAL_LEVELS, QUANTILE_COLUMNS, QUANTILE_LEVELS
from tidecast.functions import quantiles as qt
from tidecast.functions import scoring as sc
from tidecast.functions import transforms as tf
from tidecast.operators import ensemble as en
from tidecast.operators import folds as fo
from tidecast.operators import order_stats as os_
from tidecast.operators.scores import horizon_bin
from tidecast.plans import boosting
from tidecast.session import staged

#: Boosting by default: rounds, depth, learning rate and histogram bins (bin 0 is for missing values). More rounds at a
#: lower rate fit closer, at a cost of ``depth`` passes a round, whatever the number of folds; all are arguments.
ROUNDS, DEPTH, STEP, BINS = 20, 5, 0.25, 32


def with_block(panel: DataFrame) -> DataFrame:
    return panel.withColumn("block", fo.calibration_block(F.col("origin_date"), F.col("train_cutoff")))


def residual_quantiles(scored_panel: DataFrame) -> DataFrame:
    """fold_id, horizon_bin, nine residual quantiles of the proper block, by distributed selection."""
    residuals = scored_panel.filter(F.col("block") == "proper").select(
        "fold_id", _bin().alias("bin"), (F.col("label") - F.col("centre")).alias("residual")
    )
    long = os_.exact_quantiles(residuals, ["fold_id", "bin"], "residual", QUANTILE_LEVELS)
    wide = long.groupBy("fold_id", "bin").pivot("quantile_level", QUANTILE_LEVELS).agg(F.max("residual"))
    return wide.select("fold_id", "bin", F.array(*[F.col(f"`{v}`") for v in QUANTILE_LEVELS]).alias("residual_q"))


def _bin():
    # The training panel also has horizons 1..15, which the published bins leave out.
    return F.coalesce(horizon_bin(F.col("horizon_weeks")), F.when(F.col("horizon_weeks") <= 15, "1-15"), F.lit("52-67"))


def log_quantiles(df: DataFrame, residual_q: DataFrame) -> DataFrame:
    """Wide quantiles in log-incidence space (twenty residual rows at most are broadcast)."""
    joined = df.withColumn("bin", _bin()).join(F.broadcast(residual_q), ["fold_id", "bin"])
    vector = F.transform("residual_q", lambda r: F.col("centre") + r)
    keep = [c for c in df.columns if c not in QUANTILE_COLUMNS]
    return joined.select(*keep, *qt.spread(vector))


def conformal_shifts(calibration: DataFrame) -> DataFrame:
    """fold_id, level, shift from the calibration block (A28)."""
    y = F.col("label")
    pairs = F.array(*[
        F.struct(F.lit(v).alias("level"), sc.conformity(y, F.col(f"lower_{v}"), F.col(f"upper_{v}")).alias("score"))
        for v in INTERVAL_LEVELS
    ])
    return en.additive_shifts(calibration.select("fold_id", F.inline(pairs)), ["fold_id"])


def to_counts(targets: DataFrame, shifts: DataFrame) -> DataFrame:
    """Apply the shifts, sort, and go back from log incidence to counts."""
    one = shifts.groupBy("fold_id").pivot("level", INTERVAL_LEVELS).agg(F.max("shift"))
    named = one.select("fold_id", *[F.col(str(v)).alias(f"_s{v}") for v in INTERVAL_LEVELS])
    joined = targets.join(F.broadcast(named), "fold_id", "left")
    moved = {"pred": F.col("pred")}
    for v in INTERVAL_LEVELS:
        s = F.coalesce(F.col(f"_s{v}"), F.lit(0.0))
        moved[f"lower_{v}"] = F.col(f"lower_{v}") - s
        moved[f"upper_{v}"] = F.col(f"upper_{v}") + s
    ordered = F.array_sort(F.array(*[moved[c] for c in QUANTILE_COLUMNS]))
    population = F.col("population_at_target")
    return joined.select(
        F.lit("panel_regressor").alias("model"), "fold_id", "geo", F.col("target_date").alias("date"),
        F.col("origin_date"), "horizon_weeks",
        F.transform(ordered, lambda v: tf.counts_from_log(v, population)).alias("q"),
    )


def forecast(panel: DataFrame, targets: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH,
             step: float = STEP, bins: int = BINS) -> DataFrame:
    """Boost all folds at once on their proper blocks, calibrate each on the rest and forecast the targets.

    Bins are cut at quantiles of the fold's own proper block, so that no later row shapes an earlier fold's features.
    """
    tagged = with_block(panel)
    proper = tagged.filter(F.col("block") == "proper")
    cuts = boosting.edges(proper, "fold_id", features, bins)
    needed = ["fold_id", "geo", "origin_date", "horizon_weeks", "block", "label"]
    rows = staged(boosting.coded(tagged, "fold_id", features, cuts, needed), "binned")
    forest = boosting.fit(rows.filter(F.col("block") == "proper"), "fold_id", len(features), bins + 1, rounds, depth, step)
    fitted_panel = staged(boosting.predicted(rows, forest, "fold_id", len(features)), "fitted")
    kept = ["fold_id", "geo", "origin_date", "target_date", "horizon_weeks", "population_at_target"]
    fitted_targets = boosting.predicted(boosting.coded(targets, "fold_id", features, cuts, kept), forest, "fold_id", len(features))
    residual_q = residual_quantiles(fitted_panel)
    calibration = log_quantiles(fitted_panel.filter(F.col("block") == "calib"), residual_q)
    return to_counts(log_quantiles(fitted_targets, residual_q), conformal_shifts(calibration))
