"""Combining members and recalibrating their intervals.

Units are grouped on their key columns only; the observation rides along, so a week that is not yet
observed keeps its ensemble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import INTERVAL_LEVELS, QUANTILE_COLUMNS
from tidecast.functions import quantiles as qt
from tidecast.functions import scoring as sc
from tidecast.operators import order_stats as os_
from tidecast.operators.scores import UNIT

CARRIED = ["origin_date", "observed_value"]


def _carry() -> list[Column]:
    return [F.max(c).alias(c) for c in CARRIED]


def median_ensemble(members: DataFrame, models: list[str] | None, name: str = "ensemble_vincent",
                    unit: list[str] = UNIT) -> DataFrame:
    """Median of each quantile over the members (``models`` of them, or all)."""
    chosen = members if models is None else members.filter(F.col("model").isin(models))
    combined = chosen.groupBy(*unit).agg(
        *_carry(), *[F.percentile(c, 0.5).alias(c) for c in QUANTILE_COLUMNS]
    )
    return qt.rearrange(combined).withColumn("model", F.lit(name))


def inverse_score_weights(scored: DataFrame, models: list[str], tuning_fold: int = 1, power: float = 1.0) -> DataFrame:
    """model, weight: inverse mean score on the tuning fold, normalised; absent members get 0."""
    return weights_by_fold(scored.filter(F.col("fold_id") == tuning_fold), models, power).drop("fold_id")


def weights_by_fold(scored: DataFrame, models: list[str], power: float = 1.0) -> DataFrame:
    """Inverse-score weights for every choice of tuning fold, in one pass.

    The table has one row per fold and member, so the window over it stays small.
    """
    means = scored.filter(F.col("model").isin(models)).groupBy("fold_id", "model").agg(F.avg("wis").alias("m"))
    raw = means.withColumn("raw", F.pow(F.try_divide(F.lit(1.0), F.col("m")), F.lit(power)))
    share = F.col("raw") / F.sum("raw").over(W.partitionBy("fold_id"))
    return raw.select("fold_id", "model", share.alias("weight"))


def weighted_ensemble(members: DataFrame, weights: DataFrame, name: str = "ensemble_invwis",
                      unit: list[str] = UNIT) -> DataFrame:
    """Weighted mean of each quantile over the members present (one weight row per model is broadcast)."""
    sub = members.join(F.broadcast(weights), "model")
    sums = [F.sum(F.col(c) * F.col("weight")).alias(c) for c in QUANTILE_COLUMNS]
    total = sub.groupBy(*unit).agg(*_carry(), *sums, F.sum("weight").alias("_w"))
    mean = total.select(*unit, *CARRIED, *[F.try_divide(c, "_w").alias(c) for c in QUANTILE_COLUMNS])
    return qt.rearrange(mean).withColumn("model", F.lit(name))


def equal_weights(models_table: DataFrame) -> DataFrame:
    return models_table.select("model").distinct().withColumn("weight", F.lit(1.0))


def widening_multiples(calib: DataFrame) -> DataFrame:
    """One row per calibration row and interval level with the multiple that would just cover it."""
    y = F.col("observed_value").cast("double")
    pairs = F.array(*[
        F.struct(F.lit(v).alias("level"), sc.widening_needed(y, v).alias("multiple")) for v in INTERVAL_LEVELS
    ])
    keep = [c for c in ("model", "subset") if c in calib.columns]
    return calib.select(*keep, F.inline(pairs))


def widening_factors(calib: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, level, factor: the level-th quantile of the needed multiple.

    Every calibration row enters, so the selection is the distributed one.
    """
    keys = keys or []
    quantiles = os_.exact_quantiles(
        widening_multiples(calib), keys + ["level"], "multiple", [v / 100 for v in INTERVAL_LEVELS]
    )
    own_level = F.round(F.col("quantile_level") * 100).cast("int") == F.col("level")
    return quantiles.filter(own_level).select(*keys, "level", F.col("multiple").alias("factor"))


def apply_widening(wide: DataFrame, factors: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Move the bounds about the median by the factors (four rows per key) and sort again."""
    keys = keys or []
    one = factors.groupBy(*keys).pivot("level", INTERVAL_LEVELS).agg(F.max("factor"))
    one = one.select(*keys, *[F.col(str(v)).alias(f"_f{v}") for v in INTERVAL_LEVELS])
    joined = wide.join(F.broadcast(one), keys) if keys else wide.join(F.broadcast(one))
    others = [c for c in wide.columns if c not in QUANTILE_COLUMNS and c != "model"]
    moved = joined.select(*others, *qt.widen({v: F.col(f"_f{v}") for v in INTERVAL_LEVELS}))
    return qt.rearrange(moved).withColumn("model", F.lit(name))


def conformal_ensemble(ensemble: DataFrame, name: str = "ensemble_conformal", tuning_fold: int = 1) -> DataFrame:
    """Factors from the tuning fold, applied to every fold."""
    calib = ensemble.filter((F.col("fold_id") == tuning_fold) & F.col("observed_value").isNotNull())
    return apply_widening(ensemble, widening_factors(calib), name)


def additive_shifts(calib: DataFrame, keys: list[str], score: str = "score", minimum: int = 200) -> DataFrame:
    """keys, quantile_level, shift: finite-sample order statistic of the conformity scores.

    ``calib`` has one row per calibration row and level; groups of at most ``minimum`` rows get a shift of 0.
    """
    picked = os_.exact_quantiles(calib, keys + ["level"], score, [v / 100 for v in INTERVAL_LEVELS],
                                 rank=os_.conformal_rank)
    own_level = F.round(F.col("quantile_level") * 100).cast("int") == F.col("level")
    shift = F.when(F.col("n") > minimum, F.col(score)).otherwise(F.lit(0.0))
    return picked.filter(own_level).select(*keys, "level", "n", shift.alias("shift"))


def subsets(models: list[str], minimum: int = 2) -> list[tuple[int, list[str]]]:
    """Bit mask and members of every subset; the member list is short and fixed."""
    out = []
    for mask in range(1, 1 << len(models)):
        chosen = [m for i, m in enumerate(models) if mask >> i & 1]
        if len(chosen) >= minimum:
            out.append((mask, chosen))
    return out


def subset_ensembles(members: DataFrame, models: list[str], minimum: int = 2) -> DataFrame:
    """Median ensemble of every member subset in one plan: each row joins the subsets that contain it.

    Column ``subset`` holds the bit mask, so calibration and scores can be keyed by it.
    """
    member_of = F.lit(None).cast("array<int>")
    for i, name in enumerate(models):
        masks = [mask for mask, chosen in subsets(models, minimum) if name in chosen]
        member_of = F.when(F.col("model") == name, F.array(*[F.lit(m) for m in masks])).otherwise(member_of)
    exploded = members.filter(F.col("model").isin(models)).withColumn("subset", F.explode(member_of))
    return median_ensemble(exploded, models, "ensemble_subset", UNIT + ["subset"])
