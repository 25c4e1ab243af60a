"""Scoring joins, metric summaries and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import INTERVAL_LEVELS, METRIC_COLUMNS, QUANTILE_COLUMNS, QUANTILE_LEVELS
from tidecast.functions import scoring as sc

UNIT = ["fold_id", "geo", "date", "horizon_weeks"]


def pivot_wide(long: DataFrame, index: list[str]) -> DataFrame:
    """Long quantiles to nine columns (duplicates averaged), with the number of levels that are missing."""
    wide = long.groupBy(*index).pivot("quantile_level", QUANTILE_LEVELS).agg(F.avg("predicted_value"))
    renamed = wide.select(*index, *[F.col(f"`{t}`").alias(c) for t, c in zip(QUANTILE_LEVELS, QUANTILE_COLUMNS)])
    missing = sum((F.col(c).isNull().cast("int") for c in QUANTILE_COLUMNS), F.lit(0))
    return renamed.withColumn("missing_levels", missing)


def complete_only(pivoted: DataFrame) -> DataFrame:
    """Stop with an error when a row lacks a level, as part of the plan."""
    checked = F.when(F.col("missing_levels") > 0, F.raise_error("missing quantile levels")).otherwise(F.lit(True))
    return pivoted.filter(checked.cast("boolean")).drop("missing_levels")


def observe(wide: DataFrame, observed: DataFrame) -> DataFrame:
    """Inner join of forecasts with the observed value of the same geo and week."""
    return wide.join(observed.select("geo", "date", F.col("casos").alias("observed_value")), ["geo", "date"])


def attach_scores(df: DataFrame) -> DataFrame:
    """Score, its three parts, absolute error and coverage flags for wide rows with an observation."""
    y = F.col("observed_value")
    return df.withColumns({
        "wis": sc.wis_from_intervals(y),
        "dispersion": sc.dispersion(y),
        "overprediction": sc.overprediction(y),
        "underprediction": sc.underprediction(y),
        "ae_median": F.abs(y - F.col("pred")),
        **{f"coverage_{level}": sc.covered(y, level) for level in INTERVAL_LEVELS},
    })


def metric_summary(scored: DataFrame, by: list[str], exclude_folds: tuple[int, ...] = ()) -> DataFrame:
    kept = scored.filter(~F.col("fold_id").isin(*exclude_folds)) if exclude_folds else scored
    return kept.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in METRIC_COLUMNS])


def ratio_of_sums() -> Column:
    return F.try_divide(F.sum("wis"), F.sum("observed_value"))


def normalized_wis(scored: DataFrame, by: list[str], exclude_folds: tuple[int, ...] = ()) -> DataFrame:
    kept = scored.filter(~F.col("fold_id").isin(*exclude_folds)) if exclude_folds else scored
    return kept.groupBy(*by).agg(ratio_of_sums().alias("normalized_wis"))


def leaderboard(scored: DataFrame) -> DataFrame:
    """Mean score, normalized score and coverage in percent per model."""
    return scored.groupBy("model").agg(
        F.avg("wis").alias("wis"), ratio_of_sums().alias("nwis"),
        *[(F.avg(F.col(f"coverage_{v}").cast("double")) * 100).alias(f"c{v}") for v in INTERVAL_LEVELS],
    )


def two_leaderboards(scored: DataFrame, outlier_fold: int = 2) -> DataFrame:
    """Normalized score over all folds and without the outlier fold, in one pass."""
    plain = F.col("fold_id") != outlier_fold
    return scored.groupBy("model").agg(
        ratio_of_sums().alias("nwis_all"),
        F.try_divide(F.sum(F.when(plain, F.col("wis"))), F.sum(F.when(plain, F.col("observed_value"))))
        .alias("nwis_without_outlier"),
    )


def horizon_bin(h: Column) -> Column:
    """Right-closed bins of the horizon."""
    return (
        F.when((h > 15) & (h <= 27), "16-27").when((h > 27) & (h <= 39), "28-39")
        .when((h > 39) & (h <= 51), "40-51").when((h > 51) & (h <= 67), "52-67")
    )


def decomposition(scored: DataFrame, by: list[str]) -> DataFrame:
    parts = ["dispersion", "overprediction", "underprediction"]
    return scored.groupBy(*by).agg(*[F.avg(c).alias(c) for c in parts])


def reliability(scored: DataFrame) -> DataFrame:
    """Nominal against empirical coverage per model."""
    means = scored.groupBy("model").agg(
        *[F.avg(F.col(f"coverage_{v}").cast("double")).alias(f"c{v}") for v in INTERVAL_LEVELS]
    )
    pairs = F.array(*[
        F.struct(F.lit(v / 100).alias("nominal"), F.col(f"c{v}").alias("empirical")) for v in INTERVAL_LEVELS
    ])
    return means.select("model", F.inline(pairs))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    y = F.col("observed_value")
    return df.groupBy(*by).agg(
        *[F.avg(sc.covered(y, v).cast("double")).alias(f"coverage_{v}") for v in INTERVAL_LEVELS]
    )


def lag_scale(train: DataFrame, keys: list[str], m: int = 52) -> DataFrame:
    """Mean absolute m-lag difference per key; a tiny scale is missing."""
    step = F.col("casos") - F.lag("casos", m).over(W.partitionBy(*keys).orderBy("date"))
    scaled = train.withColumn("_step", F.abs(step)).groupBy(*keys).agg(F.avg("_step").alias("scale"))
    return scaled.withColumn("scale", F.when(F.col("scale") >= 1e-9, F.col("scale")))


def mase(scored: DataFrame, train: DataFrame, by: list[str], keys: list[str], m: int = 52) -> DataFrame:
    """Mean absolute error over the seasonal-naive error of the training series."""
    errors = scored.groupBy(*by).agg(F.avg("ae_median").alias("mae"))
    joined = errors.join(lag_scale(train, keys, m), keys, "left")
    return joined.select(*by, F.try_divide("mae", "scale").alias("mase"))


def peaks(scored: DataFrame, by: list[str]) -> DataFrame:
    """Peak timing error in positions and log ratio at the observed peak; the first maximum wins.

    A struct ordered by value and reversed position finds both peaks in one aggregation, without a sort.
    """
    position = F.col("horizon_weeks")
    top_obs = F.max(F.struct(F.col("observed_value").cast("double").alias("v"), (-position).alias("p"),
                             F.col("pred").alias("other")))
    top_pred = F.max(F.struct(F.col("pred").alias("v"), (-position).alias("p")))
    found = scored.groupBy(*by).agg(top_obs.alias("o"), top_pred.alias("f"))
    ok = (F.col("o.v") >= 1e-9) & (F.col("o.other") >= 1e-9)
    return found.select(
        *by, (F.col("o.p") - F.col("f.p")).cast("int").alias("peak_timing_error"),
        F.when(ok, F.log(F.try_divide(F.col("o.other"), F.col("o.v")))).alias("peak_magnitude_error"),
    )


def relative_wis(scored: DataFrame, baseline: str, unit: list[str], models: list[str]) -> DataFrame:
    """Pairwise relative score over units every model has, scaled so the baseline is 1.

    Log scores become columns of one row per unit, so the pairwise means need no self-join; the mean over
    rivals of a mean log ratio is the model's own mean times m/(m-1) less a constant that cancels.
    """
    logs = scored.filter(F.col("model").isin(models)).groupBy(*unit).pivot("model", models).agg(F.avg("wis"))
    crossed = logs.dropna(subset=models)
    floor = F.lit(1e-9)
    means = crossed.agg(*[F.avg(F.log(F.greatest(F.col(f"`{m}`"), floor))).alias(m) for m in models])
    rivals = max(len(models) - 1, 1)

    def log_theta(name: str) -> Column:
        gaps = [F.col(f"`{name}`") - F.col(f"`{m}`") for m in models if m != name]
        return sum(gaps, F.lit(0.0)) / rivals

    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.exp(log_theta(m) - log_theta(baseline)).alias("relative_wis"))
        for m in models
    ])
    return means.select(F.inline(rows))


def average_rank(board: DataFrame, metrics: list[str]) -> DataFrame:
    """Rank of each model on each metric, ties averaged (a leaderboard has one row per model)."""
    out = board
    for name in metrics:
        ties = F.count("*").over(W.partitionBy(name))
        out = out.withColumn(f"{name}_rank", F.rank().over(W.orderBy(name)) + (ties - 1) / 2.0)
    return out
