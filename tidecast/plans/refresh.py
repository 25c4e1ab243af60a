"""Incremental backtests: a stored score table of which only folds with changed inputs are forecast again.

The table is partitioned by model and fold. Beside it a manifest holds, per model and fold, a digest of what the fold's
scores depend on: its bounds, the rows it may train on and the observations of its target weeks. An anti join of the
wanted digests with the stored ones names the work to do, and dynamic partition overwrite replaces those partitions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.plans import backtest


def fold_states(series: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id, state: a digest of the fold's bounds and of the rows that it trains on or is scored with, in any order."""
    bounds = folds.select("fold_id", "train_cutoff", "target_start", "target_end")
    used = (F.col("date") <= F.col("train_cutoff")) | F.col("date").between(F.col("target_start"), F.col("target_end"))
    row = F.xxhash64("geo", "date", "casos")
    rows = series.join(F.broadcast(bounds), used).groupBy("fold_id").agg(
        F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("s"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("train_cutoff", "target_start", "target_end", "n", "x", "s")])
    return bounds.join(rows, "fold_id", "left").select("fold_id", F.sha2(text, 256).alias("state"))


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}/manifest")


def pending(wanted: DataFrame, stored: DataFrame | None) -> DataFrame:
    """model, fold_id, state of what is wanted and not stored in that state."""
    return wanted if stored is None else wanted.join(stored, ["model", "fold_id", "state"], "left_anti")


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "fold_id").parquet(path)


def refresh(path: str, forecasters: dict[str, backtest.Forecaster], series: DataFrame, folds: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Bring the score table below ``path`` up to date; the table and the (model, fold_id) that were forecast again.

    ``forecasters`` has each model under the name that its rows carry.

    Scores are written before the manifest says so: a run that is lost in between only repeats that work.
    """
    spark = series.sparkSession
    names = reduce(DataFrame.unionByName, [folds.select("fold_id", F.lit(m).alias("model")) for m in forecasters])
    wanted = names.join(fold_states(series, folds), "fold_id").select("model", "fold_id", "state")
    due = pending(wanted, _manifest(spark, path)).orderBy("model", "fold_id").collect()  # a row per model and fold
    by_folds: dict[tuple[int, ...], list[str]] = {}
    for model in forecasters:
        chosen = tuple(r["fold_id"] for r in due if r["model"] == model)
        if chosen:
            by_folds.setdefault(chosen, []).append(model)
    for chosen, models in by_folds.items():  # models that lack the same folds share a plan
        some = folds.filter(F.col("fold_id").isin(*chosen))
        scored = backtest.score(backtest.run([forecasters[m] for m in models], series, some), series, some)
        _replace(scored, f"{path}/scores")
    if due:
        _replace(spark.createDataFrame([tuple(r) for r in due], "model string, fold_id int, state string").coalesce(1), f"{path}/manifest")
    return spark.read.parquet(f"{path}/scores"), [(r["model"], r["fold_id"]) for r in due]
