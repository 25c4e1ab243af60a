"""Output tables per geography and season: build, validate and write only what is valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.constants import QUANTILE_COLUMNS
from tidecast.operators import joins as jn
from tidecast.operators import quality as ql

TABLE_KEYS = ["track", "season_year", "geo"]


def build_tables(forecasts: DataFrame) -> DataFrame:
    """Every table (track, season_year, geo) on its full season spine; absent weeks become nulls."""
    spine = jn.season_spine(forecasts.select(*TABLE_KEYS).distinct())
    columns = [*TABLE_KEYS, "date", *QUANTILE_COLUMNS]
    return jn.reindex(forecasts.select(*columns), spine, [*TABLE_KEYS, "date"])


def verdicts(tables: DataFrame) -> DataFrame:
    return ql.table_verdicts(tables, TABLE_KEYS)


def valid_tables(tables: DataFrame) -> DataFrame:
    """Rows of the tables that pass every check."""
    good = verdicts(tables).filter("valid").select(*TABLE_KEYS)
    return tables.join(good, TABLE_KEYS, "left_semi")


def write_valid(tables: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per (track, season, geo); rows of a table are brought together before writing.

    A table is one season of one geo, so the exchange on its keys is even and each file is small.
    """
    partitioned = valid_tables(tables).repartition(*[F.col(c) for c in TABLE_KEYS])
    ordered = partitioned.sortWithinPartitions(*TABLE_KEYS, "date")
    writer = ordered.write.mode("overwrite").partitionBy(*TABLE_KEYS)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_report(tables: DataFrame) -> DataFrame:
    """Number of valid and failed tables per track."""
    return verdicts(tables).groupBy("track").agg(
        F.count_if("valid").alias("ok"), F.count_if(~F.col("valid")).alias("failed")
    )


def first_failures(tables: DataFrame, k: int = 10) -> DataFrame:
    """The first failures in key order, for the report only."""
    failed = verdicts(tables).filter(~F.col("valid"))
    return failed.orderBy(*TABLE_KEYS).limit(k).select(*TABLE_KEYS, "reason")


def write_scores(scored: DataFrame, path: str) -> None:
    """Per-unit scores as Parquet by fold."""
    scored.write.mode("overwrite").partitionBy("fold_id").parquet(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """A leaderboard has one row per model: a single CSV file."""
    board.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_state(state: DataFrame, path: str) -> None:
    """Fitted state is a table; saving it is a write."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def best_of_tracks(scored: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows of the model chosen for each track, with season_year and geo ready for ``build_tables``.

    ``tracks`` has one row per track: track, disease, level, model.
    """
    return scored.join(F.broadcast(tracks), ["disease", "level", "model"])
