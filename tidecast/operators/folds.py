"""Backtest folds: boundaries from flags, cut-offs and windows for all folds in one plan."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.constants import CALIBRATION_WEEKS
from tidecast.functions import calendar as cal


def fold_ids(folds: DataFrame) -> list[int]:
    """The ids of the fold table, one row per fold."""
    return [r["fold_id"] for r in folds.select("fold_id").distinct().orderBy("fold_id").collect()]


def tag_flags(df: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Add train_i and target_i flags for each fold of the fold table."""
    ids = fold_ids(folds)
    bounds = folds.groupBy().pivot("fold_id", ids).agg(
        F.max("train_cutoff").alias("c"), F.max("target_start").alias("s"), F.max("target_end").alias("e")
    )
    out = df.join(F.broadcast(bounds))
    d = F.col(date)
    for i in ids:
        out = out.withColumn(f"train_{i}", d <= F.col(f"{i}_c"))
        out = out.withColumn(f"target_{i}", d.between(F.col(f"{i}_s"), F.col(f"{i}_e")))
    return out.drop(*bounds.columns)


def boundaries(flagged: DataFrame, date: str = "date") -> DataFrame:
    """fold_id, train_cutoff, target_start, target_end and gap length, from one pass over the flags."""
    d = F.col(date)
    aggs = []
    ids = sorted(int(c[len("train_"):]) for c in flagged.columns if re.fullmatch(r"train_\d+", c))
    for i in ids:
        target = F.when(F.col(f"target_{i}"), d)
        aggs.append(
            F.struct(
                F.lit(i).alias("fold_id"),
                F.max(F.when(F.col(f"train_{i}"), d)).alias("train_cutoff"),
                F.min(target).alias("target_start"),
                F.max(target).alias("target_end"),
            ).alias(f"f{i}")
        )
    one = flagged.agg(*aggs)
    rows = one.select(F.inline(F.array(*[F.col(f"f{i}") for i in ids])))
    gap = F.floor(F.datediff("target_start", "train_cutoff") / 7) - 1
    return rows.withColumn("gap_weeks", gap.cast("int"))


def forecast_origin(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.max(date).alias("forecast_origin"))


def training(df: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Rows at or before each fold's cut-off, keyed by fold_id (the gap weeks stay out)."""
    return df.join(F.broadcast(folds.select("fold_id", "train_cutoff")), F.col(date) <= F.col("train_cutoff"))


def cutoffs(folds: DataFrame) -> list[tuple[int, dt.date]]:
    """(fold_id, train_cutoff) in order of the cut-off, one row per fold."""
    rows = folds.select("fold_id", "train_cutoff").distinct().orderBy("train_cutoff", "fold_id").collect()
    return [(r["fold_id"], r["train_cutoff"]) for r in rows]


class Nested:
    """Training spans of all folds at once. Cut-offs are nested: the rows up to one are those up to the one before and the
    span between the two. So a row belongs to one span, is aggregated once, and a fold's state is the sum of the spans up
    to its own, in place of a copy of each row for each fold."""

    def __init__(self, folds: DataFrame):
        self.bounds = cutoffs(folds)
        self.ids = [i for i, _ in self.bounds]

    def span(self, date: Column) -> Column:
        """Number of the first fold, in order of cut-off, that may see the date; as many as there are folds if none may."""
        ends = F.array(*[F.lit(d) for _, d in self.bounds])
        return F.size(F.filter(ends, lambda e: e < date))

    def trained(self, df: DataFrame, date: str = "date") -> DataFrame:
        """The rows that any fold may see, with their span."""
        return df.withColumn("_span", self.span(F.col(date))).filter(F.col("_span") < len(self.ids))

    def until(self, fold: int) -> Column:
        """Whether a row's span is among those of the fold."""
        return F.col("_span") <= self.ids.index(fold)

    def counts(self, spans: DataFrame, keys: list[str], value: str) -> DataFrame:
        """keys, value and how often it occurs up to each fold's cut-off (n_1, n_2, ...): a histogram, merged span by span."""
        return spans.groupBy(*keys, value).agg(*[F.sum(self.until(i).cast("bigint")).alias(f"n_{i}") for i in self.ids])

    def rows(self, **columns: str) -> Column:
        """One row per fold from columns numbered by fold: name="m" gives the values of m_1, m_2, ... as name."""
        return F.inline(F.array(*[
            F.struct(F.lit(i).alias("fold_id"), *[F.col(f"{c}_{i}").alias(name) for name, c in columns.items()]) for i in self.ids]))


def seen(df: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """The rows that at least one fold may train on: those up to the last cut-off."""
    last = folds.agg(F.max("train_cutoff").alias("_last"))
    return df.join(F.broadcast(last), F.col(date) <= F.col("_last")).drop("_last")


def issued(df: DataFrame, folds: DataFrame, month: str = "reference_month") -> DataFrame:
    """Forecasts issued in or before the month of each fold's cut-off."""
    return df.join(
        F.broadcast(folds.select("fold_id", "train_cutoff")),
        F.col(month) <= cal.month_start(F.col("train_cutoff")),
    )


def target_window(df: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Rows inside each fold's target window, for scoring only."""
    window = folds.select("fold_id", "target_start", "target_end")
    return df.join(F.broadcast(window), F.col(date).between(F.col("target_start"), F.col("target_end")))


def fold_calendar(folds: DataFrame) -> DataFrame:
    """Every target Sunday of every fold with its horizon; bounded by the calendar."""
    days = F.explode(F.sequence("target_start", "target_end", F.expr("interval 7 days"))).alias("date")
    out = folds.select("fold_id", F.col("train_cutoff").alias("origin_date"), days)
    return out.withColumn("horizon_weeks", cal.horizon_weeks(F.col("date"), F.col("origin_date")))


def target_grid(geos: DataFrame, folds: DataFrame) -> DataFrame:
    """geo x target week for all folds."""
    return geos.join(F.broadcast(fold_calendar(folds)))


def calibration_block(origin: Column, cutoff: Column, weeks: int = CALIBRATION_WEEKS) -> Column:
    """'proper' for the origins used to fit, 'calib' for the last block of origins before the cut-off."""
    return F.when(origin < F.date_sub(cutoff, weeks * 7), F.lit("proper")).otherwise(F.lit("calib"))
