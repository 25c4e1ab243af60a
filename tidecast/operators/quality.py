"""Data-quality checks. Each returns a table of violations or counts, computed as part of one plan."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.constants import QUANTILE_COLUMNS
from tidecast.functions import calendar as cal


def leakage(train: DataFrame, date: str = "date") -> DataFrame:
    """Per fold, the last date and the rows after the cut-off (``train`` carries train_cutoff)."""
    late = F.sum((F.col(date) > F.col("train_cutoff")).cast("bigint"))
    return train.groupBy("fold_id").agg(F.max(date).alias("last_date"), late.alias("rows_after_cutoff"))


def require_no_leakage(leaks: DataFrame) -> DataFrame:
    """The leakage table, but the query fails when a fold has any row after its cut-off.

    The check sits on the aggregated rows: on single rows the optimiser could evaluate it before the
    cut-off filter that makes it true.
    """
    fail = F.raise_error(F.concat(F.lit("rows after the cut-off of fold "), F.col("fold_id").cast("string")))
    late = F.col("rows_after_cutoff")
    return leaks.withColumn("rows_after_cutoff", F.when(late > 0, fail.cast("bigint")).otherwise(late))


def gap_rows(df: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Per fold, rows strictly between cut-off and target start (folds without any keep a zero)."""
    bounds = folds.select("fold_id", "train_cutoff", "target_start")
    keyed = df if "fold_id" in df.columns else df.join(F.broadcast(folds.select("fold_id")))
    inside = (F.col(date) > F.col("train_cutoff")) & (F.col(date) < F.col("target_start"))
    joined = keyed.select("fold_id", date).join(F.broadcast(bounds), "fold_id")
    return joined.groupBy("fold_id").agg(F.sum(inside.cast("bigint")).alias("gap_rows"))


def require_history(history: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id of every fold with a history; fails on rows after the cut-off or in the weeks before the target."""
    leaks = require_no_leakage(leakage(history))
    gaps = gap_rows(history, folds)
    fail = F.raise_error(F.concat(F.lit("rows in the gap of fold "), F.col("fold_id").cast("string")))
    checked = leaks.join(gaps, "fold_id").select(
        "fold_id", "rows_after_cutoff", F.when(F.col("gap_rows") > 0, fail.cast("bigint")).otherwise(F.col("gap_rows")).alias("gap_rows"))
    # the counts are used, so that the optimiser can't drop the checks with them
    return checked.filter(F.col("rows_after_cutoff") + F.col("gap_rows") == 0).select("fold_id")


def not_sunday(date: str = "date") -> Column:
    return F.sum((~cal.is_sunday(F.col(date))).cast("bigint"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def negative_rows(value: str) -> Column:
    return F.sum((F.col(value) < 0).cast("bigint"))


def grid_completeness(df: DataFrame, geo: str, date: str) -> DataFrame:
    """Rows against weeks x geos, and weeks per geo (minimum, median, maximum).

    Pairs are collapsed once; the median over geos works on counts of counts, which the calendar bounds.
    """
    per_geo = df.groupBy(geo).agg(F.countDistinct(date).alias("weeks"), F.count("*").alias("rows"))
    histogram = per_geo.groupBy("weeks").agg(F.count("*").alias("geos"), F.sum("rows").alias("rows"))
    spread = histogram.agg(
        F.sum("rows").alias("rows"), F.sum("geos").alias("geos"), F.min("weeks").alias("min_weeks"),
        F.percentile("weeks", 0.5, F.col("geos")).alias("median_weeks"), F.max("weeks").alias("max_weeks"),
    )
    weeks = df.groupBy(date).agg(F.lit(1)).agg(F.count("*").alias("weeks"))
    return spread.join(F.broadcast(weeks)).withColumn("complete", F.col("rows") / (F.col("weeks") * F.col("geos")))


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls for the columns that have any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.inline(rows)).filter("nulls > 0")


def counters(df: DataFrame, geo: str, uf: str, date: str) -> DataFrame:
    """Rows, distinct geos and states, first and last date; the distinct counts run on one row per geo."""
    per_geo = df.groupBy(geo, uf).agg(F.count("*").alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    return per_geo.agg(
        F.sum("n").alias("rows"), F.countDistinct(geo).alias("geos"), F.countDistinct(uf).alias("ufs"),
        F.min("lo").alias("first_date"), F.max("hi").alias("last_date"),
    )


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys only on the left and only on the right, as counts."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("extra")
    )


def audit(tables: dict[str, tuple[DataFrame, str, str]], base: str, key: str = "geocode") -> DataFrame:
    """(table, check, value) rows for several tables, each given as (rows, date column, value column).

    Every table is read once: its checks are counted per key, the per-key counts are joined, and one
    aggregation over the keys gives the totals and the keys of ``base`` that a table lacks.
    """
    checks = ["rows", "not_sunday", "negative", "nulls"]
    joined = None
    for name, (df, day, value) in tables.items():
        per_key = df.groupBy(key).agg(
            F.count("*").alias(f"{name}.rows"), not_sunday(day).alias(f"{name}.not_sunday"),
            negative_rows(value).alias(f"{name}.negative"), F.count_if(F.col(value).isNull()).alias(f"{name}.nulls"),
        )
        joined = per_key if joined is None else joined.join(per_key, key, "full")
    totals, labels = [], []
    for name in tables:
        here = F.col(f"`{name}.rows`")
        for check in checks:
            totals.append(F.coalesce(F.sum(f"`{name}.{check}`"), F.lit(0)).alias(f"{name}.{check}"))
            labels.append((name, check))
        totals.append(F.count(here).alias(f"{name}.geos"))
        labels.append((name, "geos"))
        if name != base:
            lacking = F.col(f"`{base}.rows`").isNotNull() & here.isNull()
            totals.append(F.count_if(lacking).alias(f"{name}.missing_geos"))
            labels.append((name, "missing_geos"))
    rows = F.array(*[
        F.struct(F.lit(t).alias("table"), F.lit(c).alias("check"), F.col(f"`{t}.{c}`").alias("value")) for t, c in labels
    ])
    return joined.agg(*totals).select(F.inline(rows))


def table_verdicts(tables: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict per output table (``keys`` includes season_year): valid, or the first failed check.

    All checks are conditional counts of a single aggregation over the table's rows.
    """
    season = cal.season_dates(F.col("season_year"))
    first, last = F.element_at(season, 1), F.element_at(season, -1)
    expected = F.size(season)
    in_season = F.col("date").between(first, last) & cal.is_sunday(F.col("date"))
    bad_value = [
        (F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))).cast("bigint")
        for c in QUANTILE_COLUMNS
    ]
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in QUANTILE_COLUMNS])
    crossed = reduce(
        lambda a, b: a | b,
        [F.col(hi) - F.col(lo) < -1e-6 for lo, hi in zip(QUANTILE_COLUMNS, QUANTILE_COLUMNS[1:])],
    )
    counts = tables.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.countDistinct("date").alias("dates"),
        F.count_if(~in_season).alias("outside"), F.max(expected).alias("expected"),
        F.sum(reduce(add, bad_value)).alias("bad"), F.count_if(negative).alias("negative"),
        F.count_if(crossed).alias("crossed"),
    )
    wrong_dates = (
        (F.col("rows") != F.col("expected")) | (F.col("dates") != F.col("expected")) | (F.col("outside") > 0)
    )
    reason = (
        F.when(wrong_dates, F.lit("dates")).when(F.col("bad") > 0, F.lit("non-finite"))
        .when(F.col("negative") > 0, F.lit("negative")).when(F.col("crossed") > 0, F.lit("nesting"))
    )
    return counts.select(*keys, "rows", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def missing_columns(df: DataFrame) -> list[str]:
    """Required columns the table lacks; known from the schema, before any job runs."""
    return [c for c in ["date", *QUANTILE_COLUMNS] if c not in df.columns]
