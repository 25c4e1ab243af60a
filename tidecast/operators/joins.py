"""As-of joins by order and carry, lookups built on them, and the date spine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.session import staged


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
          values: list[str], parts: int | None = None) -> DataFrame:
    """Latest right row at or before the left time, per ``by`` keys; missing when there is none.

    The distinct moments of the left side and the rows of the right one are put in one order by key and time and
    range-partitioned by it, so that a key with half of all rows spreads over many ranges. Within a range a moment takes
    the last row before it; a range passes its last row on to the ranges in which its last key goes on, a table of at most
    one row a range. No row meets more than one other. Of right rows with one key and time the largest values win.
    """
    moments = left.filter(F.col(left_time).isNotNull()).select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side")).distinct()
    rows = right.filter(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.struct(*values).alias("_hit"))
    both = moments.unionByName(rows, allowMissingColumns=True)
    order = [*by, "_time", "_side"]
    ranged = both.repartitionByRange(parts, *order) if parts else both.repartitionByRange(*order)
    table = staged(ranged.withColumn("_range", F.spark_partition_id()), "asof")
    # a key reaches into at most one later range as the first of it, so this has at most one row a range
    ends = table.groupBy(*by, "_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_time", "_hit")))["_hit"].alias("_end"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).filter("_carry is not null").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_range").alias("_at"), "_carry")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], F.col("_range") == F.col("_at"))
    before = W.partitionBy(*by, "_range").orderBy("_time", "_side", "_hit").rowsBetween(W.unboundedPreceding, 0)
    found = table.withColumn("_last", F.last("_hit", ignorenulls=True).over(before)).filter("_side = 1").join(F.broadcast(carried), same, "left")
    latest = found.select(*by, F.col("_time").alias(left_time), F.coalesce("_last", "_carry").alias("_hit")).select(*by, left_time, "_hit.*")
    return left.join(latest, [*by, left_time], "left")


def seasonal_anchor(origins: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Latest value at or before the origin in the same week of the year as the target.

    ``origins`` holds geo, origin_date, target_epiweek; a key has at most one candidate row per year.
    """
    history = series.select("geo", cal.epi_week(F.col("date")).alias("target_epiweek"), "date", value)
    return as_of(origins, history, ["geo", "target_epiweek"], "origin_date", "date", [value]).withColumnRenamed(
        value, "seasonal_anchor"
    )


def horizon_expansion(origins: DataFrame, max_horizon: int) -> DataFrame:
    """One row per origin and horizon with its target date, in a single pass."""
    out = origins.withColumn("horizon_weeks", F.explode(F.sequence(F.lit(1), F.lit(max_horizon))))
    return out.withColumn("target_date", cal.add_weeks(F.col("origin_date"), F.col("horizon_weeks")))


def reindex(df: DataFrame, spine: DataFrame, on: list[str]) -> DataFrame:
    """Every spine row, with missing values where ``df`` has none."""
    return spine.join(df, on, "left")


def season_spine(groups: DataFrame) -> DataFrame:
    """Every expected Sunday of each group's season (``groups`` has a season_year column)."""
    return groups.withColumn("date", F.explode(cal.season_dates(F.col("season_year"))))
