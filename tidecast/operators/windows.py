"""Window functions on dense weekly series; every frame counts rows, so the grid must have no holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import AR_LAGS, CLIMATE_COLUMNS, INDEX_LAGS, INDICES
from tidecast.functions import calendar as cal


def series_window(keys: list[str]):
    return W.partitionBy(*keys).orderBy("date")


def autoregressive_lags(value: str, keys: list[str], lags: list[int] = AR_LAGS) -> dict[str, Column]:
    """lag_k is the value k-1 rows back, so lag_1 is the value at the origin itself."""
    return {f"lag_{k}": F.lag(value, k - 1).over(series_window(keys)) for k in lags}


def rolling(value: str, keys: list[str]) -> dict[str, Column]:
    w = series_window(keys)
    return {
        "roll_mean_4": F.avg(value).over(w.rowsBetween(-3, 0)),
        "roll_std_4": F.stddev_samp(value).over(w.rowsBetween(-3, 0)),
        "roll_mean_8": F.avg(value).over(w.rowsBetween(-7, 0)),
        "roll_max_12": F.max(value).over(w.rowsBetween(-11, 0)),
    }


def climate_rolling(keys: list[str], columns: list[str] = CLIMATE_COLUMNS) -> dict[str, Column]:
    """Means of the last four rows. To be taken over the whole climate table, which may begin before the cases."""
    frame = series_window(keys).rowsBetween(-3, 0)
    return {f"{c}_roll4": F.avg(c).over(frame) for c in columns}


def anomaly(value: str, keys: list[str]) -> Column:
    """Departure from the mean of the same week of the year over the whole training span."""
    return F.col(value) - F.avg(value).over(W.partitionBy(*keys, "epiweek"))


def index_lags(ocean: DataFrame) -> DataFrame:
    """National indices at several lags. One row a week: the single window partition is calendar-sized."""
    w = W.orderBy("date")
    lags = {f"{i}_lag{k}": F.lag(i, k).over(w) for i in INDICES for k in INDEX_LAGS}
    return ocean.withColumns(lags).select("date", *lags)


def interpolate(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Fill holes linearly between neighbours and with the nearest value at both ends."""
    w = W.partitionBy(*keys).orderBy(position)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    marked = df.withColumns({
        "_before": F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_after": F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)),
    })
    b, a = F.col("_before"), F.col("_after")
    between = b["v"] + (a["v"] - b["v"]) * (F.col(position) - b["p"]) / (a["p"] - b["p"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(b.isNull(), a["v"]).when(a.isNull(), b["v"])
    return marked.withColumn(value, filled.otherwise(between)).drop("_before", "_after")


def cumulative(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running total and first difference (the first row counts from zero)."""
    w = series_window(keys)
    return df.withColumns({
        "cumulative": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "difference": F.col(value) - F.lag(value, 1, 0).over(w),
    })


def trailing_sequence(features: list[str], keys: list[str], length: int, include_origin: bool) -> Column:
    """The last ``length`` feature rows as an array, or null when the history is shorter."""
    last = 0 if include_origin else -1
    frame = series_window(keys).rowsBetween(last - length + 1, last)
    rows = F.collect_list(F.struct(*features)).over(frame)
    return F.when(F.size(rows) == length, rows)


def leading_values(value: str, keys: list[str], length: int) -> Column:
    """The next ``length`` values as an array; shorter near the end of the series. Nulls keep their place."""
    return collected(value, series_window(keys).rowsBetween(1, length))


def collected(value: str, frame) -> Column:
    """The values of a frame as an array that keeps nulls, which ``collect_list`` alone drops."""
    return F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(frame), lambda s: s["v"])


def group_total(value: str, keys: list[str]) -> Column:
    return F.sum(value).over(W.partitionBy(*keys))


def with_epi_week(df: DataFrame) -> DataFrame:
    return df.withColumn("epiweek", cal.epi_week(F.col("date")))
