"""Exploratory aggregates: climatology bands, peaks, correlations and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.operators import order_stats as os_
from tidecast.session import staged


def national(series: DataFrame) -> DataFrame:
    return series.groupBy("date").agg(F.sum("casos").alias("casos"))


def climatology_band(national_series: DataFrame) -> DataFrame:
    """Median and quartiles per ISO week; week 53 is left out."""
    week = F.weekofyear("date")
    banded = national_series.withColumn("week", week).filter(F.col("week") <= 52).groupBy("week").agg(
        F.percentile("casos", [0.25, 0.5, 0.75]).alias("b")
    )
    return banded.select("week", F.col("b")[1].alias("median"), F.col("b")[0].alias("q25"), F.col("b")[2].alias("q75"))


def yearly_peaks(series: DataFrame) -> DataFrame:
    """The peak week of each geo and year; the earliest wins a tie. One aggregation, no sort."""
    best = F.max_by(F.struct("date", "casos"), F.struct(F.col("casos"), -F.unix_date("date")))
    peaks = series.groupBy("geo", F.year("date").alias("year")).agg(best.alias("p"))
    return peaks.select("geo", "year", F.col("p.date").alias("date"), F.col("p.casos").alias("casos"),
                        F.weekofyear(F.col("p.date")).alias("week"))


def lagged_pairs(df: DataFrame, a: str, b: str, lags: range) -> DataFrame:
    """lag, a[t], b[t-lag] for every lag; rows are numbered so that lags count rows.

    The input is a national weekly series: the numbering window is calendar-sized.
    """
    numbered = df.withColumn("_rn", F.row_number().over(W.orderBy("date")))
    left = numbered.select(F.col(a).alias("_a"), F.col("_rn")).withColumn(
        "lag", F.explode(F.array(*[F.lit(k) for k in lags]))
    ).withColumn("_at", F.col("_rn") - F.col("lag"))
    right = numbered.select(F.col(b).alias("_b"), F.col("_rn").alias("_at"))
    return left.join(right, "_at")


def lagged_correlation(df: DataFrame, a: str, b: str, lags: range = range(-20, 21)) -> DataFrame:
    """Correlation of a[t] with b[t-lag]; a positive lag means b leads."""
    return lagged_pairs(df, a, b, lags).groupBy("lag").agg(F.corr("_a", "_b").alias("r"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """Best non-negative lag by absolute value."""
    strongest = F.max_by("lag", F.struct(F.round(F.abs("r"), 9), -F.col("lag")))
    return correlations.filter("lag >= 0").agg(strongest.alias("best_lag"))


def weekly_resample(daily: DataFrame, day: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily counts summed Monday to Sunday, labelled by the Sunday."""
    return daily.groupBy(*keys, cal.resample_sunday(F.col(day)).alias("date")).agg(F.sum(value).alias(value))


def log_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of log1p totals over the pairs where both are positive."""
    both = df.filter((F.col(a) > 0) & (F.col(b) > 0))
    return both.agg(F.corr(F.log1p(a), F.log1p(b)).alias("r"), F.count("*").alias("n"))


def incidence_by_category(cases: DataFrame, weights: DataFrame, environment: DataFrame, category: str) -> DataFrame:
    """Municipality-year incidence per category, capped at the overall 99th percentile.

    Both the cap and the medians range over all municipalities, so they use the distributed selection, both in one pass
    over the rates, which are built once.
    """
    yearly = cases.groupBy("geocode", F.year("date").alias("year")).agg(F.sum("casos").alias("casos"))
    rate = yearly.join(weights, "geocode").join(environment.select("geocode", category), "geocode", "left").select(
        category, (F.try_divide("casos", "population") * 1e5).alias("incidence")
    )
    sets = [os_.QuantileSet([category], [0.5]), os_.QuantileSet([], [0.99])]
    rate = staged(rate, "rates")
    middle, highest = os_.exact_quantile_sets(rate, "incidence", sets)
    medians = middle.select(F.col(category).alias("_category"), F.col("incidence").alias("median_incidence"))
    cap = highest.select(F.col("incidence").alias("cap"))
    capped = rate.join(F.broadcast(cap)).groupBy(category).agg(
        F.avg(F.least("incidence", "cap")).alias("mean_capped"), F.count("*").alias("municipality_years")
    )
    return capped.join(medians, capped[category].eqNullSafe(medians["_category"])).drop("_category")


def season_curve(series: DataFrame) -> DataFrame:
    """Final size and observed peak week per geo and season."""
    tagged = series.withColumns({
        "season": cal.season_start_year(F.col("date")), "season_week": cal.season_week(F.col("date")),
    })
    peak = F.max_by("season_week", F.struct(F.col("casos"), -F.col("season_week")))
    return tagged.groupBy("geo", "season").agg(F.sum("casos").alias("final_size"), peak.alias("peak_week"))


def top_groups(series: DataFrame, k: int) -> DataFrame:
    """The k geos with the largest totals."""
    totals = series.groupBy("geo").agg(F.sum("casos").alias("total"))
    return totals.orderBy(F.desc("total"), "geo").limit(k)


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
