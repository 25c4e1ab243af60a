"""Track runners: disease and geography level are columns, so all tracks share one plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.constants import QUANTILE_COLUMNS
from tidecast.functions import calendar as cal
from tidecast.functions import quantiles as qt
from tidecast.operators import ensemble, rollup, scores
from tidecast.operators import folds as fo
from tidecast.plans import backtest, baselines, trajectories
from tidecast.plans.hierarchical import hierarchical
from tidecast.session import staged

_SEPARATOR = "|"
Tracks = dict[tuple[str, str], DataFrame]
STATISTICAL = [baselines.naive, baselines.seasonal_naive, baselines.climatological]


def track_of(geo: str = "geo") -> Column:
    """disease and level of a stacked geo, as one text."""
    return F.substring_index(geo, _SEPARATOR, 2)


def stacked(tables: Tracks, columns: list[str]) -> DataFrame:
    """One table of all tracks; the columns named get the track before them, so that joins by them stay within a track."""
    parts = []
    for (disease, level), df in tables.items():
        keyed = {c: F.concat_ws(_SEPARATOR, F.lit(disease), F.lit(level), F.col(c)) for c in columns}
        parts.append(df.withColumns(keyed))
    return reduce(DataFrame.unionByName, parts)


def members(populations: Tracks, regions: Tracks, years: DataFrame | None = None) -> list:
    """All statistical forecasters and the season trajectories for stacked series.

    ``populations`` (geo, year, population) and ``regions`` (uf, macroregion: the region of a geo) carry the track in their
    keys like the series; medians over geos (shrinkage, dispersion) are taken within a track. ``years`` (year) has the years
    that populations cover, where ``populations`` hold the geos of the series only.
    """
    population, geo_map = stacked(populations, ["geo"]), stacked(regions, ["uf", "macroregion"])
    return [*STATISTICAL, lambda s, f: hierarchical(s, f, population, geo_map, pool=track_of(), years=years),
            lambda s, f: trajectories.mechanistic(s, f, population, pool=track_of(), years=years)]


def run_tracks(tracks: Tracks, folds: DataFrame, forecasters=None, combined: list[str] | None = None) -> DataFrame:
    """Scored forecasts of every (disease, level) series with the same forecasters, and the median ensemble of ``combined``.

    The series are stacked under a composite geo, so each forecaster is planned and run once for all
    tracks instead of once per track. They are written first, because every forecaster reads them several times.
    """
    series = stacked({k: df.select("geo", "date", "casos") for k, df in tracks.items()}, ["geo"])
    series = rollup.by_geo(staged(rollup.by_geo(series), "track-series"))
    scored = backtest.score(backtest.run(forecasters or STATISTICAL, series, folds), series, folds)
    if combined:
        scored = staged(scored, "tracks")
        scored = scored.unionByName(scores.attach_scores(ensemble.median_ensemble(scored, combined)), allowMissingColumns=True)
    key = F.split("geo", re.escape(_SEPARATOR), 3)
    return scored.withColumns({"disease": key[0], "level": key[1], "geo": key[2]})


def season_calendar(folds: DataFrame) -> DataFrame:
    """Full-season weeks of every fold, also when its window is only partly observed."""
    season = cal.season_start_year(F.col("target_start")) + 1
    days = folds.select(
        "fold_id", F.col("train_cutoff").alias("origin_date"), F.explode(cal.season_dates(season)).alias("date")
    )
    return days.withColumn("horizon_weeks", cal.horizon_weeks(F.col("date"), F.col("origin_date")))


def with_season_year(df: DataFrame, folds: DataFrame) -> DataFrame:
    season = folds.select("fold_id", (cal.season_start_year(F.col("target_start")) + 1).alias("season_year"))
    return df.join(F.broadcast(season), "fold_id")


def full_season(series: DataFrame, folds: DataFrame, forecaster=baselines.climatological) -> DataFrame:
    """Forecast of all season weeks from one model."""
    return with_season_year(forecaster(series, folds, season_calendar(folds)), folds)


def full_season_ensemble(series: DataFrame, folds: DataFrame, forecasters: list, name: str = "ensemble_vincent") -> DataFrame:
    """Median ensemble of several models for all season weeks, also those that are not yet observed; wide columns."""
    calendar = season_calendar(folds)
    stacked = reduce(DataFrame.unionByName, [f(series, folds, calendar) for f in forecasters])
    members = qt.to_wide(stacked).withColumn("observed_value", F.lit(None).cast("double"))
    return with_season_year(ensemble.median_ensemble(members, None, name), folds)


def season_tables(tracks: dict[str, tuple[DataFrame, Callable]], folds: DataFrame) -> DataFrame:
    """track, season_year, geo, date and wide quantiles: the full season of every track from the model chosen for it."""
    parts = [
        full_season(series, folds, forecaster).select(
            F.lit(track).alias("track"), "season_year", "geo", "date", *[F.col("q")[i].alias(c) for i, c in enumerate(QUANTILE_COLUMNS)])
        for track, (series, forecaster) in tracks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def observed_folds(series: DataFrame, folds: DataFrame) -> DataFrame:
    """Observed weeks per fold, which tells complete from partial folds."""
    return fo.target_window(series, folds).groupBy("fold_id").agg(F.countDistinct("date").alias("weeks"))
