"""Epidemiological calendar as Column expressions (weeks start on Sunday, week 1 holds 4 January)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.constants import SEASON_FIRST_WEEK, SEASON_LAST_WEEK


def week_start(d: Column) -> Column:
    """Sunday on or before ``d``."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def _midweek(d: Column) -> Column:
    # The Wednesday decides the year a week belongs to, so year and week follow from it alone.
    return F.date_add(d, 4 - F.dayofweek(d))


def epi_year(d: Column) -> Column:
    return F.year(_midweek(d))


def epi_week(d: Column) -> Column:
    return F.floor((F.dayofyear(_midweek(d)) + 6) / 7).cast("int")


def epi_week_start(year: Column, week) -> Column:
    """Sunday that opens epidemiological week ``week`` of ``year``."""
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(week_start(jan4), ((F.lit(week) if isinstance(week, int) else week) - 1) * 7)


def season_start_year(d: Column) -> Column:
    """Year whose week 41 opened the season that ``d`` lies in."""
    return F.when(epi_week(d) >= SEASON_FIRST_WEEK, epi_year(d)).otherwise(epi_year(d) - 1)


def season_week(d: Column) -> Column:
    """Weeks since week 41 plus one; stays injective in 53-week years."""
    opened = epi_week_start(season_start_year(d), SEASON_FIRST_WEEK)
    return (F.floor(F.datediff(d, opened) / 7) + 1).cast("int")


def season_dates(season_year: Column) -> Column:
    """All Sundays of a season, week 41 of the previous year to week 40 of ``season_year``."""
    return F.sequence(
        epi_week_start(season_year - 1, SEASON_FIRST_WEEK),
        epi_week_start(season_year, SEASON_LAST_WEEK),
        F.expr("interval 7 days"),
    )


def horizon_weeks(d: Column, cutoff: Column) -> Column:
    return F.floor(F.datediff(d, cutoff) / 7).cast("int")


def add_weeks(d: Column, weeks: Column) -> Column:
    return F.date_add(d, weeks * 7)


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def clamp_year(year: Column, lowest: Column, highest: Column) -> Column:
    return F.least(F.greatest(year, lowest), highest)


def is_sunday(d: Column) -> Column:
    return F.dayofweek(d) == 1


def resample_sunday(d: Column) -> Column:
    """Label of a Monday-to-Sunday bucket: the Sunday that closes it (not the epidemiological label)."""
    return F.next_day(F.date_sub(d, 1), "SUN")
