"""Season trajectories: bootstrap forecasts from whole past seasons and growth-curve fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import INCIDENCE_SCALE, QUANTILE_LEVELS, SEASON_SLOTS
from tidecast.functions import calendar as cal
from tidecast.functions import counts
from tidecast.operators import bootstrap as bs
from tidecast.operators import folds as fo
from tidecast.operators import order_stats as os_
from tidecast.operators import rollup
from tidecast.operators.windows import interpolate
from tidecast.plans.baselines import KEYS

NEAR_COMPLETE = SEASON_SLOTS * 0.9
# ---- fixed values: growth-curve search grid ----
GROWTH_RATES = [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5]
PEAK_SHIFTS = list(range(-8, 9))
SHAPES = [0.1, 0.5, 1.0, 2.0, 5.0]


def tag_season(df: DataFrame) -> DataFrame:
    d = F.col("date")
    return df.withColumns({"season": cal.season_start_year(d), "season_week": cal.season_week(d)})


def past_seasons(series: DataFrame, folds: DataFrame) -> DataFrame:
    """Training rows of the seasons before each fold's target season."""
    cut = tag_season(fo.training(series, folds))
    first = folds.select("fold_id", cal.season_start_year(F.col("target_start")).alias("_target"))
    return cut.join(F.broadcast(first), "fold_id").filter(F.col("season") < F.col("_target")).drop("_target")


def complete_seasons(series: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id, geo, season, weeks of the near-complete past seasons."""
    weeks = past_seasons(series, folds).groupBy(*KEYS, "season").agg(F.countDistinct("season_week").alias("weeks"))
    return weeks.filter(F.col("weeks") >= NEAR_COMPLETE)


def dispersion(series: DataFrame, folds: DataFrame, default: float = 0.1, pool: Column | None = None) -> DataFrame:
    """fold_id, pool, dispersion: median of (variance - mean) / mean^2 over the (geo, season week) cells of a pool of geos."""
    pool = F.lit("") if pool is None else pool
    cells = tag_season(fo.training(series, folds)).groupBy(*KEYS, "season_week").agg(
        F.avg("casos").alias("m"), F.var_samp("casos").alias("v")
    ).withColumn("pool", pool)
    wide = cells.filter((F.col("m") > 5) & F.col("v").isNotNull())
    over = F.least(F.greatest((F.col("v") - F.col("m")) / (F.col("m") * F.col("m")), F.lit(1e-3)), F.lit(10.0))
    medians = os_.exact_quantiles(wide.select("fold_id", "pool", over.alias("dispersion")), ["fold_id", "pool"], "dispersion", [0.5])
    pools = folds.select("fold_id").join(F.broadcast(series.select(pool.alias("pool")).distinct()))
    return pools.join(medians, ["fold_id", "pool"], "left").select(
        "fold_id", "pool", F.coalesce("dispersion", F.lit(default)).alias("dispersion")
    )


def curves(series: DataFrame, folds: DataFrame, value: str = "incidence") -> DataFrame:
    """fold_id, geo, season, season_no, n_seasons, slot, value: gap-free trajectories of 53 slots."""
    entry = F.struct("season_week", value)
    seasons = past_seasons(series, folds).groupBy(*KEYS, "season").agg(
        F.count("*").alias("weeks"), F.map_from_entries(F.collect_list(entry)).alias("_curve")
    ).filter(F.col("weeks") >= NEAR_COMPLETE)
    w = W.partitionBy(*KEYS)
    numbered = seasons.withColumns({
        "season_no": F.row_number().over(w.orderBy("season")).cast("bigint") - 1,
        "n_seasons": F.count("*").over(w),
    })
    slots = numbered.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(SEASON_SLOTS))))
    rows = slots.select(*KEYS, "season", "season_no", "n_seasons", "slot", F.col("_curve")[F.col("slot")].alias(value))
    return interpolate(rows, [*KEYS, "season"], "slot", value)


def season_draws(trajectories: DataFrame, draws: int = 800, seed: int = 0) -> DataFrame:
    """fold_id, geo, season_no, times: how often each past season is drawn, the same for all its weeks."""
    geos = trajectories.select(*KEYS, "n_seasons").distinct()
    geo_seed = F.conv(F.substring(F.md5("geo"), 1, 15), 16, 10).cast("bigint") % bs.PRIME
    reps = geos.withColumns({
        "rep": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))), "geo_seed": geo_seed,
    })
    drawn = bs.draw_index(reps, F.col("rep"), F.col("geo_seed"), F.col("n_seasons"), seed, "season_no")
    return drawn.groupBy(*KEYS, "season_no").agg(F.count("*").alias("times"))


def drawn_levels(series: DataFrame, folds: DataFrame, population: DataFrame, calendar: DataFrame | None = None,
                 draws: int = 800, seed: int = 0, years: DataFrame | None = None) -> DataFrame:
    """One row per (fold, geo, target week, drawn season): expected count ``mu`` and its multiplicity.

    A season drawn k times is one row with weight k, so a geo has as many rows as past seasons, not draws.
    """
    calendar = fo.fold_calendar(folds) if calendar is None else calendar
    trajectories = curves(rollup.add_incidence(series, population, years), folds)
    weeks = calendar.withColumn("slot", cal.season_week(F.col("date")))
    drawn = trajectories.join(season_draws(trajectories, draws, seed), [*KEYS, "season_no"])
    grid = rollup.attach_population(drawn.join(F.broadcast(weeks), ["fold_id", "slot"]), population, years=years)
    # a year without a population takes the geo's last one
    latest = population.groupBy("geo").agg(F.max_by("population", "year").alias("_latest"))
    grid = grid.join(latest, "geo", "left").withColumn("population", F.coalesce("population", "_latest"))
    mu = F.when(F.col("population").isNotNull(), F.greatest(F.col("incidence") * F.col("population") / INCIDENCE_SCALE, F.lit(1e-6)))
    return grid.select(*KEYS, "date", "origin_date", "horizon_weeks", "season_no", "times", mu.alias("mu"))


_UNIT = [*KEYS, "date", "origin_date", "horizon_weeks"]


def resampled(levels: DataFrame) -> DataFrame:
    """Quantiles of the drawn levels themselves, by weighted percentile."""
    q = levels.groupBy(*_UNIT).agg(F.percentile("mu", QUANTILE_LEVELS, F.col("times")).alias("q"))
    return q.select(F.lit("trajectory_resample").alias("model"), *_UNIT, "q")


def noisy_quantiles(mu: list, times: list, dispersions: np.ndarray, keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """Quantiles of negative binomial draws, ``times`` draws around each level ``mu`` of a unit: one flat draw for all units.

    The k-th draw of a unit depends on the unit's key and k alone.
    """
    width = np.array([len(m) for m in mu])
    times = np.concatenate([np.asarray(t, dtype=int) for t in times])
    unit = np.repeat(np.arange(len(mu)), width)
    sizes = np.bincount(unit, times, len(mu)).astype(int)
    mean = np.repeat(np.concatenate([np.asarray(m, dtype=float) for m in mu]), times)
    owner = np.repeat(np.arange(len(mu)), sizes)
    place = np.arange(len(mean)) - (np.cumsum(sizes) - sizes)[owner]
    key = keys.astype(np.uint64) + np.array([seed], np.uint64) * np.uint64(0xD1342543DE82EF95)
    drawn = counts.negative_binomial(mean, np.asarray(dispersions, dtype=float)[owner], key[owner], place.astype(np.uint64))
    return counts.segment_quantiles(drawn, sizes, QUANTILE_LEVELS)


def _noisy_quantiles(seed: int):
    def draw(mu: pd.Series, times: pd.Series, alpha: pd.Series, key: pd.Series) -> pd.Series:
        if not len(mu):
            return pd.Series([], dtype=object)
        return pd.Series(list(noisy_quantiles(list(mu), list(times), alpha.to_numpy(), key.to_numpy(), seed)))

    return F.pandas_udf(draw, "array<double>")


def with_count_noise(levels: DataFrame, dispersions: DataFrame, seed: int = 0, pool: Column | None = None) -> DataFrame:
    """Quantiles after negative binomial observation noise; each unit has its own key.

    Sampling is the one step Spark has no function for: a vectorised UDF that draws for a whole Arrow batch at once.
    """
    entry = F.struct("season_no", "mu", "times")
    units = levels.groupBy(*_UNIT).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    pooled = units.withColumn("pool", F.lit("") if pool is None else pool)
    keyed = pooled.join(dispersions, ["fold_id", "pool"]).withColumn(
        "_key", F.conv(F.substring(F.md5(F.concat_ws("|", *KEYS, "date")), 1, 15), 16, 10).cast("bigint")
    )
    q = _noisy_quantiles(seed)(F.col("_s.mu"), F.col("_s.times"), F.col("dispersion"), F.col("_key"))
    return keyed.select(F.lit("mechanistic_traj").alias("model"), *_UNIT, q.alias("q"))


def mechanistic(series: DataFrame, folds: DataFrame, population: DataFrame, calendar: DataFrame | None = None,
                draws: int = 800, seed: int = 0, pool: Column | None = None, years: DataFrame | None = None) -> DataFrame:
    levels = drawn_levels(series, folds, population, calendar, draws, seed, years)
    return with_count_noise(levels, dispersion(series, folds, pool=pool), seed, pool)


def fit_growth(curve_rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Best growth curve per season by grid search; the size is solved in closed form at each grid point.

    Each season is one row with its cumulative curve, and the grid lives in that row as arrays, so the
    search needs no join and no shuffle beyond collecting the season.
    """
    w = W.partitionBy(*keys).orderBy("slot")
    rows = curve_rows.withColumn("_y", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double"))
    packed = rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "_y"))), lambda x: x["_y"]).alias("y"),
        F.max_by("slot", F.struct(F.col(value), -F.col("slot"))).alias("obs_peak_week"),
    ).withColumn("total", F.element_at("y", -1)).filter(F.col("total") > 0)
    steps = F.sequence(F.lit(1), F.size("y"))

    def literal(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])

    def point(r: Column, tp: Column, a: Column) -> Column:
        shape = F.transform(steps, lambda t: F.pow(1 + a * F.exp(-r * (t - tp)), -1 / a))
        zero = F.struct(F.lit(0.0).alias("yg"), F.lit(0.0).alias("gg"), F.lit(0.0).alias("yy"))
        pairs = F.arrays_zip(F.col("y").alias("y"), shape.alias("g"))
        sums = F.aggregate(pairs, zero, lambda s, x: F.struct(
            (s["yg"] + x["y"] * x["g"]).alias("yg"), (s["gg"] + x["g"] * x["g"]).alias("gg"),
            (s["yy"] + x["y"] * x["y"]).alias("yy")))
        return F.transform(F.array(sums), lambda s: _solve(s, r, tp, a))[0]

    def _solve(s: Column, r: Column, tp: Column, a: Column) -> Column:
        best = F.coalesce(F.try_divide(s["yg"], s["gg"]), F.col("total"))
        k = F.least(F.greatest(best, 0.5 * F.col("total")), 5 * F.col("total"))
        sse = s["yy"] - 2 * k * s["yg"] + k * k * s["gg"]
        # relative to the total, so that the choice doesn't depend on the scale of the curve
        relative = F.round(sse / (F.col("total") * F.col("total")), 10)
        return F.struct(relative.alias("relative_sse"), r.alias("growth_rate"), tp.alias("peak_week"),
                        a.alias("shape_alpha"), k.alias("final_size"))

    grid = F.flatten(F.transform(literal(GROWTH_RATES), lambda r: F.flatten(F.transform(
        literal(PEAK_SHIFTS), lambda d: F.transform(
            literal(SHAPES), lambda a: point(r, F.greatest(F.col("obs_peak_week") + d, F.lit(1)), a))))))
    return packed.withColumn("fit", F.array_min(grid)).select(*keys, "obs_peak_week", "total", "fit.*")


def season_fits(series: DataFrame) -> DataFrame:
    """Growth-curve fits of every near-complete season of the dense series."""
    tagged = tag_season(series)
    size = F.count("*").over(W.partitionBy("geo", "season"))
    rows = tagged.withColumn("_n", size).filter(F.col("_n") >= NEAR_COMPLETE)
    return fit_growth(rows.withColumn("slot", F.col("season_week")), ["geo", "season"], "casos")
