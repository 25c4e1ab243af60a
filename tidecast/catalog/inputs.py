"""Inputs the registered queries share, each a lazy plan over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.constants import CLIMATE_COLUMNS, QUANTILE_COLUMNS
from tidecast.operators import ensemble as en
from tidecast.operators import rollup
from tidecast.operators import scores as so
from tidecast.plans import backtest, baselines, panel, tracks
from tidecast.plans.hierarchical import hierarchical
from tidecast.session import handoff, staged
from tidecast.sources import star

MEMBERS = ["climatological_quantile", "seasonal_naive", "hierarchical_climatological"]
ENSEMBLES = ["ensemble_vincent", "ensemble_invwis", "ensemble_conformal"]


SEASONAL_VALUES = ["temp_med", "umid_med", "precip_tot"]


def shared(spark: SparkSession, sf_dir: str, name: str, build, partition_by: list[str] | None = None, bucket_by: str | None = None) -> DataFrame:
    """A stage that queries share, written once for the present content of the input folder."""
    return handoff(spark, f"{name}:{sf_dir}", build, partition_by, sf_dir, bucket_by)


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    rounded = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return rounded.alias(name or c)


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every DOUBLE column rounded."""
    return df.select(*[r6(name, digits=digits) if kind == "double" else F.col(name) for name, kind in df.dtypes])


def rounded_quantiles(df: DataFrame, column: str = "q") -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, *[r6(F.col(column)[i], c) for i, c in enumerate(QUANTILE_COLUMNS)])


def state_cases(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    return rollup.sum_to_state(star.cases(spark, sf_dir, disease), star.EXCLUDED)


def state_series_raw(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """Dense weekly state series straight from the raw facts."""
    return rollup.densify(state_cases(spark, sf_dir, disease))


def state_series(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """The same series as a written table, bucketed by geo: the raw facts are scanned and moved once, however often it is used."""
    return shared(spark, sf_dir, f"series:{disease}", lambda: state_series_raw(spark, sf_dir, disease), bucket_by="geo")


def city_series(spark: SparkSession, sf_dir: str, disease: str = "dengue") -> DataFrame:
    """Dense series of the target cities under the generic geo column."""
    cities = star.weekly_counts(spark, sf_dir, disease).join(star.target_cities(spark, sf_dir, disease), "geocode", "left_semi")
    return rollup.densify(cities.select(F.col("geocode").cast("string").alias("geo"), "date", "casos"))


def city_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population of every geocode as a written table: the raw facts are scanned and counted once, however often it is used."""
    return shared(spark, sf_dir, "city_population", lambda: star.population(spark, sf_dir))


def state_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "population", lambda: rollup.state_population(
        city_population(spark, sf_dir), star.geo_map(spark, sf_dir)))


def state_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "climate", lambda: rollup.weighted_mean(
        star.climate(spark, sf_dir), city_population(spark, sf_dir), star.geo_map(spark, sf_dir),
        ["uf", "date"], CLIMATE_COLUMNS, star.EXCLUDED,
    ).withColumnRenamed("uf", "geo"))


# ---- stages handed over as written tables ----

def members_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored forecasts of the four statistical members, written once per application."""

    def build() -> DataFrame:
        folds = star.folds(spark)
        series = state_series(spark, sf_dir)
        population = state_population(spark, sf_dir)
        geo_map = star.geo_map(spark, sf_dir)
        forecasters = [
            baselines.naive, baselines.seasonal_naive, baselines.climatological,
            lambda s, f: hierarchical(s, f, population, geo_map),
        ]
        return backtest.score(backtest.run(forecasters, series, folds), series, folds)

    return shared(spark, sf_dir, "members", build, ["fold_id"])


def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, weighted and recalibrated ensemble, stacked (not yet scored)."""
    scored = members_scored(spark, sf_dir)
    # written, because calibration reads it several times before it is widened
    vincent = shared(spark, sf_dir, "vincent", lambda: en.median_ensemble(scored, MEMBERS), ["fold_id"])
    weighted = en.weighted_ensemble(scored, en.inverse_score_weights(scored, MEMBERS))
    return vincent.unionByName(weighted).unionByName(en.conformal_ensemble(vincent))


def all_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and ensembles, scored, written once per application."""

    def build() -> DataFrame:
        members = members_scored(spark, sf_dir)
        combined = so.attach_scores(ensembles(spark, sf_dir))
        return members.unionByName(combined, allowMissingColumns=True)

    return shared(spark, sf_dir, "scored", build, ["fold_id"])


def static_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population shares of the climate classes and biomes per state."""
    weights = rollup.fixed_year_weight(city_population(spark, sf_dir), 2000)
    return rollup.category_shares(star.environment(spark, sf_dir), weights, star.geo_map(spark, sf_dir),
                                  {"koppen": star.KOPPEN, "biome": star.BIOMES})


def state_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted seasonal forecast per state, issue month and months ahead, as a written table: both panels look it up."""
    return shared(spark, sf_dir, "seasonal", lambda: rollup.weighted_seasonal(
        star.seasonal_forecast(spark, sf_dir), star.customer_weight(spark, sf_dir),
        star.customer_map(spark, sf_dir), SEASONAL_VALUES))


def tracks_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored forecasts of all members and their ensemble for both diseases on state and city level, written once."""

    def build() -> DataFrame:
        city = F.col("geocode").cast("string")
        series = {("dengue", "state"): state_series(spark, sf_dir), ("dengue", "city"): city_series(spark, sf_dir),
                  ("chikungunya", "state"): state_series(spark, sf_dir, "chikungunya"),
                  ("chikungunya", "city"): city_series(spark, sf_dir, "chikungunya")}
        population, region = {}, {}
        for disease in star.DISEASES:
            population[disease, "state"] = state_population(spark, sf_dir)
            region[disease, "state"] = star.geo_map(spark, sf_dir).select("uf", "macroregion").distinct()
            targets = star.target_cities(spark, sf_dir, disease)
            population[disease, "city"] = city_population(spark, sf_dir).join(targets, "geocode", "left_semi").select(city.alias("geo"), "year", "population")
            region[disease, "city"] = star.geo_map(spark, sf_dir).join(targets, "geocode", "left_semi").select(city.alias("uf"), "macroregion")
        # the tracks' own geos only, and written: members meet them many times
        population = {k: staged(df, "track-population") for k, df in population.items()}
        region = {k: staged(df, "track-region") for k, df in region.items()}
        years = city_population(spark, sf_dir).select("year")
        return tracks.run_tracks(series, star.folds(spark), tracks.members(population, region, years), MEMBERS)

    return shared(spark, sf_dir, "tracks", build, ["disease", "level"])


MIN_ORIGIN = "1996-01-07"


def panel_inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """Arguments of the panel builders after (series, folds)."""
    return (
        state_population(spark, sf_dir), state_climate(spark, sf_dir), star.ocean(spark, sf_dir),
        state_seasonal(spark, sf_dir), static_shares(spark, sf_dir),
    )


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of all folds, written once: model fits pass over it many times."""
    return shared(spark, sf_dir, "panel", lambda: panel.build(
        state_series(spark, sf_dir), star.folds(spark), *panel_inputs(spark, sf_dir), MIN_ORIGIN), ["fold_id"])


PANEL_STATIC = [f"koppen_frac_{k}" for k in star.KOPPEN] + [f"biome_frac_{b.replace(' ', '_')}" for b in star.BIOMES]
