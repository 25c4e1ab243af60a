"""Small value transforms: incidence, harmonics, growth curve, negative binomial and key cleaning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.constants import DISEASE_CODES, INCIDENCE_SCALE, UF_CODES


def incidence(casos: Column, population: Column) -> Column:
    return F.try_divide(casos.cast("double"), population.cast("double")) * INCIDENCE_SCALE


def log_incidence(casos: Column, population: Column) -> Column:
    return F.log1p(incidence(casos, population))


def counts_from_log(log_inc: Column, population: Column) -> Column:
    """Back from log1p incidence to counts, cut at zero; a missing input stays missing."""
    counts = F.expm1(log_inc) * population / INCIDENCE_SCALE
    return F.when(counts.isNotNull(), F.greatest(counts, F.lit(0.0)))


def harmonics(week: Column) -> dict[str, Column]:
    """Two annual harmonics with a fixed period of 52, also in week 53."""
    angle = week * (2 * math.pi / 52)
    return {"sin1": F.sin(angle), "cos1": F.cos(angle), "sin2": F.sin(2 * angle), "cos2": F.cos(2 * angle)}


def growth_curve(t: Column, k: Column, r: Column, tp: Column, alpha: Column) -> Column:
    """Richards curve: cumulative size at time ``t``."""
    return k / F.pow(1 + alpha * F.exp(-r * (t - tp)), 1 / alpha)


def negative_binomial(mu: Column, dispersion: Column) -> dict[str, Column]:
    size = 1 / dispersion
    return {"r": size, "p": size / (size + mu)}


def clean_category(name: Column) -> Column:
    return F.translate(name, " â", "_a")


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def uf_code(uf: Column) -> Column:
    """Two-digit state code; an unknown state has none."""
    return _lookup(UF_CODES, uf)


def disease_code(disease: Column) -> Column:
    return _lookup(DISEASE_CODES, disease)


def city_state_code(geocode: Column) -> Column:
    """State code of a city: the first two digits of its geocode."""
    return F.substring(geocode.cast("string"), 1, 2)
