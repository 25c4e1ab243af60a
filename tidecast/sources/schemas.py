"""Explicit schemas of the raw tables; nothing is inferred from file headers."""

from __future__ import annotations

FLAGS = ", ".join([f"train_{i} BOOLEAN, target_{i} BOOLEAN" for i in range(1, 5)])

CASES = f"geocode BIGINT, date DATE, casos BIGINT, uf STRING, {FLAGS}, target_city BOOLEAN"
CLIMATE = "geocode BIGINT, date DATE, epiweek INT, temp_med DOUBLE, precip_med DOUBLE, rel_humid_med DOUBLE"
SEASONAL_FORECAST = (
    "geocode BIGINT, reference_month STRING, forecast_months_ahead INT, "
    "temp_med DOUBLE, umid_med DOUBLE, precip_tot DOUBLE"
)
OCEAN = "date DATE, enso DOUBLE, iod DOUBLE, pdo DOUBLE"
ENVIRONMENT = "geocode BIGINT, koppen STRING, biome STRING"
POPULATION = "geocode BIGINT, year INT, population BIGINT"
ACCESS = "geocode BIGINT, access_date DATE, accessed_disease STRING, access_count BIGINT"
GEO_MAP = "geocode BIGINT, uf STRING, macroregion STRING"
SCORED = (
    "model STRING, fold_id STRING, geo STRING, date STRING, "
    "observed_value STRING, wis STRING, pred STRING"
)
