"""Fixed values shared by every module.

The numbers and names below define the output format and the scores, so they must stay as they are.
"""

# ---- fixed values: quantile levels, central intervals and their wide column names ----
QUANTILE_LEVELS = [0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975]
INTERVAL_LEVELS = [50, 80, 90, 95]
QUANTILE_COLUMNS = [
    "lower_95", "lower_90", "lower_80", "lower_50", "pred",
    "upper_50", "upper_80", "upper_90", "upper_95",
]

# ---- fixed values: panel and calendar parameters ----
INCIDENCE_SCALE = 1e5
MAX_HORIZON = 67            # 15 gap weeks + 52 season weeks
AR_LAGS = [1, 2, 3, 4, 8, 52]
INDEX_LAGS = [0, 4, 8, 12, 26, 52]
INDICES = ["enso", "iod", "pdo"]
CLIMATE_COLUMNS = ["temp_med", "precip_med", "rel_humid_med"]
SEASON_SLOTS = 53
SEASON_FIRST_WEEK = 41
SEASON_LAST_WEEK = 40
CALIBRATION_WEEKS = 78
SEQUENCE_LENGTH = 104

# ---- fixed values: geography and disease codes of the published tables ----
UF_CODES = {
    "RO": 11, "AC": 12, "AM": 13, "RR": 14, "PA": 15, "AP": 16, "TO": 17, "MA": 21, "PI": 22,
    "CE": 23, "RN": 24, "PB": 25, "PE": 26, "AL": 27, "SE": 28, "BA": 29, "MG": 31, "ES": 32,
    "RJ": 33, "SP": 35, "PR": 41, "SC": 42, "RS": 43, "MS": 50, "MT": 51, "GO": 52, "DF": 53,
}
DISEASE_CODES = {"dengue": "A90", "chikungunya": "A92.0", "zika": "A92.5"}

METRIC_COLUMNS = [
    "wis", "dispersion", "overprediction", "underprediction", "ae_median",
    "coverage_50", "coverage_80", "coverage_90", "coverage_95",
]
