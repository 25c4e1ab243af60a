"""Shared SQL: calendar fragments and the views that mirror ``sources.star`` and the forecasters."""

from __future__ import annotations

import re

from tidecast.catalog.registry import CTES
from tidecast.constants import INTERVAL_LEVELS, QUANTILE_COLUMNS, QUANTILE_LEVELS

LEVELS = "[" + ", ".join(str(v) for v in QUANTILE_LEVELS) + "]"
ZEROS = "[" + ", ".join(["0.0"] * 9) + "]::DOUBLE[]"


def sunday(d: str) -> str:
    return f"({d} - CAST(dayofweek({d}) AS INTEGER))"


def midweek(d: str) -> str:
    return f"({d} + CAST(3 - dayofweek({d}) AS INTEGER))"


def epi_week(d: str) -> str:
    return f"CAST((dayofyear({midweek(d)}) + 6) // 7 AS INTEGER)"


def epi_year(d: str) -> str:
    return f"CAST(year({midweek(d)}) AS INTEGER)"


def epi_start(year: str, week: int) -> str:
    jan4 = f"make_date({year}, 1, 4)"
    return f"({jan4} - CAST(dayofweek({jan4}) AS INTEGER) + {7 * (week - 1)})"


def season_year(d: str) -> str:
    return f"(CASE WHEN {epi_week(d)} >= 41 THEN {epi_year(d)} ELSE {epi_year(d)} - 1 END)"


def season_week(d: str) -> str:
    return f"CAST(({d} - {epi_start(season_year(d), 41)}) // 7 + 1 AS INTEGER)"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def spread(q: str = "q") -> str:
    """The nine rounded wide columns of a list."""
    return ", ".join(f"round({q}[{i + 1}], 6) AS {c}" for i, c in enumerate(QUANTILE_COLUMNS))


def alpha(level: int) -> float:
    return round(1 - level / 100, 2)


WIS = "(0.5 * abs(y - pred) + " + " + ".join(
    f"{alpha(v) / 2} * ((upper_{v} - lower_{v}) + {2 / alpha(v)} * greatest(0, lower_{v} - y)"
    f" + {2 / alpha(v)} * greatest(0, y - upper_{v}))" for v in INTERVAL_LEVELS
) + ") / 4.5"
DISPERSION = "(0.5 * abs(y - pred) + " + " + ".join(
    f"{alpha(v) / 2} * (upper_{v} - lower_{v})" for v in INTERVAL_LEVELS
) + ") / 4.5"
OVER = "(" + " + ".join(f"greatest(0, lower_{v} - y)" for v in INTERVAL_LEVELS) + ") / 4.5"
UNDER = "(" + " + ".join(f"greatest(0, y - upper_{v})" for v in INTERVAL_LEVELS) + ") / 4.5"
COVERED = ", ".join(f"(y >= lower_{v} AND y <= upper_{v}) AS coverage_{v}" for v in INTERVAL_LEVELS)
WIDE = ", ".join(QUANTILE_COLUMNS)
RAW_SPREAD = ", ".join(f"q[{i + 1}] AS {c}" for i, c in enumerate(QUANTILE_COLUMNS))
SCORED_COLUMNS = (
    f"{WIS} AS wis, {DISPERSION} AS dispersion, {OVER} AS overprediction, {UNDER} AS underprediction, "
    f"abs(y - pred) AS ae_median, {COVERED}"
)
METRICS = ", ".join(
    [r6(f"avg({c})", c) for c in ("wis", "dispersion", "overprediction", "underprediction", "ae_median")]
    + [r6(f"avg(coverage_{v}::DOUBLE)", f"coverage_{v}") for v in INTERVAL_LEVELS]
)

_SHIP = "CAST(l_shipdate AS DATE)"

CTES.update({
    "v_geo": "SELECT s_suppkey AS geocode, n_name AS uf, r_name AS macroregion FROM supplier "
             "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_lines": f"SELECT l_suppkey AS geocode, {sunday(_SHIP)} AS date, CAST(year(l_shipdate) AS INTEGER) AS year, "
               "l_quantity, l_returnflag, l_discount, l_tax, l_extendedprice FROM lineitem",
    "v_cases": "SELECT l.geocode, g.uf, l.date, CAST(sum(l_quantity) AS BIGINT) AS casos "
               "FROM v_lines l JOIN v_geo g USING (geocode) GROUP BY ALL",
    "v_cases_chik": "SELECT l.geocode, g.uf, l.date, CAST(sum(l_quantity) AS BIGINT) AS casos "
                    "FROM v_lines l JOIN v_geo g USING (geocode) WHERE l_returnflag = 'R' GROUP BY ALL",
    "v_cities": "SELECT s_suppkey AS geocode FROM supplier ORDER BY s_suppkey LIMIT 15",
    "v_cities_chik": "SELECT s_suppkey AS geocode FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 5",
    "v_state": "SELECT uf AS geo, date, CAST(sum(casos) AS BIGINT) AS casos FROM v_cases "
               "WHERE uf <> 'NATION_7' GROUP BY ALL",
    "v_state_chik": "SELECT uf AS geo, date, CAST(sum(casos) AS BIGINT) AS casos FROM v_cases_chik "
                    "WHERE uf <> 'NATION_7' GROUP BY ALL",
    "v_weeks": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date "
               "FROM (SELECT min(date) AS lo, max(date) AS hi FROM v_state)",
    "v_series": "SELECT g.geo, w.date, coalesce(s.casos, 0) AS casos FROM (SELECT DISTINCT geo FROM v_state) g "
                "CROSS JOIN v_weeks w LEFT JOIN v_state s USING (geo, date)",
    "v_weeks_chik": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date "
                    "FROM (SELECT min(date) AS lo, max(date) AS hi FROM v_state_chik)",
    "v_series_chik": "SELECT g.geo, w.date, coalesce(s.casos, 0) AS casos "
                     "FROM (SELECT DISTINCT geo FROM v_state_chik) g CROSS JOIN v_weeks_chik w "
                     "LEFT JOIN v_state_chik s USING (geo, date)",
    "v_city_state": "SELECT CAST(geocode AS VARCHAR) AS geo, date, casos FROM v_cases "
                    "WHERE geocode IN (SELECT geocode FROM v_cities)",
    "v_city_series": "SELECT g.geo, CAST(w.date AS DATE) AS date, coalesce(s.casos, 0) AS casos "
                     "FROM (SELECT DISTINCT geo FROM v_city_state) g "
                     "CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS date "
                     "FROM v_city_state) w LEFT JOIN v_city_state s ON s.geo = g.geo AND s.date = w.date",
    "v_folds": "SELECT CAST(i AS INTEGER) AS fold_id, "
               f"{epi_start('CAST(1997 + i AS BIGINT)', 25)} AS train_cutoff, "
               f"{epi_start('CAST(1997 + i AS BIGINT)', 41)} AS target_start, "
               f"{epi_start('CAST(1998 + i AS BIGINT)', 40)} AS target_end FROM generate_series(1, 4) t(i)",
    "v_flagged": "SELECT c.*, " + ", ".join(
        f"c.date <= (SELECT train_cutoff FROM v_folds WHERE fold_id = {i}) AS train_{i}, "
        f"c.date BETWEEN (SELECT target_start FROM v_folds WHERE fold_id = {i}) AND "
        f"(SELECT target_end FROM v_folds WHERE fold_id = {i}) AS target_{i}" for i in range(1, 5)
    ) + ", geocode IN (SELECT geocode FROM v_cities) AS target_city FROM v_cases c",
    "v_calendar": "SELECT fold_id, train_cutoff AS origin_date, d AS date, "
                  "CAST((d - train_cutoff) // 7 AS INTEGER) AS horizon_weeks FROM (SELECT *, "
                  "CAST(unnest(generate_series(target_start, target_end, INTERVAL 7 DAY)) AS DATE) AS d FROM v_folds)",
    "v_grid": "SELECT g.geo, c.* FROM (SELECT DISTINCT geo FROM v_series) g CROSS JOIN v_calendar c",
    "v_train": f"SELECT f.fold_id, s.*, {epi_week('s.date')} AS epiweek FROM v_series s "
               "JOIN v_folds f ON s.date <= f.train_cutoff",
    "v_pop": "SELECT geocode, year, count(*) + 1000 AS population FROM v_lines GROUP BY ALL",
    "v_state_pop": "SELECT uf AS geo, year, CAST(sum(population) AS BIGINT) AS population "
                   "FROM v_pop JOIN v_geo USING (geocode) GROUP BY ALL",
    "v_pop_years": "SELECT min(year) AS lo, max(year) AS hi FROM v_state_pop",
    "v_inc": "SELECT s.geo, s.date, s.casos, p.population, s.casos::DOUBLE / p.population * 1e5 AS incidence, "
             "ln(1 + s.casos::DOUBLE / p.population * 1e5) AS log_inc FROM v_series s CROSS JOIN v_pop_years y "
             "LEFT JOIN v_state_pop p ON p.geo = s.geo AND p.year = least(greatest(year(s.date), y.lo), y.hi)",
    "v_climate": "SELECT geocode, date, avg(100 * l_discount) AS temp_med, avg(100 * l_tax) AS precip_med, "
                 "avg(l_extendedprice / nullif(l_quantity, 0)) AS rel_humid_med FROM v_lines GROUP BY ALL",
    "v_climate_w": "SELECT c.*, g.uf, coalesce(p.population, 1) AS w FROM v_climate c JOIN v_geo g USING (geocode) "
                   "CROSS JOIN (SELECT min(year) AS lo, max(year) AS hi FROM v_pop) y LEFT JOIN v_pop p "
                   "ON p.geocode = c.geocode AND p.year = least(greatest(year(c.date), y.lo), y.hi) "
                   "WHERE g.uf <> 'NATION_7'",
    "v_state_climate": "SELECT uf AS geo, date, sum(temp_med * w) / sum(w) AS temp_med, "
                       "sum(precip_med * w) / sum(w) AS precip_med, "
                       "sum(rel_humid_med * w) / sum(w) AS rel_humid_med FROM v_climate_w GROUP BY ALL",
    "v_ocean": f"SELECT {sunday('CAST(o_orderdate AS DATE)')} AS date, avg(o_totalprice) / 1e5 AS enso, "
               "count(*)::DOUBLE AS iod, stddev_samp(o_totalprice) / 1e5 AS pdo FROM orders GROUP BY 1",
    "v_seasonal_raw": "SELECT o_custkey AS geocode, CAST(date_trunc('month', o_orderdate) AS DATE) AS reference_month, "
                      "CAST(o_orderkey % 6 + 1 AS INTEGER) AS forecast_months_ahead, "
                      "avg(o_totalprice) / 1e5 AS temp_med, count(*)::DOUBLE AS umid_med, "
                      "max(o_totalprice) / 1e5 AS precip_tot FROM orders GROUP BY ALL",
    "v_customer": "SELECT c_custkey AS geocode, n_name AS uf FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "v_customer_w": "SELECT c_custkey AS geocode, CAST(ceil(c_acctbal) AS BIGINT) AS population "
                    "FROM customer WHERE c_acctbal > 0",
    "v_seasonal": "SELECT uf AS geo, reference_month, forecast_months_ahead, "
                  "CAST(reference_month + to_months(forecast_months_ahead) AS DATE) AS target_month, "
                  "sum(temp_med * coalesce(population, 0)) / nullif(sum(coalesce(population, 0)), 0) AS temp_med, "
                  "sum(umid_med * coalesce(population, 0)) / nullif(sum(coalesce(population, 0)), 0) AS umid_med, "
                  "sum(precip_tot * coalesce(population, 0)) / nullif(sum(coalesce(population, 0)), 0) AS precip_tot "
                  "FROM v_seasonal_raw JOIN v_customer USING (geocode) LEFT JOIN v_customer_w USING (geocode) "
                  "GROUP BY ALL",
    "v_environment": "SELECT s_suppkey AS geocode, 'K' || (s_suppkey % 9) AS koppen, "
                     "'biome ' || (s_suppkey % 6) AS biome FROM supplier",
    "v_access": "SELECT user_id AS geocode, CAST(ts AS DATE) AS access_date, event_type AS accessed_disease, "
                "count(*) AS access_count FROM events GROUP BY ALL",
    # ---- forecasters ----
    "v_spine": "SELECT CAST(unnest(generate_series(1, 53)) AS INTEGER) AS target_week",
    "v_pools": "SELECT t.fold_id, t.geo, w.target_week, "
               f"quantile_cont(t.casos, {LEVELS}) AS q, avg(t.casos) AS mean FROM v_train t JOIN v_spine w "
               "ON t.epiweek IN (((w.target_week - 4 + 53) % 53) + 1, ((w.target_week - 3 + 53) % 53) + 1, "
               "((w.target_week - 2 + 53) % 53) + 1, ((w.target_week - 1 + 53) % 53) + 1, "
               "((w.target_week + 53) % 53) + 1) GROUP BY ALL",
    "v_clim": "SELECT 'climatological_quantile' AS model, g.fold_id, g.geo, g.date, g.origin_date, g.horizon_weeks, "
              f"list_transform(coalesce(p.q, {ZEROS}), lambda x: greatest(x, 0)) AS q FROM v_grid g "
              "LEFT JOIN v_pools p ON p.fold_id = g.fold_id AND p.geo = g.geo "
              f"AND p.target_week = {epi_week('g.date')}",
    "v_numbered": "SELECT fold_id, geo, casos, row_number() OVER (PARTITION BY fold_id, geo ORDER BY date) AS rn, "
                  "count(*) OVER (PARTITION BY fold_id, geo) AS n FROM v_train",
    "v_diffs": "SELECT a.fold_id, a.geo, CAST(b.rn - a.rn AS INTEGER) AS h, b.casos - a.casos AS diff "
               "FROM v_numbered a JOIN v_numbered b ON a.fold_id = b.fold_id AND a.geo = b.geo "
               "AND b.rn BETWEEN a.rn + 1 AND a.rn + 68",
    "v_diff_q": f"SELECT fold_id, geo, h, quantile_cont(diff, {LEVELS}) AS q FROM v_diffs GROUP BY ALL",
    "v_last": "SELECT fold_id, geo, arg_max(casos, date) AS last_value, count(*) AS weeks FROM v_train GROUP BY ALL",
    "v_naive": "SELECT 'naive' AS model, g.fold_id, g.geo, g.date, g.origin_date, g.horizon_weeks, "
               f"list_transform(coalesce(d.q, {ZEROS}), lambda x: greatest(x + l.last_value, 0)) AS q "
               "FROM v_grid g JOIN v_last l USING (fold_id, geo) LEFT JOIN v_diff_q d ON d.fold_id = g.fold_id "
               "AND d.geo = g.geo AND d.h = CASE WHEN l.weeks <= g.horizon_weeks "
               "THEN greatest(1, l.weeks - 1) ELSE g.horizon_weeks END",
    "v_week_median": "SELECT fold_id, geo, epiweek, quantile_cont(casos, 0.5) AS median FROM v_train GROUP BY ALL",
    "v_resid": "SELECT t.fold_id, t.geo, t.date, t.epiweek, m.median, t.casos - m.median AS residual FROM v_train t "
               "JOIN v_week_median m USING (fold_id, geo, epiweek)",
    "v_resid_q": f"SELECT fold_id, geo, quantile_cont(residual, {LEVELS}) AS q FROM v_resid GROUP BY ALL",
    "v_usual": "SELECT fold_id, geo, quantile_cont(median, 0.5) AS usual FROM v_week_median GROUP BY ALL",
    "v_snaive": "SELECT 'seasonal_naive' AS model, g.fold_id, g.geo, g.date, g.origin_date, g.horizon_weeks, "
                "list_transform(r.q, lambda x: greatest(x + coalesce(m.median, u.usual, 0), 0)) AS q FROM v_grid g "
                "JOIN v_resid_q r USING (fold_id, geo) JOIN v_usual u USING (fold_id, geo) LEFT JOIN v_week_median m "
                f"ON m.fold_id = g.fold_id AND m.geo = g.geo AND m.epiweek = {epi_week('g.date')}",
})


def scored_view(source: str, observed: str = "v_series") -> str:
    """Score a view of quantile lists against a dense series."""
    return (
        f"SELECT model, fold_id, geo, date, origin_date, horizon_weeks, {WIDE}, y AS observed_value, {SCORED_COLUMNS} "
        f"FROM (SELECT m.model, m.fold_id, m.geo, m.date, m.origin_date, m.horizon_weeks, {RAW_SPREAD}, "
        f"s.casos AS y FROM {source} m JOIN {observed} s ON s.geo = m.geo AND s.date = m.date)"
    )


CTES["v_clim_scored"] = scored_view("v_clim")

_HIER_WEEKS = " , ".join(f"((w.target_week - 1 + 53 + ({o})) % 53) + 1" for o in range(-2, 3))
CTES.update({
    "v_region": "SELECT uf AS geo, max(macroregion) AS region FROM v_geo GROUP BY 1",
    "v_hier_train": f"SELECT f.fold_id, i.geo, r.region, {epi_week('i.date')} AS epiweek, i.casos, i.incidence "
                    "FROM v_inc i JOIN v_folds f ON i.date <= f.train_cutoff LEFT JOIN v_region r USING (geo) "
                    "WHERE i.population > 0",
    "v_hier_own": f"SELECT fold_id, geo, target_week, quantile_cont(incidence, {LEVELS}) AS q FROM v_hier_train t "
                  f"JOIN v_spine w ON t.epiweek IN ({_HIER_WEEKS}) GROUP BY ALL",
    "v_hier_region": f"SELECT fold_id, region, target_week, quantile_cont(incidence, {LEVELS}) AS q "
                     f"FROM v_hier_train t JOIN v_spine w ON t.epiweek IN ({_HIER_WEEKS}) GROUP BY ALL",
    "v_volume": "SELECT fold_id, geo, sum(casos)::DOUBLE AS volume FROM v_hier_train GROUP BY ALL",
    "v_shrink": "SELECT fold_id, geo, volume / (volume + kappa) AS weight FROM v_volume JOIN "
                "(SELECT fold_id, quantile_cont(volume, 0.5) AS kappa FROM v_volume GROUP BY 1) USING (fold_id)",
    "v_hier": "SELECT 'hierarchical_climatological' AS model, g.fold_id, g.geo, g.date, g.origin_date, "
              "g.horizon_weeks, list_transform(generate_series(1, 9), lambda i: greatest((coalesce(s.weight, 0.5) * "
              "coalesce(o.q[i], 0) + (1 - coalesce(s.weight, 0.5)) * coalesce(x.q[i], 0)) * p.population / 1e5, 0)) "
              "AS q FROM v_grid g LEFT JOIN v_region r USING (geo) "
              f"LEFT JOIN v_hier_own o ON o.fold_id = g.fold_id AND o.geo = g.geo AND o.target_week = {epi_week('g.date')} "
              "LEFT JOIN v_hier_region x ON x.fold_id = g.fold_id AND x.region = r.region "
              f"AND x.target_week = {epi_week('g.date')} "
              "LEFT JOIN v_shrink s ON s.fold_id = g.fold_id AND s.geo = g.geo CROSS JOIN v_pop_years y "
              "LEFT JOIN v_state_pop p ON p.geo = g.geo AND p.year = least(greatest(year(g.date), y.lo), y.hi)",
    "v_members": "SELECT * FROM v_naive UNION ALL SELECT * FROM v_snaive UNION ALL SELECT * FROM v_clim "
                 "UNION ALL SELECT * FROM v_hier",
    "v_scored": scored_view("v_members"),
})


def rescore(source: str) -> str:
    """Score a wide view that already carries its observation."""
    return (
        f"SELECT model, fold_id, geo, date, origin_date, horizon_weeks, {WIDE}, y AS observed_value, {SCORED_COLUMNS} "
        f"FROM (SELECT *, observed_value AS y FROM {source})"
    )


def sorted_wide(source: str, keep: str) -> str:
    """Re-sort the nine wide columns of every row."""
    return f"SELECT {keep}, {RAW_SPREAD} FROM (SELECT {keep}, list_sort([{WIDE}]) AS q FROM ({source}))"


MEMBERS = ["climatological_quantile", "seasonal_naive", "hierarchical_climatological"]
MEMBER_LIST = ", ".join(f"'{m}'" for m in MEMBERS)
_UNIT = "fold_id, geo, date, horizon_weeks"
_CARRY = "max(origin_date) AS origin_date, max(observed_value) AS observed_value"
_KEEP = f"model, {_UNIT}, origin_date, observed_value"
_UPPER = "(observed_value - pred) / greatest(upper_{0} - pred, 1e-9)"
_LOWER = "(pred - observed_value) / greatest(pred - lower_{0}, 1e-9)"


def multiples(source: str, where: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}{v} AS level, CASE WHEN observed_value > pred THEN {_UPPER.format(v)} WHEN observed_value < pred "
        f"THEN {_LOWER.format(v)} ELSE 0 END AS multiple FROM {source} WHERE {where}" for v in INTERVAL_LEVELS
    )


def widened(source: str, factors: str, name: str, keep: str = _KEEP, on: str = "") -> str:
    """Apply one factor per level (a view with columns level, factor) about the median."""
    cols = []
    for c in QUANTILE_COLUMNS:
        if c == "pred":
            cols.append("pred")
        else:
            f = f"(SELECT factor FROM {factors} x WHERE x.level = {c.split('_')[1]}{on})"
            cols.append(f"pred + {f} * ({c} - pred) AS {c}")
    others = keep.replace("model, ", "")
    return sorted_wide(f"SELECT '{name}' AS model, {others}, {', '.join(cols)} FROM {source} e", keep)


CTES.update({
    "v_vincent": sorted_wide(
        f"SELECT 'ensemble_vincent' AS model, {_UNIT}, {_CARRY}, "
        + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in QUANTILE_COLUMNS)
        + f" FROM v_scored WHERE model IN ({MEMBER_LIST}) GROUP BY {_UNIT}", _KEEP),
    "v_fold_weights": "SELECT fold_id, model, (1 / m) / sum(1 / m) OVER (PARTITION BY fold_id) AS weight FROM "
                      f"(SELECT fold_id, model, avg(wis) AS m FROM v_scored WHERE model IN ({MEMBER_LIST}) GROUP BY ALL)",
    "v_weights": "SELECT model, weight FROM v_fold_weights WHERE fold_id = 1",
    "v_invwis": sorted_wide(
        f"SELECT 'ensemble_invwis' AS model, {_UNIT}, {_CARRY}, "
        + ", ".join(f"sum({c} * weight) / sum(weight) AS {c}" for c in QUANTILE_COLUMNS)
        + f" FROM v_scored JOIN v_weights USING (model) GROUP BY {_UNIT}", _KEEP),
    "v_multiples": multiples("v_vincent", "fold_id = 1"),
    "v_factors": "SELECT level, CASE level " + " ".join(
        f"WHEN {v} THEN quantile_cont(multiple, {v / 100})" for v in INTERVAL_LEVELS
    ) + " END AS factor FROM v_multiples GROUP BY level",
    "v_conformal": widened("v_vincent", "v_factors", "ensemble_conformal"),
    "v_ensembles": f"SELECT {_KEEP}, {WIDE} FROM v_vincent UNION ALL SELECT {_KEEP}, {WIDE} FROM v_invwis "
                   f"UNION ALL SELECT {_KEEP}, {WIDE} FROM v_conformal",
    "v_ensembles_scored": rescore("v_ensembles"),
    "v_all_scored": "SELECT * FROM v_scored UNION ALL BY NAME SELECT * FROM v_ensembles_scored",
})

_LAG_SQL = ", ".join(f"lag(log_inc, {k - 1}) OVER w AS lag_{k}" for k in (1, 2, 3, 4, 8, 52))
_OCEAN_SQL = ", ".join(f"lag({i}, {k}) OVER (ORDER BY date) AS {i}_lag{k}"
                       for i in ("enso", "iod", "pdo") for k in (0, 4, 8, 12, 26, 52))
OCEAN_LAGS = ", ".join(f"{i}_lag{k}" for i in ("enso", "iod", "pdo") for k in (0, 4, 8, 12, 26, 52))
CTES.update({
    "v_ocean_lags": f"SELECT date, {_OCEAN_SQL} FROM v_ocean",
    "v_origin": "SELECT i.geo, i.date, i.casos, i.population, i.log_inc, c.temp_med, c.precip_med, c.rel_humid_med, "
                f"{epi_week('i.date')} AS epiweek, {_LAG_SQL}, "
                "avg(log_inc) OVER (PARTITION BY i.geo ORDER BY i.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS roll_mean_4, "
                "stddev_samp(log_inc) OVER (PARTITION BY i.geo ORDER BY i.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) "
                "AS roll_std_4, "
                "avg(log_inc) OVER (PARTITION BY i.geo ORDER BY i.date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS roll_mean_8, "
                "max(log_inc) OVER (PARTITION BY i.geo ORDER BY i.date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS roll_max_12, "
                "c.temp_med_roll4, c.precip_med_roll4, c.rel_humid_med_roll4"
                + " FROM v_inc i LEFT JOIN v_climate_smooth c USING (geo, date) WINDOW w AS (PARTITION BY i.geo ORDER BY i.date)",
    "v_origin_fold": "SELECT f.fold_id, f.train_cutoff, f.target_start, f.target_end, o.*, o.temp_med - m.mean_temp AS temp_anomaly "
                     "FROM v_origin o JOIN v_folds f ON o.date <= f.train_cutoff LEFT JOIN v_climate_means m "
                     "ON m.fold_id = f.fold_id AND m.geo = o.geo AND m.epiweek = o.epiweek",
    "v_climate_smooth": "SELECT *, " + ", ".join(
        f"avg({c}) OVER (PARTITION BY geo ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}_roll4"
        for c in ("temp_med", "precip_med", "rel_humid_med")) + " FROM v_state_climate",
    "v_climate_means": f"SELECT f.fold_id, c.geo, {epi_week('c.date')} AS epiweek, avg(c.temp_med) AS mean_temp "
                       "FROM v_state_climate c JOIN v_folds f ON c.date <= f.train_cutoff GROUP BY ALL",
    "v_static": "SELECT uf AS geo, " + ", ".join(
        f"coalesce(sum(CASE WHEN {col} = '{v}' THEN w ELSE 0 END)::DOUBLE / nullif(sum(w), 0), 0) AS "
        f"{col}_frac_{v.replace(' ', '_')}"
        for col, values in (("koppen", [f"K{i}" for i in range(9)]), ("biome", [f"biome {i}" for i in range(6)]))
        for v in values) + " FROM (SELECT e.*, g.uf, coalesce(p.population, 0) AS w FROM v_environment e "
        "JOIN v_geo g USING (geocode) LEFT JOIN v_pop p ON p.geocode = e.geocode AND p.year = 2000) GROUP BY uf",
    "v_pairs": "SELECT o.fold_id, o.train_cutoff, o.target_start, o.target_end, o.geo, o.date AS origin_date, "
               "CAST(h AS INTEGER) AS horizon_weeks, o.date + CAST(7 * h AS INTEGER) AS target_date "
               "FROM v_origin_fold o CROSS JOIN generate_series(1, 68) t(h)",
    "v_anchor_dates": "SELECT p.origin_date, p.target_epiweek, max(w.date) AS anchor_date FROM "
                      f"(SELECT DISTINCT origin_date, {epi_week('target_date')} AS target_epiweek FROM v_pairs) p "
                      f"JOIN v_weeks w ON {epi_week('w.date')} = p.target_epiweek AND w.date <= p.origin_date GROUP BY ALL",
    "v_issued": "SELECT p.geo, p.origin_month, s.target_month, arg_max_null(s.temp_med, s.reference_month) AS seasonal_temp, "
                "arg_max_null(s.umid_med, s.reference_month) AS seasonal_humid, "
                "arg_max_null(s.precip_tot, s.reference_month) AS seasonal_precip FROM (SELECT DISTINCT geo, "
                "CAST(date_trunc('month', date) AS DATE) AS origin_month FROM v_series) p JOIN v_seasonal s ON s.geo = p.geo "
                "AND s.reference_month <= p.origin_month AND s.target_month >= p.origin_month GROUP BY ALL",
    "v_panel": f"SELECT p.*, {epi_week('p.target_date')} AS target_epiweek, o.* EXCLUDE (fold_id, geo, date, train_cutoff, "
               "target_start, target_end, casos, population, log_inc, temp_med, precip_med, rel_humid_med, epiweek), "
               f"l.* EXCLUDE (date), sin(2 * pi() * {epi_week('p.target_date')} / 52) AS sin1, "
               f"cos(2 * pi() * {epi_week('p.target_date')} / 52) AS cos1, sin(4 * pi() * {epi_week('p.target_date')} / 52) AS sin2, "
               f"cos(4 * pi() * {epi_week('p.target_date')} / 52) AS cos2, a.log_inc AS seasonal_anchor, "
               "ln(sp.population::DOUBLE) AS log_pop, sp.population AS population_at_target, i.seasonal_temp, "
               "i.seasonal_humid, i.seasonal_precip, st.* EXCLUDE (geo), y.log_inc AS label FROM v_pairs p "
               "JOIN v_origin_fold o ON o.fold_id = p.fold_id AND o.geo = p.geo AND o.date = p.origin_date "
               "LEFT JOIN v_ocean_lags l ON l.date = p.origin_date LEFT JOIN v_anchor_dates ad "
               f"ON ad.origin_date = p.origin_date AND ad.target_epiweek = {epi_week('p.target_date')} "
               "LEFT JOIN v_inc a ON a.geo = p.geo AND a.date = ad.anchor_date "
               "LEFT JOIN v_issued i ON i.geo = p.geo AND i.origin_month = CAST(date_trunc('month', p.origin_date) AS DATE) "
               "AND i.target_month = CAST(date_trunc('month', p.target_date) AS DATE) "
               "LEFT JOIN v_static st ON st.geo = p.geo LEFT JOIN v_inc y ON y.geo = p.geo AND y.date = p.target_date "
               "CROSS JOIN v_pop_years py LEFT JOIN v_state_pop sp ON sp.geo = p.geo "
               "AND sp.year = least(greatest(year(p.target_date), py.lo), py.hi)",
    "v_train_panel": "SELECT * FROM v_panel WHERE origin_date >= DATE '1996-01-07' AND horizon_weeks <= 67 "
                     "AND target_date <= train_cutoff AND label IS NOT NULL",
})


CTES["v_city_pop"] = "SELECT CAST(geocode AS VARCHAR) AS geo, year, population FROM v_pop"
CTES["v_city_region"] = "SELECT CAST(geocode AS VARCHAR) AS geo, max(macroregion) AS region FROM v_geo GROUP BY 1"


def _track(disease: str, level: str, state: str) -> str:
    """Scored statistical forecasts and their ensemble for one series, with every model written against that series."""
    series = f"v_{disease}_{level}"
    CTES[series] = f"SELECT * FROM {state}"
    names = {"v_series": series}
    if level == "city":
        names |= {"v_state_pop": "v_city_pop", "v_region": "v_city_region"}
    for view in ("v_train", "v_grid", "v_pools", "v_clim", "v_numbered", "v_diffs", "v_diff_q", "v_last", "v_naive", "v_week_median",
                 "v_resid", "v_resid_q", "v_usual", "v_snaive", "v_inc", "v_hier_train", "v_hier_own", "v_hier_region", "v_volume",
                 "v_shrink", "v_hier", "v_members", "v_scored", "v_vincent"):
        body = CTES[view]
        for old in sorted(names, key=len, reverse=True):
            body = re.sub(rf"\b{old}\b", names[old], body)
        names[view] = f"v_{disease}_{level}_{view[2:]}"
        CTES[names[view]] = body
    CTES[f"v_{disease}_{level}_all"] = f"SELECT * FROM {names['v_scored']} UNION ALL BY NAME {rescore(names['v_vincent'])}"
    return f"SELECT '{disease}' AS disease, '{level}' AS level, * FROM v_{disease}_{level}_all"


CTES["v_city_state_chik"] = CTES["v_city_state"].replace("v_cases", "v_cases_chik").replace("v_cities", "v_cities_chik")
CTES["v_city_series_chik"] = CTES["v_city_series"].replace("v_city_state", "v_city_state_chik")
CTES["v_tracks"] = " UNION ALL ".join([
    _track("dengue", "state", "v_series"), _track("dengue", "city", "v_city_series"),
    _track("chikungunya", "state", "v_series_chik"), _track("chikungunya", "city", "v_city_series_chik"),
])
