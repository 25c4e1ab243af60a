"""Scalar functions (section 2.8), each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog import inputs as inp
from tidecast.catalog import sql
from tidecast.catalog.registry import query
from tidecast.constants import INTERVAL_LEVELS, QUANTILE_COLUMNS, QUANTILE_LEVELS
from tidecast.functions import calendar as cal
from tidecast.functions import quantiles as qt
from tidecast.functions import scoring as sc
from tidecast.functions import transforms as tf
from tidecast.operators import folds as fo
from tidecast.operators import rollup
from tidecast.plans import baselines
from tidecast.sources import star

_UNIT = "model, fold_id, geo, date"
_UNIT_COLUMNS = ["model", "fold_id", "geo", "date"]


def _ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates with their number of lines (dates collapse on the map side)."""
    lines = star.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return lines.groupBy("d").agg(F.count("*").alias("lines"))


_DAYS = "(SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS lines FROM lineitem GROUP BY 1)"


@query("x01_epi_week", f"SELECT d, lines, {sql.epi_year('d')} AS epi_year, {sql.epi_week('d')} AS epi_week FROM {_DAYS}")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _ship_days(spark, sf_dir).select(
        "d", "lines", cal.epi_year(d).alias("epi_year"), cal.epi_week(d).alias("epi_week"))


@query("x02_season_start_year",
       f"SELECT {sql.season_year('d')} AS season, CAST(sum(lines) AS BIGINT) AS lines FROM {_DAYS} GROUP BY 1")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship_days(spark, sf_dir).groupBy(cal.season_start_year(F.col("d")).alias("season")).agg(
        F.sum("lines").alias("lines"))


@query("x03_season_week", f"SELECT d, {sql.season_week('d')} AS season_week FROM {_DAYS}")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship_days(spark, sf_dir).select("d", cal.season_week(F.col("d")).alias("season_week"))


@query("x04_season_dates", f"""
SELECT season_year, CAST(unnest(generate_series({sql.epi_start('season_year - 1', 41)}, {sql.epi_start('season_year', 40)},
       INTERVAL 7 DAY)) AS DATE) AS date
FROM (SELECT DISTINCT {sql.season_year('d')} + 1 AS season_year FROM {_DAYS})""")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = _ship_days(spark, sf_dir).select((cal.season_start_year(F.col("d")) + 1).alias("season_year")).distinct()
    return seasons.select("season_year", F.explode(cal.season_dates(F.col("season_year"))).alias("date"))


@query("x05_horizon_weeks", """
SELECT f.fold_id, s.date, CAST((s.date - f.train_cutoff) // 7 AS INTEGER) AS horizon_weeks
FROM (SELECT DISTINCT date FROM v_cases) s JOIN v_folds f ON s.date BETWEEN f.target_start AND f.target_end""")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = star.weekly_counts(spark, sf_dir).select("date").distinct()
    hit = fo.target_window(weeks, star.folds(spark)).join(
        F.broadcast(star.folds(spark).select("fold_id", "train_cutoff")), "fold_id")
    return hit.select("fold_id", "date", cal.horizon_weeks(F.col("date"), F.col("train_cutoff")).alias("horizon_weeks"))


@query("x06_month_arithmetic", f"""
SELECT d, CAST(date_trunc('month', d) AS DATE) AS month, CAST(date_trunc('month', d) + to_months(6) AS DATE) AS plus_six,
       d + 7 * 16 AS plus_weeks FROM {_DAYS}""")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = cal.month_start(F.col("d"))
    return _ship_days(spark, sf_dir).select(
        "d", month.alias("month"), F.add_months(month, 6).alias("plus_six"),
        cal.add_weeks(F.col("d"), F.lit(16)).alias("plus_weeks"))


@query("x07_year_clamp", """
SELECT CAST(least(greatest(year(o_orderdate), y.lo + 1), y.hi - 1) AS INTEGER) AS pop_year, count(*) AS orders
FROM orders CROSS JOIN v_pop_years y GROUP BY 1""")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = inp.state_population(spark, sf_dir)
    low = years.select(F.min("year") + 1).scalar()
    high = years.select(F.max("year") - 1).scalar()
    clamped = cal.clamp_year(F.year("o_orderdate"), low, high)
    orders = star.table(spark, sf_dir, "orders").select(clamped.alias("pop_year"))
    return orders.groupBy("pop_year").agg(F.count("*").alias("orders"))


@query("x08_weekday_test",
       "SELECT dayofweek(CAST(o_orderdate AS DATE)) = 0 AS is_sunday, count(*) AS orders FROM orders GROUP BY 1")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return star.table(spark, sf_dir, "orders").groupBy(cal.is_sunday(day).alias("is_sunday")).agg(
        F.count("*").alias("orders"))


@query("x09_incidence", f"""
SELECT geo, date, {sql.r6('incidence', 'incidence')}, {sql.r6('log_inc', 'log_inc')},
       {sql.r6('greatest((exp(log_inc) - 1) * population / 1e5, 0)', 'counts')} FROM v_inc""")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rollup.add_incidence(inp.state_series(spark, sf_dir), inp.state_population(spark, sf_dir))
    counts = tf.counts_from_log(F.col("log_inc"), F.col("population"))
    return inp.round_all(df.select("geo", "date", "incidence", "log_inc", counts.alias("counts")))


@query("x10_annual_harmonics", f"""
SELECT d, round(sin(2 * pi() * w / 52), 6) + 0.0 AS sin1, round(cos(2 * pi() * w / 52), 6) + 0.0 AS cos1,
       round(sin(4 * pi() * w / 52), 6) + 0.0 AS sin2, round(cos(4 * pi() * w / 52), 6) + 0.0 AS cos2
FROM (SELECT d, {sql.epi_week('d')} AS w FROM {_DAYS})""")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = cal.epi_week(F.col("d"))
    parts = tf.harmonics(week)
    return _ship_days(spark, sf_dir).select("d", *[(F.round(c, 6) + 0.0).alias(n) for n, c in parts.items()])


_PINBALL = ", ".join(
    f"round(greatest({t} * (observed_value - {c}), ({t} - 1) * (observed_value - {c})), 9) AS loss_{c}"
    for t, c in zip(QUANTILE_LEVELS, QUANTILE_COLUMNS)
)


@query("x11_pinball_loss", f"SELECT {_UNIT}, {_PINBALL} FROM v_scored")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("observed_value")
    losses = [F.round(sc.pinball(y, F.col(c), t), 9).alias(f"loss_{c}")
              for t, c in zip(QUANTILE_LEVELS, QUANTILE_COLUMNS)]
    return inp.members_scored(spark, sf_dir).select(*_UNIT_COLUMNS, *losses)


_INTERVALS = ", ".join(
    sql.r6(f"(upper_{v} - lower_{v}) + {2 / sql.alpha(v)} * greatest(0, lower_{v} - observed_value) + "
           f"{2 / sql.alpha(v)} * greatest(0, observed_value - upper_{v})", f"score_{v}") for v in INTERVAL_LEVELS
)


@query("x12_interval_score", f"SELECT {_UNIT}, {_INTERVALS} FROM v_scored")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("observed_value")
    scores = [inp.r6(sc.interval_score(F.col(f"lower_{v}"), F.col(f"upper_{v}"), y, round(1 - v / 100, 2)), f"score_{v}")
              for v in INTERVAL_LEVELS]
    return inp.members_scored(spark, sf_dir).select(*_UNIT_COLUMNS, *scores)


@query("x13_wis_from_intervals",
       f"SELECT {_UNIT}, {sql.r6(sql.WIS, 'wis')} FROM (SELECT *, observed_value AS y FROM v_scored)")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    wis = sc.wis_from_intervals(F.col("observed_value"))
    return inp.members_scored(spark, sf_dir).select(*_UNIT_COLUMNS, inp.r6(wis, "wis"))


_PINBALL_SUM = " + ".join(
    f"greatest({t} * (observed_value - {c}), ({t} - 1) * (observed_value - {c}))"
    for t, c in zip(QUANTILE_LEVELS, QUANTILE_COLUMNS)
)


@query("x14_wis_from_quantiles", f"SELECT {_UNIT}, {sql.r6(f'({_PINBALL_SUM}) / 4.5', 'wis')} FROM v_scored")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    wis = sc.wis_from_quantiles(F.col("observed_value"), qt.wide_array())
    return inp.members_scored(spark, sf_dir).select(*_UNIT_COLUMNS, inp.r6(wis, "wis"))


@query("x15_wis_decomposition", f"""
SELECT {_UNIT}, {sql.r6('dispersion', 'dispersion')}, {sql.r6('overprediction', 'overprediction')},
       {sql.r6('underprediction', 'underprediction')}, {sql.r6('abs(observed_value - pred)', 'ae_median')},
       coverage_50, coverage_80, coverage_90, coverage_95 FROM v_scored""")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("observed_value")
    return inp.members_scored(spark, sf_dir).select(
        *_UNIT_COLUMNS, inp.r6(sc.dispersion(y), "dispersion"), inp.r6(sc.overprediction(y), "overprediction"),
        inp.r6(sc.underprediction(y), "underprediction"), inp.r6(F.abs(y - F.col("pred")), "ae_median"),
        *[sc.covered(y, v).alias(f"coverage_{v}") for v in INTERVAL_LEVELS])


# Quantiles taken out of order, so that the rearrangement has work to do.
_SHUFFLED = ["upper_50", "lower_90", "pred", "upper_95", "lower_95", "upper_80", "lower_50", "upper_90", "lower_80"]


@query("x16_monotone_rearrangement", f"""
SELECT {_UNIT}, {sql.spread()} FROM (SELECT {_UNIT}, list_sort([{', '.join(_SHUFFLED)}]) AS q FROM v_scored)""")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = inp.members_scored(spark, sf_dir).select(
        *_UNIT_COLUMNS, *[F.col(a).alias(b) for a, b in zip(_SHUFFLED, QUANTILE_COLUMNS)])
    return inp.round_all(qt.rearrange(crossed))


_FIXED = {50: 1.5, 80: 0.75, 90: 1.25, 95: 2.0}
_WIDENED = ", ".join(
    "pred" if c == "pred" else f"pred + {_FIXED[int(c.split('_')[1])]} * ({c} - pred)" for c in QUANTILE_COLUMNS
)


@query("x17_conformal_widening",
       f"SELECT {_UNIT}, {sql.spread()} FROM (SELECT {_UNIT}, list_sort([{_WIDENED}]) AS q FROM v_scored)")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = inp.members_scored(spark, sf_dir).select(
        *_UNIT_COLUMNS, *qt.widen({k: F.lit(v) for k, v in _FIXED.items()}))
    return inp.round_all(qt.rearrange(moved))


def _mean_centred_sql() -> str:
    cols = []
    for i in range(9):
        if i < 4:
            items = ", ".join(f"q[{j + 1}]" for j in range(i, 4))
            cols.append(f"least({items}, mean)")
        elif i == 4:
            cols.append("mean")
        else:
            items = ", ".join(f"q[{j + 1}]" for j in range(5, i + 1))
            cols.append(f"greatest({items}, mean)")
    return ", ".join(sql.r6(f"greatest({c}, 0)", n) for c, n in zip(cols, QUANTILE_COLUMNS))


@query("x18_mean_point_estimate", f"""
SELECT g.fold_id, g.geo, g.date, {_mean_centred_sql()} FROM v_grid g JOIN v_pools p ON p.fold_id = g.fold_id
AND p.geo = g.geo AND p.target_week = {sql.epi_week('g.date')}""")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = baselines.climatological(inp.state_series(spark, sf_dir), star.folds(spark), point_estimate="mean")
    return inp.rounded_quantiles(df.select("fold_id", "geo", "date", "q"))


@query("x19_convex_blend", f"""
SELECT fold_id, geo, date, {', '.join(sql.r6(f'0.25 * a.{c} + 0.75 * b.{c}', c) for c in QUANTILE_COLUMNS)}
FROM (SELECT * FROM v_scored WHERE model = 'climatological_quantile') a
JOIN (SELECT * FROM v_scored WHERE model = 'seasonal_naive') b USING (fold_id, geo, date)""")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = inp.members_scored(spark, sf_dir)
    keys = ["fold_id", "geo", "date"]
    first = scored.filter(F.col("model") == "climatological_quantile").select(*keys, qt.wide_array().alias("a"))
    second = scored.filter(F.col("model") == "seasonal_naive").select(*keys, qt.wide_array().alias("b"))
    both = first.join(second, keys).select(*keys, qt.blend(F.lit(0.25), F.col("a"), F.col("b")).alias("q"))
    return inp.rounded_quantiles(both)


@query("x20_growth_curve", f"""
SELECT geo, date, round(total / pow(1 + 0.5 * exp(-0.3 * ({sql.season_week('date')} - 20)), 1 / 0.5), 6) AS size
FROM v_series JOIN (SELECT geo, sum(casos)::DOUBLE AS total FROM v_series GROUP BY 1) USING (geo)""")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = inp.state_series(spark, sf_dir)
    total = series.groupBy("geo").agg(F.sum("casos").cast("double").alias("total"))
    size = tf.growth_curve(cal.season_week(F.col("date")), F.col("total"), F.lit(0.3), F.lit(20), F.lit(0.5))
    return series.join(total, "geo").select("geo", "date", inp.r6(size, "size"))


@query("x21_negative_binomial", """
SELECT geo, date, 4.0::DOUBLE AS r, round(4.0 / (4.0 + greatest(casos, 1e-6)), 6) AS p FROM v_series""")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tf.negative_binomial(F.greatest(F.col("casos").cast("double"), F.lit(1e-6)), F.lit(0.25))
    return inp.state_series(spark, sf_dir).select("geo", "date", parts["r"].alias("r"), inp.r6(parts["p"], "p"))


_NEEDED = ", ".join(
    sql.r6(f"CASE WHEN observed_value > pred THEN (observed_value - pred) / greatest(upper_{v} - pred, 1e-9) "
           f"WHEN observed_value < pred THEN (pred - observed_value) / greatest(pred - lower_{v}, 1e-9) "
           f"ELSE 0 END", f"needed_{v}") for v in INTERVAL_LEVELS
)


@query("x22_needed_multiple", f"SELECT {_UNIT}, {_NEEDED} FROM v_scored")
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("observed_value").cast("double")
    scored = inp.members_scored(spark, sf_dir)
    return scored.select(*_UNIT_COLUMNS, *[inp.r6(sc.widening_needed(y, v), f"needed_{v}") for v in INTERVAL_LEVELS])


@query("x23_category_cleaning", """
SELECT replace(replace(p_type, ' ', '_'), 'â', 'a') AS category, count(*) AS parts FROM part GROUP BY 1""")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "part").groupBy(tf.clean_category(F.col("p_type")).alias("category")).agg(
        F.count("*").alias("parts"))


@query("x24_composite_key", """
SELECT geo || '_' || fold_id AS task, count(*) AS units FROM v_scored GROUP BY 1""")
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.members_scored(spark, sf_dir).groupBy(
        tf.composite_key(F.col("geo"), F.col("fold_id")).alias("task")).agg(F.count("*").alias("units"))


@query("x25_cqr_score", f"""
SELECT {_UNIT}, {', '.join(sql.r6(f'greatest(lower_{v} - observed_value, observed_value - upper_{v})', f'score_{v}')
                           for v in INTERVAL_LEVELS)} FROM v_scored""")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("observed_value")
    return inp.members_scored(spark, sf_dir).select(*_UNIT_COLUMNS, *[
        inp.r6(sc.conformity(y, F.col(f"lower_{v}"), F.col(f"upper_{v}")), f"score_{v}") for v in INTERVAL_LEVELS])


_LOG_SHIFT = {50: 0.05, 80: -0.02, 90: 0.1, 95: 0.2}


def _log_widened(c: str) -> str:
    if c == "pred":
        return "pred"
    side, level = c.split("_")
    shift = _LOG_SHIFT[int(level)]
    if side == "lower":
        return f"exp(greatest(0, ln(1 + {c}) - ({shift}))) - 1"
    return f"exp(ln(1 + {c}) + ({shift})) - 1"


@query("x26_log_space_widening", f"""
SELECT {_UNIT}, {sql.spread()} FROM
(SELECT {_UNIT}, list_sort([{', '.join(_log_widened(c) for c in QUANTILE_COLUMNS)}]) AS q FROM v_scored)""")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = inp.members_scored(spark, sf_dir).select(
        *_UNIT_COLUMNS, *qt.widen_log({k: F.lit(v) for k, v in _LOG_SHIFT.items()}))
    return inp.round_all(qt.rearrange(moved))


@query("x27_rescale_to_second_series", f"""
SELECT date, {sql.r6('b * (SELECT stddev_samp(a) / stddev_samp(b) FROM j)', 'rescaled')}
FROM (SELECT d.date, ln(1 + sum(d.casos)) AS a, any_value(o.pdo) AS b FROM v_series d JOIN v_ocean o USING (date)
      GROUP BY d.date) j_rows""".replace("FROM j)", "FROM (SELECT d.date, ln(1 + sum(d.casos)) AS a, any_value(o.pdo) AS b "
                                         "FROM v_series d JOIN v_ocean o USING (date) GROUP BY d.date))"))
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    national = inp.state_series(spark, sf_dir).groupBy("date").agg(F.sum("casos").alias("casos"))
    joined = national.join(star.ocean(spark, sf_dir), "date").select(
        "date", F.log1p("casos").alias("a"), F.col("pdo").alias("b"))
    scale = joined.select((F.stddev_samp("a") / F.stddev_samp("b"))).scalar()
    return joined.select("date", inp.r6(F.col("b") * scale, "rescaled"))
