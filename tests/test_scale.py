"""What lets operators grow: nested folds, selection in ranges, carried as-of joins, batch noise, one fit for all folds, refresh."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast import session
from tidecast.catalog import inputs
from tidecast.constants import QUANTILE_LEVELS
from tidecast.functions import counts
from tidecast.operators import folds as fo
from tidecast.operators import joins as jn
from tidecast.operators import order_stats as os_
from tidecast.plans import backtest, baselines, boosting, hierarchical, refresh, tracks, trajectories
from tidecast.sources import star

START = dt.date(1996, 1, 7)


@pytest.fixture(scope="module")
def folds(spark):
    return star.folds(spark)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = [(g, START + dt.timedelta(weeks=i), int(rng.integers(0, 30))) for g in "AB" for i in range(330)]
    return spark.createDataFrame(rows, "geo string, date date, casos long").repartition(3)


def test_nested_spans_equal_a_copy_for_each_fold(series, folds):
    nested = fo.Nested(folds)
    found = nested.counts(nested.trained(series), ["geo"], "casos")
    rows = {(r.fold_id, r.geo, r.casos): r.n for r in found.select("geo", "casos", nested.rows(n="n")).collect() if r.n}
    copied = fo.training(series, folds).groupBy("fold_id", "geo", "casos").count().collect()
    assert rows == {(r.fold_id, r.geo, r.casos): r["count"] for r in copied}


def test_a_row_enters_one_span_however_many_folds_there_are(spark, series):
    cutoffs = [(i, START + dt.timedelta(weeks=20 * i)) for i in range(1, 13)]
    nested = fo.Nested(spark.createDataFrame(cutoffs, "fold_id int, train_cutoff date"))
    spans = nested.trained(series)
    assert spans.count() == series.filter(F.col("date") <= F.lit(cutoffs[-1][1])).count()
    pooled = baselines.pooled_weeks(baselines.week_counts(series, nested, "casos"), nested, "casos", -3, 1)
    plan = pooled._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate inline") == 1  # folds part only in the fitted state


def test_quantile_sets_are_exact_in_one_pass(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else f"g{g}", int(k), float(np.round(rng.lognormal(0, 2), 1)), int(rng.integers(0, 4)))
            for g in range(5) for k in range(3) for _ in range(int(rng.integers(1, 200)))]
    df = spark.createDataFrame(rows, "g string, k int, v double, w long").repartition(4)
    levels = [0.0, 0.1, 0.5, 0.99, 1.0]
    sets = [os_.QuantileSet(["g", "k"], levels, None, "rows"), os_.QuantileSet(["g", "k"], levels, "w", "weighted"), os_.QuantileSet([], levels), os_.QuantileSet(["k"], [0.5], "w")]
    for parts in (1, 7):
        by_both, overall, by_k = os_.exact_quantile_sets(df, "v", sets, parts=parts)
        for r in by_both.collect():
            values = np.concatenate([np.repeat(v, 1 if r.set == "rows" else w) for g, k, v, w in rows if (g, k) == (r.g, r.k)] or [np.zeros(0)])
            assert r.n == len(values) and r.v == pytest.approx(np.quantile(values, r.quantile_level), rel=1e-12)
        assert by_both.count() == 2 * 15 * len(levels)
        assert {r.quantile_level: r.v for r in overall.collect()} == pytest.approx({x: np.quantile([v for *_, v, _ in rows], x) for x in levels})
        for r in by_k.collect():
            assert r.v == pytest.approx(np.median(np.concatenate([np.repeat(v, w) for _, k, v, w in rows if k == r.k])))


def test_selection_broadcasts_no_group(spark):
    df = spark.range(30_000).select((F.col("id") % 3000).alias("g"), F.rand(1).alias("v"))
    found = os_.exact_quantiles(df, ["g"], "v", [0.5])
    assert "ResolvedHint" not in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 3000


def test_a_region_of_a_hundred_thousand_geos(spark, folds):
    nested = fo.Nested(folds)
    week = (F.col("id") % 4 + 9).cast("int")
    value = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0
    pool = spark.range(400_000).select(F.lit("R").alias("region"), week.alias("epiweek"), value.alias("incidence"),
                                       *[(F.col("id") % 5 < i).cast("long").alias(f"n_{i}") for i in nested.ids])
    found = {(r.fold_id, r.target_week): r.q for r in hierarchical.regional_vectors(pool, nested, "incidence", -2, 2, parts=16).collect()}
    rows = np.array([(r.epiweek, r.incidence, r.n_1, r.n_3) for r in pool.select("epiweek", "incidence", "n_1", "n_3").collect()])
    for fold, column in ((1, 2), (3, 3)):
        for target in (8, 10, 14):
            near = rows[(np.abs(rows[:, 0] - target) <= 2) & (rows[:, column] > 0), 1]
            assert found[(fold, target)] == pytest.approx(np.quantile(near, QUANTILE_LEVELS).tolist())


@pytest.mark.parametrize("parts", [1, 6, None])
def test_as_of_join_against_brute_force(spark, parts):
    rng = np.random.default_rng(2)
    right = [("hot" if i % 2 else f"k{i % 7}", int(rng.integers(0, 400)), float(i), None if i % 5 == 0 else f"x{i}") for i in range(600)]
    left = [("hot" if i % 2 else f"k{i % 9}", int(rng.integers(-20, 450)), i) for i in range(300)] + [(None, 5, 900), ("hot", None, 901), ("none", 7, 902)] * 2
    a = spark.createDataFrame(left, "k string, t int, row int").repartition(3)
    b = spark.createDataFrame(right + [("k1", None, 1.0, "late"), (None, 1, 1.0, "nokey")], "k string, s int, v double, x string").repartition(5)
    found = jn.as_of(a, b, ["k"], "t", "s", ["v", "x"], parts=parts).collect()

    def latest(k, t):
        hits = [(s, v, x is not None, x) for kk, s, v, x in right if kk == k and t is not None and s <= t]
        return (lambda h: (h[1], h[3]))(max(hits)) if hits else (None, None)

    assert sorted(map(tuple, found), key=str) == sorted(((k, t, row, *latest(k, t)) for k, t, row in left), key=str)


def test_draws_have_the_moments_of_the_distribution():
    n = 200_000
    key, place = np.full(n, 7, np.uint64), np.arange(n, dtype=np.uint64)
    for mean, alpha in ((0.5, 0.1), (6.0, 2.0), (40.0, 0.05), (3000.0, 0.5), (1e-6, 10.0)):
        x = counts.negative_binomial(np.full(n, mean), np.full(n, alpha), key, place)
        var = mean + alpha * mean**2
        assert (x >= 0).all() and (x == np.floor(x)).all()
        assert abs(x.mean() - mean) < 6 * np.sqrt(var / n) + 1e-9
        if mean > 0.1:
            assert abs(x.var() / var - 1) < 0.1
    u = counts.uniforms(key, place, 3)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
    k = np.arange(0, 300.0)
    import math
    assert np.allclose(counts.log_factorial(k), [math.lgamma(x + 1) for x in k], rtol=1e-9)


def test_noise_of_a_batch_equals_a_loop_over_its_rows():
    rng = np.random.default_rng(3)
    mu = [rng.lognormal(3, 2, rng.integers(1, 6)) for _ in range(40)] + [np.zeros(0)]
    times = [rng.integers(0, 50, len(m)) for m in mu]
    alpha, keys = rng.uniform(0.001, 5, 41), rng.integers(0, 2**60, 41)
    batch = trajectories.noisy_quantiles(mu, times, alpha, keys, seed=5)
    for i in range(41):
        one = trajectories.noisy_quantiles(mu[i:i + 1], times[i:i + 1], alpha[i:i + 1], keys[i:i + 1], seed=5)
        assert np.array_equal(one[0], batch[i], equal_nan=True)
    values, sizes = rng.normal(size=30), np.array([7, 0, 20, 1, 2])
    got = counts.segment_quantiles(values, sizes, QUANTILE_LEVELS)
    for k, part in enumerate(np.split(values, np.cumsum(sizes)[:-1])):
        assert np.allclose(got[k], np.quantile(part, QUANTILE_LEVELS) if len(part) else np.nan, equal_nan=True)


def _plain_boosting(codes, y, rounds, depth, step):
    """Boosted trees on one machine, node by node, split by split."""
    out = np.full(len(y), y.mean())
    for _ in range(rounds):
        rest, new = y - out, np.zeros(len(y))

        def grow(rows, level):
            mean = rest[rows].mean()
            best = (rest[rows].sum() * mean * (1 + 1e-12) + 1e-12, None)
            for j in range(codes.shape[1]):
                for b in range(codes[rows, j].min(), codes[rows, j].max()):
                    go = codes[rows, j] <= b
                    gain = rest[rows[go]].sum() ** 2 / go.sum() + rest[rows[~go]].sum() ** 2 / (~go).sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (rows[go], rows[~go]))
            if level == depth or best[1] is None:
                new[rows] = mean
            else:
                for part in best[1]:
                    grow(part, level + 1)

        grow(np.arange(len(y)), 0)
        out += step * new
    return out


def test_boosting_all_groups_equals_plain_trees(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in (1, 2):
        x = rng.normal(size=(150, 3))
        x[rng.random((150, 3)) < 0.1] = np.nan
        y = np.nan_to_num(x[:, 0]) ** 2 + (np.nan_to_num(x[:, 1]) > 0.3) * g + rng.normal(0, 0.1, 150)
        rows += [(g, k, *(None if np.isnan(v) else float(v) for v in x[k]), float(y[k])) for k in range(150)]
    features = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "g int, k int, a double, b double, c double, label double")
    cuts = boosting.edges(df, "g", features, 8)
    got = []
    for parts in (1, 6):
        table = session.staged(boosting.coded(df.repartition(parts), "g", features, cuts, ["g", "k", "label"]), "test")
        forest = boosting.fit(table, "g", 3, 9, 4, 3, 0.5)
        got.append({(r.g, r.k): r.centre for r in boosting.predicted(table, forest, "g", 3).collect()})
        codes = {(r["g"], r["k"]): list(r["_codes"]) for r in table.collect()}
    assert got[0] == pytest.approx(got[1])
    again, bins = boosting.from_table(session.staged(boosting.to_table(spark, forest, cuts), "forest"), 3)
    assert {(r.g, r.k): r.centre for r in boosting.predicted(table, again, "g", 3).collect()} == got[1]
    assert all(np.array_equal(a, b) for g in cuts for a, b in zip(cuts[g], bins[g]))
    for g in (1, 2):
        mine = [r for r in rows if r[0] == g]
        matrix = np.array([codes[(g, r[1])] for r in mine])
        assert (matrix.min(), matrix.max()) == (0, 8)
        want = _plain_boosting(matrix, np.array([r[-1] for r in mine]), 4, 3, 0.5)
        assert [got[0][(g, r[1])] for r in mine] == pytest.approx(want.tolist())


def test_models_get_no_week_that_no_fold_may_see(series, folds):
    seen = []

    def spy(known, f):
        seen.append(known.agg(F.max("date")).first()[0])
        return baselines.naive(known, f)

    backtest.run([spy], series, folds)
    assert seen[0] <= max(r.train_cutoff for r in folds.collect()) < series.agg(F.max("date")).first()[0]


def test_causality_finds_a_model_that_looks_ahead(series, folds):
    def peeking(known, f):
        top = known.groupBy("geo").agg(F.max("casos").cast("double").alias("top"))
        return baselines.forecast_columns(fo.target_grid(known.select("geo").distinct(), f).join(top, "geo"), "peeking", F.array_repeat("top", 9))

    rows = backtest.causality([peeking, baselines.seasonal_naive], series, folds).collect()
    assert all((r.changed == r.rows) if r.model == "peeking" else r.changed == 0 for r in rows) and len(rows) == 8


def test_refresh_forecasts_changed_folds_only_and_equals_a_full_run(spark, series, folds, tmp_path):
    models = {"naive": baselines.naive, "seasonal_naive": baselines.seasonal_naive}
    _, first = refresh.refresh(str(tmp_path / "r"), models, series, folds)
    assert len(first) == 8
    assert refresh.refresh(str(tmp_path / "r"), models, series, folds)[1] == []
    target = folds.filter("fold_id = 4").first()
    changed = series.withColumn("casos", F.when(F.col("date") == F.lit(target.target_start), F.col("casos") + 5).otherwise(F.col("casos")))
    stored, again = refresh.refresh(str(tmp_path / "r"), {**models, "climatological_quantile": baselines.climatological}, changed, folds)
    assert sorted(again) == sorted([("naive", 4), ("seasonal_naive", 4), *(("climatological_quantile", i) for i in (1, 2, 3, 4))])
    full = backtest.score(backtest.run([*models.values(), baselines.climatological], changed, folds), changed, folds)
    unit = ["model", "fold_id", "geo", "date"]
    one, two = ({tuple(r[:4]): r.wis for r in df.select(*unit, "wis").collect()} for df in (full, stored))
    assert one == two


def test_a_rewritten_input_is_not_served_from_an_old_hand_off(spark, tmp_path):
    folder = str(tmp_path / "in")
    values = []
    for n in (3, 3, 5):
        if n not in values:
            spark.range(n).write.mode("overwrite").parquet(folder)
        values.append(session.handoff(spark, "test", lambda: spark.read.parquet(folder).agg(F.count("*").alias("n")), source=folder).first().n)
    assert values == [3, 3, 5]


def test_windows_over_a_bucketed_hand_off_plan_no_exchange(spark, series):
    table = session.handoff(spark, "bucketed", lambda: series, bucket_by="geo")
    w = Window.partitionBy("geo").orderBy("date")
    smooth = table.withColumn("before", F.lag("casos").over(w)).groupBy("geo").agg(F.sum("before").alias("n"))
    joined = smooth.join(table.groupBy("geo").agg(F.max("casos").alias("top")).hint("merge"), "geo")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r.geo: r.n for r in smooth.collect()} == {r.geo: r.n for r in series.withColumn("before", F.lag("casos").over(w)).groupBy("geo").agg(F.sum("before").alias("n")).collect()}


def test_the_naive_model_reads_the_shared_series_without_moving_it(spark, sf_dir):
    plan = baselines.naive(inputs.state_series(spark, sf_dir), star.folds(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(geo" not in plan


def test_tracks_are_written_before_forecasters_read_them(spark, series, folds):
    read = []

    def probe(known, folds):
        read.append(known.inputFiles())
        return baselines.naive(known, folds)

    scored = tracks.run_tracks({("d", "x"): series, ("d", "y"): series}, folds, [probe])
    assert read[0] and all("track-series-" in f for f in read[0])
    counts = {(r.level, r.geo): r["count"] for r in scored.groupBy("level", "geo").count().collect()}
    assert len(counts) == 4 and len(set(counts.values())) == 1


def test_populations_of_the_series_geos_and_all_years_give_the_same_forecasts(spark, series, folds):
    own = [(g, y, 1000 + 10 * y) for g in "AB" for y in (1997, 1998)]
    full = spark.createDataFrame([*own, ("C", 1999, 5000)], "geo string, year int, population long")
    few, regions = spark.createDataFrame(own, full.schema), spark.createDataFrame([("A", "r"), ("B", "r")], "uf string, macroregion string")
    models = [lambda p, y: hierarchical.hierarchical(series, folds, p, regions, years=y),
              lambda p, y: trajectories.mechanistic(series, folds, p, draws=50, years=y)]
    for model in models:
        want, found = ([tuple(r) for r in model(*args).orderBy("fold_id", "geo", "date").collect()] for args in ((full, None), (few, full.select("year"))))
        assert want and found == want


def test_a_short_series_has_no_more_buckets_than_its_rows_need(spark, sf_dir):
    rows = inputs.state_series(spark, sf_dir)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 400)
    try:
        many = inputs.state_series(spark, sf_dir)
        assert many.rdd.getNumPartitions() <= -(-rows.count() // session.BUCKET_ROWS)  # 400 before, most of them empty
        assert sorted(many.collect()) == sorted(rows.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_weekly_counts_meet_the_geography_without_moving_again(spark, sf_dir, monkeypatch):
    def moved(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("SortMergeJoin"), sorted(df.collect())

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joins, rows = moved(inputs.state_cases(spark, sf_dir))
        monkeypatch.setattr(star, "MAP_ROWS", 0)
        shuffled, same = moved(inputs.state_cases(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert joins < shuffled and rows == same


def test_both_panels_read_one_written_seasonal_table(spark, sf_dir):
    files = [inputs.state_seasonal(spark, sf_dir).inputFiles() for _ in range(2)]
    assert files[0] == files[1] and not any(f.endswith(("orders.parquet", "customer.parquet")) for f in files[0])
