"""Bootstrap intervals with draws from integer arithmetic, so every run and partitioning agrees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.session import staged

PRIME = 2147483647
_PREFIX = 3
#: Units and replicates that are drawn or counted at a time: their product bounds the matrix of counts.
UNITS, REPLICATES = 1 << 14, 100


def _fifth_power(df: DataFrame, name: str) -> DataFrame:
    # x -> x^5 permutes the residues of this prime; staying below 2^62 keeps ANSI mode quiet.
    x = F.col(name)
    df = df.withColumn("_x2", x * x % PRIME)
    df = df.withColumn("_x4", F.col("_x2") * F.col("_x2") % PRIME)
    return df.withColumn(name, F.col("_x4") * F.col(name) % PRIME).drop("_x2", "_x4")


def draw_index(df: DataFrame, first: Column, second: Column, size: Column, seed: int = 42,
               name: str = "draw") -> DataFrame:
    """Add a pseudo-random index in [0, size) that depends only on (seed, first, second)."""
    start = (first * 48271 + second * 69621 + F.lit(seed).cast("bigint") * 16807) % PRIME
    df = _fifth_power(df.withColumn(name, start.cast("bigint")), name)
    df = df.withColumn(name, (F.col(name) * 48271 + first * 7919 + 12345) % PRIME)
    return _fifth_power(df, name).withColumn(name, F.col(name) % size)


def draw_index_sql(first: str, second: str, size: str, seed: int = 42) -> str:
    """The same arithmetic as a nested SQL expression over two BIGINT columns."""

    def fifth(x: str) -> str:
        return f"(((({x}) * ({x}) % {PRIME}) * (({x}) * ({x}) % {PRIME}) % {PRIME}) * ({x}) % {PRIME})"

    start = f"({first} * 48271 + {second} * 69621 + {seed * 16807}) % {PRIME}"
    return f"{fifth(f'({fifth(start)} * 48271 + {first} * 7919 + 12345) % {PRIME}')} % {size}"


def number_units(units: DataFrame, key: Column) -> DataFrame:
    """0-based number ``unit_no`` in order of the key's MD5, and the total ``n_units``.

    A single global window would pull every unit into one task. The MD5 prefix splits the units into
    4096 even buckets: numbers run within each bucket and start where the buckets before it end.
    """
    hashed = units.withColumn("_md5", F.md5(key.cast("string")))
    hashed = hashed.withColumn("_bucket", F.substring("_md5", 1, _PREFIX))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n_units"),
    )
    within = F.row_number().over(W.partitionBy("_bucket").orderBy("_md5"))
    numbered = hashed.join(F.broadcast(starts), "_bucket")
    return numbered.withColumn("unit_no", F.col("_start") + within - 1).drop("_md5", "_bucket", "_start")


def draws(units: np.ndarray, reps: np.ndarray, size: int, seed: int = 42) -> np.ndarray:
    """Indices in [0, size) for every (rep, unit), by the arithmetic of ``draw_index``."""

    def fifth(x: np.ndarray) -> np.ndarray:
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    first, second = reps[:, None], units[None, :]
    x = fifth((first * 48271 + second * 69621 + seed * 16807) % PRIME)
    return fifth((x * 48271 + first * 7919 + 12345) % PRIME) % size


def _drawn(size: int, replicates: int, seed: int):
    """Draws of a task's units, some units and replicates at a time: for each block of drawn units their sorted places, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = REPLICATES * UNITS
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), UNITS):
                for low in range(0, replicates, REPLICATES):
                    reps = np.arange(low, min(replicates, low + REPLICATES), dtype=np.int64)
                    block, place = np.divmod(draws(own[at:at + UNITS], reps, size, seed), UNITS)
                    codes = np.sort((block * cell + np.arange(len(reps))[:, None] * UNITS + place).ravel())
                    cuts = np.flatnonzero(np.diff(codes // cell, prepend=-1))
                    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(codes)]):
                        steps = np.diff(codes[x:y] % cell, prepend=0).astype(np.uint32)
                        yield pa.RecordBatch.from_arrays([pa.array([codes[x] // cell], pa.int64()), pa.array([low], pa.int64()), pa.array([zlib.compress(steps.tobytes(), 1)])],
                                                         names=["block", "low", "places"])

    return run


def _sums(replicates: int, groups: list[str], values: list[str]):
    """One block of units: how often each was drawn, times its values, summed per replicate and group."""

    def run(drawn: pa.Table, units: pa.Table) -> pa.Table:
        place = units.column("unit_no").to_numpy() % UNITS
        v = np.stack([units.column(c).to_numpy().astype(float) for c in values], axis=1)
        named = list(zip(*[units.column(g).to_pylist() for g in groups])) if groups else [()] * len(units)
        distinct = list(dict.fromkeys(named))
        of = np.array([distinct.index(x) for x in named], np.int64)
        lows = drawn.column("low").to_numpy()
        rows: dict[str, list] = {c: [] for c in ("rep", *groups, *values)}
        for low in np.unique(lows).tolist():
            counts = np.zeros(REPLICATES * UNITS, np.int64)
            for i in np.flatnonzero(lows == low).tolist():
                steps = np.frombuffer(zlib.decompress(drawn.column("places")[i].as_py()), np.uint32)
                counts += np.bincount(np.cumsum(steps, dtype=np.int64), minlength=len(counts))
            counts = counts.reshape(REPLICATES, UNITS)[: replicates - low]
            for g, names in enumerate(distinct):
                sums = counts[:, place[of == g]] @ v[of == g]
                rows["rep"] += range(low, low + len(counts))
                for c, x in zip(groups, names):
                    rows[c] += [x] * len(counts)
                for j, c in enumerate(values):
                    rows[c] += sums[:, j].tolist()
        kinds = {"rep": pa.int64(), **dict.fromkeys(groups, pa.string()), **dict.fromkeys(values, pa.float64())}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in rows.items()})

    return run


def replicate_sums(units: DataFrame, size: int, groups: list[str], values: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """rep, groups and the sums of ``values`` over the units drawn in each replicate, with replacement.

    ``units`` has unit_no (0 to size - 1), string columns ``groups`` and ``values``; a unit may have one row per group. Every
    unit makes one draw per replicate. Draws travel in arrays: a task draws for UNITS units and REPLICATES replicates at a
    time and sends each block of units the places drawn in it, sorted and packed in a byte or two each. There they become
    a matrix of counts that is multiplied with the block's values, so no row is made per unit and replicate, and no draw
    is joined.
    """
    owners = units.select("unit_no").distinct()
    drawn = owners.mapInArrow(_drawn(size, replicates, seed), "block long, low long, places binary")
    blocked = units.select(F.floor(F.col("unit_no") / UNITS).cast("long").alias("block"), "unit_no", *groups, *[F.col(v).cast("double").alias(v) for v in values])
    schema = ", ".join(["rep long", *[f"{g} string" for g in groups], *[f"{v} double" for v in values]])
    parts = drawn.groupBy("block").cogroup(blocked.groupBy("block")).applyInArrow(_sums(replicates, groups, values), schema)
    return parts.groupBy("rep", *groups).agg(*[F.sum(v).alias(v) for v in values])


def _interval(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    # One row per replicate and model goes in, so each group has `replicates` values.
    bounds = [F.percentile(n, [0.025, 0.975]).alias(n) for n in names]
    out = df.groupBy(*by).agg(*bounds) if by else df.agg(*bounds)
    cols = []
    for n in names:
        cols += [F.col(n)[0].alias(f"{n}_low"), F.col(n)[1].alias(f"{n}_high")]
    return out.select(*by, *cols)


def block_bootstrap(scored: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """95% interval of mean and normalized score per model, resampling whole (geo, fold) blocks.

    Blocks are summed before anything is drawn, so a replicate moves one row per block, not per unit.
    """
    block = F.concat_ws("_", F.col("geo"), F.col("fold_id").cast("string"))
    sums = scored.withColumn("block", block).groupBy("block", "model").agg(
        F.sum("wis").alias("s"), F.sum("observed_value").cast("double").alias("o"), F.count("*").alias("n")
    )
    numbered = number_units(sums.select("block").distinct(), F.col("block"))
    keyed = staged(sums.join(numbered, "block"), "blocks")
    size = keyed.agg(F.coalesce(F.max("n_units"), F.lit(0))).first()[0]
    drawn = replicate_sums(keyed, size, ["model"], ["s", "o", "n"], replicates, seed)
    per_rep = drawn.filter("n > 0").select("model", F.try_divide("s", "n").alias("wis"), F.try_divide("s", "o").alias("nwis"))
    return _interval(per_rep, ["model"], ["wis", "nwis"])


def paired_bootstrap(scored: DataFrame, first: str, second: str, folds: list[int] | None = None,
                     replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Mean difference first - second over common units with its 95% bootstrap interval."""
    kept = scored.filter(F.col("model").isin(first, second))
    if folds:
        kept = kept.filter(F.col("fold_id").isin(*folds))
    wide = kept.groupBy("geo", "fold_id", "horizon_weeks").pivot("model", [first, second]).agg(F.avg("wis"))
    pairs = wide.dropna(subset=[first, second]).select(
        F.concat_ws("_", F.col("geo"), F.col("fold_id"), F.col("horizon_weeks")).alias("unit"),
        (F.col(first) - F.col(second)).alias("gap"),
    )
    numbered = staged(number_units(pairs, F.col("unit")), "units")
    size = numbered.agg(F.count("*")).first()[0]
    sums = replicate_sums(numbered.withColumn("one", F.lit(1.0)), size, [], ["gap", "one"], replicates, seed)
    means = sums.select("rep", F.try_divide("gap", "one").alias("difference"))
    centre = pairs.agg(F.avg("gap").alias("mean_difference"), F.count("*").alias("units"))
    return centre.join(F.broadcast(_interval(means, [], ["difference"]))).withColumns({
        "model_a": F.lit(first), "model_b": F.lit(second),
    })
