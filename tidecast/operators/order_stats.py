"""Order statistics: exact quantile vectors, circular week windows and distributed exact quantiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.constants import QUANTILE_LEVELS
from tidecast.session import staged


def quantile_vector(value: Column, levels: list[float] = QUANTILE_LEVELS, weight: Column | int = 1) -> Column:
    """Exact linear-interpolation quantiles, a row counting ``weight`` times; for groups whose size the calendar bounds."""
    return F.percentile(value, levels, weight)


def circular_week_pool(df: DataFrame, lo: int = -3, hi: int = 1, week: str = "epiweek") -> DataFrame:
    """Send each sample to every target week whose window [week+lo, week+hi] (mod 53) contains it."""
    targets = F.array(*[F.pmod(F.col(week) - 1 - offset, F.lit(53)) + 1 for offset in range(lo, hi + 1)])
    return df.withColumn("target_week", F.explode(targets))


def linear_rank(level: Column, n: Column) -> Column:
    """0-based rank of a linearly interpolated quantile."""
    return level * (n - 1)


def conformal_rank(level: Column, n: Column) -> Column:
    """0-based rank of the finite-sample conformal order statistic."""
    return F.least(F.ceil((n + 1) * level).cast("bigint"), n) - 1


class QuantileSet(NamedTuple):
    """Levels wanted of every group of ``keys``, rows counting as often as the column ``weight`` says (once without one)."""

    keys: list[str]
    levels: list[float]
    weight: str | None = None
    name: str = ""


def exact_quantile_sets(df: DataFrame, value: str, sets: list[QuantileSet], rank: Callable[[Column, Column], Column] = linear_rank,
                        parts: int | None = None) -> list[DataFrame]:
    """Exact quantiles for groups of any size and number; one table for each distinct list of keys, in order of appearance.

    A table has the keys, set (the set's name), quantile_level, n (total weight) and the value at that level.

    Values are collapsed to (value, weight), range-partitioned by the keys that all sets have and the value, and written
    once for all sets. A group is cut only where a range ends, so that a big one spreads over many segments and many small
    ones share a range. Segment totals give the rank at which each segment starts; segments that hold a wanted rank are
    ranked value by value. Segments meet their rows by keys and range, never by a broadcast of all groups.
    """
    weights = {s.weight: f"_w{i}" for i, s in enumerate({s.weight: s for s in sets}.values())}
    every = list(dict.fromkeys(k for s in sets for k in s.keys))
    common = [k for k in every if all(k in s.keys for s in sets)]
    v = F.col(value).cast("double")
    total = {name: F.sum(F.lit(1) if w is None else F.col(w)).cast("bigint").alias(name) for w, name in weights.items()}
    counted = df.filter(v.isNotNull()).groupBy(*every, v.alias("_v")).agg(*total.values())
    order = [*common, "_v"]
    ranged = counted.repartitionByRange(parts, *order) if parts else counted.repartitionByRange(*order)
    table = staged(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    tables = []
    for keys in dict.fromkeys(tuple(s.keys) for s in sets):
        mine = [s for s in sets if tuple(s.keys) == keys]
        tables.append(_ranked(table, list(keys), mine, weights, rank).withColumnRenamed("_value", value))
    return tables


def _ranked(table: DataFrame, keys: list[str], sets: list[QuantileSet], weights: dict[str | None, str],
            rank: Callable[[Column, Column], Column]) -> DataFrame:
    used = list(dict.fromkeys(weights[s.weight] for s in sets))
    sizes = table.groupBy(*keys, "_range").agg(*[F.sum(w).alias(w) for w in used])
    group = W.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumns({f"_start{w}": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in used}
                               | {f"_n{w}": F.sum(w).over(group) for w in used})

    def wanted(s: QuantileSet) -> Column:
        w = weights[s.weight]
        n, start = F.col(f"_n{w}"), F.col(f"_start{w}")
        ranks = F.transform(F.array(*[F.lit(float(x)) for x in s.levels]), lambda x: F.struct(
            F.lit(s.name).alias("set"), F.lit(used.index(w)).alias("of"), x.alias("quantile_level"),
            n.alias("n"), rank(x, n).cast("double").alias("rank")))
        inside = F.filter(ranks, lambda x: (F.ceil(x["rank"]) >= start) & (F.floor(x["rank"]) < start + F.col(w)))
        return F.when(n > 0, inside).otherwise(F.slice(ranks, 1, 0))

    held = starts.withColumn("_wanted", F.concat(*[wanted(s) for s in sets])).filter(F.size("_wanted") > 0)
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"),
                       *[f"_start{w}" for w in used], "_wanted")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_at"))
    upto = W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    met = table.join(held, same).withColumns({f"_last{w}": F.col(f"_start{w}") + F.sum(w).over(upto) for w in used})
    last = F.array(*[F.col(f"_last{w}") for w in used])
    size = F.array(*[F.col(w) for w in used])

    def inside(x: Column) -> Column:
        end, n = F.get(last, x["of"]), F.get(size, x["of"])
        return (F.ceil(x["rank"]) >= end - n) & (F.floor(x["rank"]) < end)

    hit = met.select(*keys, "_v", F.inline(F.filter("_wanted", inside)))
    low, high = F.min("_v"), F.max("_v")
    fraction = F.max("rank") - F.floor(F.max("rank"))
    return hit.groupBy(*keys, "set", "quantile_level").agg(F.max("n").alias("n"), (low + (high - low) * fraction).alias("_value"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, levels: list[float],
                    rank: Callable[[Column, Column], Column] = linear_rank, parts: int | None = None) -> DataFrame:
    """keys, quantile_level, n, value at that level: exact, whatever the size and number of the groups."""
    return exact_quantile_sets(df, value, [QuantileSet(keys, levels)], rank, parts)[0].drop("set")


def vectors(quantiles: DataFrame, keys: list[str], value: str, name: str = "q") -> DataFrame:
    """One row per group with its quantiles as an array in order of level."""
    pairs = F.array_sort(F.collect_list(F.struct("quantile_level", value)))
    return quantiles.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias(name))


def array_median(values: Column) -> Column:
    """Median of a short array held in one row."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
