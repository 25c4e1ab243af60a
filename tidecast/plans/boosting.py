"""Gradient-boosted trees for many groups in one fit: every pass over the rows serves all groups.

Features are cut into bins by each group's own quantiles and every row carries its bins as one byte each. A level of a
tree is one pass: tasks sum residuals and rows per (group, node, feature, bin) and send one histogram a node, which are
added and searched for the best split where they meet. Only splits come to the driver: groups x nodes rows. Trees are
small and travel with the next pass, which computes the residuals from them, so rows are written once and never updated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODES = "_codes"


@dataclass
class Tree:
    """A complete binary tree: at node i rows of bin above ``bins[i]`` of feature ``features[i]`` go right, to 2 i + 2."""

    features: np.ndarray
    bins: np.ndarray
    leaves: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        inner = 2**depth - 1
        return cls(np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(inner + 1))

    def nodes(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        node, row = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            node = 2 * node + 1 + (codes[row, self.features[node]] > self.bins[node])
        return node

    def values(self, codes: np.ndarray) -> np.ndarray:
        depth = len(self.leaves).bit_length() - 1
        return self.leaves[self.nodes(codes, depth) - len(self.bins)]


@dataclass
class Forest:
    """Trees by group, on top of the group's mean."""

    start: dict[int, float]
    step: float
    trees: dict[int, list[Tree]] = field(default_factory=dict)

    def predict(self, group: int, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.start.get(group, 0.0))
        for tree in self.trees.get(group, []):
            out += self.step * tree.values(codes)
        return out


def to_table(spark: SparkSession, forest: Forest, cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """A fitted forest and its bins as rows (kind, group, tree, node, feature, value); trees and groups are few."""
    rows = [("step", 0, 0, 0, 0, float(forest.step))]
    rows += [("start", int(g), 0, 0, 0, float(v)) for g, v in forest.start.items()]
    for g, features in cuts.items():
        rows += [("edge", int(g), 0, k, j, float(v)) for j, cut in enumerate(features) for k, v in enumerate(cut)]
    for g, trees in forest.trees.items():
        for t, tree in enumerate(trees):
            rows += [("split", int(g), t, k, int(j), float(b)) for k, (j, b) in enumerate(zip(tree.features, tree.bins))]
            rows += [("leaf", int(g), t, k, 0, float(v)) for k, v in enumerate(tree.leaves)]
    return spark.createDataFrame(rows, "kind string, group int, tree int, node int, feature int, value double")


def from_table(table: DataFrame, width: int) -> tuple[Forest, dict[int, list[np.ndarray]]]:
    """The forest and bins that ``to_table`` wrote."""
    rows = sorted(tuple(r) for r in table.collect())
    of = {kind: [r[1:] for r in rows if r[0] == kind] for kind in ("step", "start", "edge", "split", "leaf")}
    forest = Forest({g: v for g, _, _, _, v in of["start"]}, of["step"][0][-1])
    cuts = {g: [np.array([v for h, _, _, j, v in of["edge"] if (h, j) == (g, k)]) for k in range(width)] for g in forest.start}
    for g in forest.start:
        count = max((t + 1 for h, t, *_ in of["leaf"] if h == g), default=0)
        forest.trees[g] = [Tree(np.array([j for h, u, _, j, _ in of["split"] if (h, u) == (g, t)], np.int64),
                                np.array([int(b) for h, u, _, _, b in of["split"] if (h, u) == (g, t)], np.int64),
                                np.array([v for h, u, _, _, v in of["leaf"] if (h, u) == (g, t)])) for t in range(count)]
    return forest, cuts


def edges(df: DataFrame, group: str, features: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Per group and feature the distinct quantiles between bins; groups x features x bins numbers."""
    levels = [k / bins for k in range(1, bins)]
    rows = df.groupBy(group).agg(*[F.percentile_approx(F.col(c).cast("double"), levels).alias(c) for c in features]).collect()
    return {r[group]: [np.unique(np.array(r[c] or [], float)) for c in features] for r in rows}


def coded(df: DataFrame, group: str, features: list[str], cuts: dict[int, list[np.ndarray]], keep: list[str]) -> DataFrame:
    """``keep`` (which has the group) and the bins of all features as bytes; missing values are bin 0, below all others."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(_CODES, T.BinaryType())])
    at = keep.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(at).to_numpy()
            x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(groups), len(features))
            codes = np.zeros(x.shape, np.uint8)
            for g in np.unique(groups):
                mine = groups == g
                for j, cut in enumerate(cuts.get(int(g), [np.zeros(0)] * len(features))):
                    codes[mine, j] = np.searchsorted(cut, x[mine, j]) + 1
            codes[np.isnan(x)] = 0
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), len(groups), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], packed.cast(pa.binary())], names=[*keep, _CODES])

    values = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(*keep, values.alias("_x")).mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(column.cast(pa.binary(width)).buffers()[1], np.uint8, len(column) * width, column.offset * width).reshape(-1, width)


def best_split(sums: np.ndarray, rows: np.ndarray) -> tuple[int, int, float, float]:
    """(feature, bin, left mean, right mean) of least squared error from sums and rows by feature and bin; bin 255 is no split."""
    left_n, left = np.cumsum(rows, axis=1)[:, :-1], np.cumsum(sums, axis=1)[:, :-1]
    total_n, total = rows[0].sum(), sums[0].sum()
    right_n, right = total_n - left_n, total - left
    good = (left_n > 0) & (right_n > 0)
    gain = np.where(good, left**2 / np.maximum(left_n, 1) + right**2 / np.maximum(right_n, 1), -np.inf)
    mean = total / max(total_n, 1)
    at = int(np.argmax(gain))
    if not good.any() or gain.flat[at] <= total * mean * (1 + 1e-12) + 1e-12:
        return 0, 255, mean, mean
    j, b = divmod(at, gain.shape[1])
    return j, b, left[j, b] / left_n[j, b], right[j, b] / right_n[j, b]


def histograms(codes: np.ndarray, residual: np.ndarray, node: np.ndarray, nodes: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of residuals and rows as (node, feature, bin)."""
    width = codes.shape[1]
    sums, rows = np.empty((nodes, width, bins)), np.empty((nodes, width, bins))
    base = node * bins
    for j in range(width):
        place = base + codes[:, j]
        sums[:, j] = np.bincount(place, residual, nodes * bins).reshape(nodes, bins)
        rows[:, j] = np.bincount(place, minlength=nodes * bins).reshape(nodes, bins)
    return sums, rows


def _level(forest: Forest, growing: dict[int, Tree], level: int, width: int, bins: int):
    first, nodes = 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            groups, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes = _matrix(batch.column(2), width)
            for g in map(int, np.unique(groups)):
                mine = slice(None) if len(np.unique(groups)) == 1 else groups == g
                own = codes[mine]
                found = histograms(own, label[mine] - forest.predict(g, own), growing[g].nodes(own, level) - first, nodes, bins)
                if g in totals:
                    totals[g][0] += found[0]
                    totals[g][1] += found[1]
                else:
                    totals[g] = list(found)
        for g, (sums, rows) in totals.items():
            for k in np.flatnonzero(rows[:, 0].sum(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([int(k)], pa.int64()), pa.array([sums[k].tobytes()]), pa.array([rows[k].tobytes()])],
                                                 names=["g", "node", "sums", "rows"])

    def best(parts: pa.Table) -> pa.Table:
        sums, rows = (np.sum([np.frombuffer(x, float) for x in parts.column(c).to_pylist()], axis=0).reshape(width, bins) for c in ("sums", "rows"))
        j, b, left, right = best_split(sums, rows)
        return pa.table({"g": parts.column("g")[:1], "node": parts.column("node")[:1], "feature": pa.array([j], pa.int64()), "bin": pa.array([b], pa.int64()),
                         "left": pa.array([float(left)]), "right": pa.array([float(right)])})

    return run, best


def fit(rows: DataFrame, group: str, width: int, bins: int, rounds: int, depth: int, step: float, label: str = "label") -> Forest:
    """Boost squared error on rows with bins (a written table: there are ``rounds`` x ``depth`` passes over it)."""
    read = rows.select(F.col(group).cast("long").alias("g"), F.col(label).cast("double").alias("y"), _CODES)
    starts = {r["g"]: r["m"] for r in read.groupBy("g").agg(F.avg("y").alias("m")).collect()}
    forest = Forest(starts, step, {g: [] for g in starts})
    for _ in range(rounds):
        growing = {g: Tree.stump(depth) for g in starts}
        for level in range(depth):
            run, best = _level(forest, growing, level, width, bins)
            sent = read.mapInArrow(run, "g long, node long, sums binary, rows binary")
            splits = sent.groupBy("g", "node").applyInArrow(best, "g long, node long, feature long, bin long, left double, right double").collect()
            for r in splits:
                tree, at = growing[r["g"]], 2**level - 1 + r["node"]
                tree.features[at], tree.bins[at] = r["feature"], r["bin"]
                if level == depth - 1:
                    tree.leaves[2 * r["node"]: 2 * r["node"] + 2] = r["left"], r["right"]
        for g, tree in growing.items():
            forest.trees[g].append(tree)
    return forest


def predicted(df: DataFrame, forest: Forest, group: str, width: int, name: str = "centre") -> DataFrame:
    """``df`` (with bins) and the forest's prediction in place of the bins."""
    keep = [c for c in df.columns if c != _CODES]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())])
    at = keep.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, codes = batch.column(at).to_numpy(), _matrix(batch.column(len(keep)), width)
            out = np.zeros(len(groups))
            for g in np.unique(groups):
                out[groups == g] = forest.predict(int(g), codes[groups == g])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], names=[*keep, name])

    return df.select(*keep, _CODES).mapInArrow(run, schema)
