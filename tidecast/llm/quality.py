"""Quality by a generalised additive model with pairwise interactions.

Surface features of a text are cut into bins. Cyclic boosting visits one feature after another, fits a shallow tree (two
levels of splits) on the bins to the gradient of the log loss and adds a small step of it to the feature's lookup table.
Then the pairs that still explain most get tables of their own, built from trees with one split on either side. A score
is the sum of table entries, added for a whole batch at a time.

The sample is bounded: ``SAMPLE`` labelled documents, whole texts. Labels of rows with crc32(doc_id) mod 3 = 1 are not used.

Defined cases: a null text is empty, with all features zero; without labels the score is 0.5, with one class only it is
near that class; a null label is none; of several labels of an id the largest counts; equal rows get equal scores; a very
long text is read whole; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import drawn, fold_of

#: Labelled documents learned from at most.
SAMPLE = 20_000
#: Bins of a feature and of a side of a pair, rounds of either phase, pairs, step, least hessian of a leaf.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, STEP, LEAST = 48, 12, 150, 80, 10, 0.1, 1.0
FOLDS, HELD_OUT = 3, 1
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "spaces", "newlines", "sentence_marks", "symbols", "beyond_ascii",
         "distinct_words", "repeats", "marked_words", "distinct_lines", "line_words")

_CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?!'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASSES[list(_set)] = _k
_CLASSES[128:] = 7


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(NAMES)
    share = np.bincount(_CLASSES, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 8) / len(data)
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x]
    marked = sum(x[-1] in b"#$%&*!|" for x in words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [np.log1p(len(data)), np.log1p(len(words)), len(data) / n, *share[1:8], len(set(words)) / n, same / n, marked / n,
            len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))]


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    usable = (labels.where(F.col("quality").isNotNull() & (fold_of(FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("_llm_key"))
              .agg(F.max("quality").cast("int").alias("label")))
    chosen = drawn(usable, F.col("_llm_key"), limit)
    light = docs.select(F.col("doc_id").cast("long").alias("_llm_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = light.join(F.broadcast(chosen), "_llm_key").select("label", "text")  # bounded by ``limit``
    table = found.mapInArrow(_featured, "label int, x array<double>").orderBy("label", "x").limit(2 * limit).toArrow()
    rows = sorted(zip(table.column("label").to_pylist(), table.column("x").to_pylist()))
    return np.array([x for _, x in rows], np.float64).reshape(-1, len(NAMES)), np.array([y for y, _ in rows], np.float64)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The cut of a row of bins that gains most: (bins on the left, gain); 0 where none does."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= LEAST) & (hr >= LEAST), gl * gl / (hl + 1) + gr * gr / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    at = int(gain.argmax())
    return (at + 1, float(gain[at])) if gain[at] > 1e-9 else (0, 0.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree of ``depth`` levels on one feature."""
    cut = _best_cut(g, h)[0] if depth else 0
    if cut:
        return np.r_[shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)]
    return np.full(len(g), -g.sum() / (h.sum() + 1))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of the best tree with one split on either side of a pair, and its gain."""
    best, gain = np.zeros_like(g), 0.0
    cg, ch = (np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0))) for a in (g, h))
    n, m = g.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    total = np.zeros(i.shape)
    parts = []
    for a0, a1 in ((0 * i, i), (i, 0 * i + n)):
        for b0, b1 in ((0 * j, j), (j, 0 * j + m)):
            sg, sh = (c[a1, b1] - c[a0, b1] - c[a1, b0] + c[a0, b0] for c in (cg, ch))
            total += sg * sg / (sh + 1)
            parts.append((a0, a1, b0, b1, -sg / (sh + 1)))
    if total.size:
        at = np.unravel_index(int(total.argmax()), total.shape)
        gain = float(total[at] - g.sum() ** 2 / (h.sum() + 1))
        for a0, a1, b0, b1, value in parts:
            best[a0[at]:a1[at], b0[at]:b1[at]] = value[at]
    return best, gain


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Edges of the bins, tables and pair tables; deterministic."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    fine = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    f = np.full(len(y), start)
    for _ in range(ROUNDS):
        for k, bins in enumerate(fine):
            p = 1 / (1 + np.exp(-f))
            tree = STEP * shallow_tree(np.bincount(bins, p - y, len(tables[k])), np.bincount(bins, p * (1 - p), len(tables[k])))
            tables[k] += tree
            f += tree[bins]
    p = 1 / (1 + np.exp(-f))
    ranked, shapes = [], [len(e) + 1 for e in coarse]

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * shapes[b] + rough[b], values, shapes[a] * shapes[b]).reshape(shapes[a], shapes[b])

    for a in range(len(NAMES)):
        for b in range(a + 1, len(NAMES)):
            ranked.append((-_quadrants(cells(a, b, p - y), cells(a, b, p * (1 - p)))[1], a, b))
    pairs = {(a, b): np.zeros((shapes[a], shapes[b])) for _, a, b in sorted(ranked)[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in pairs.items():
            p = 1 / (1 + np.exp(-f))
            tree = STEP * _quadrants(cells(a, b, p - y), cells(a, b, p * (1 - p)))[0]
            table += tree
            f += tree[rough[a], rough[b]]
    return {"start": start, "edges": edges, "coarse": coarse, "tables": tables, "pairs": pairs}


def probability(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Scores of a batch of feature rows: one lookup and addition per table."""
    if model is None:
        return np.full(len(x), 0.5)
    f = np.full(len(x), model["start"])
    for k, table in enumerate(model["tables"]):
        f += table[np.searchsorted(model["edges"][k], x[:, k], "right")]
    for (a, b), table in model["pairs"].items():
        f += table[np.searchsorted(model["coarse"][a], x[:, a], "right"), np.searchsorted(model["coarse"][b], x[:, b], "right")]
    return 1 / (1 + np.exp(-f))


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_matrix(batch.column(1).slice(at, 512).to_pylist()) for at in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(model, np.concatenate([np.zeros((0, len(NAMES))), *x])))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), from ``labels`` (doc_id, quality): doc_id, held_out, score, predicted."""
    x, y = sample(docs, labels)
    model = fit(x, y) if len(y) else None
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = light.mapInArrow(_score(model), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold_of(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
