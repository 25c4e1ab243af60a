"""Toxicity by non-negative positive-unlabelled learning.

Numpy classifiers learn from confirmed toxic documents (positives) and unlabelled text. The risk is the class-prior
corrected estimator  prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])  with the logistic loss; where the
bracket is negative, its own ascent step is taken. The prior is the toxic share among the rows to learn from. Each of
``MODELS`` classifiers sees another half of the unlabelled sample; a score is their mean probability.

A document is the set of its words (letters and characters beyond ASCII, A-Z lower-cased), each told by its CRC-32; a
model weighs words that occur in at least ``SEEN`` positives, in a share of them that is at least ``ERRORS`` standard
errors away from the unlabelled share. Whole texts are read. The sample is bounded: ``POSITIVES``
and ``UNLABELLED`` documents. Labels of rows with crc32(doc_id) mod 5 = 0 are not used.

Words are counted among positives and unlabelled documents and chosen by Spark; the driver gets the chosen words and which
of them each sampled document has. The sample is drawn in order of a hash, so that it doesn't depend on how rows are dealt.

Defined cases: a null or empty text has no words and gets the score of none; without a toxic row to learn from the
score is the prior (0 without labels); a null label is none; several labels of an id count as toxic if one is; equal rows
get equal scores; a very long text is read whole; an empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import drawn, fold_of, written

#: Documents learned from at most; positives that a word must occur in, and how its share must differ; classifiers.
POSITIVES, UNLABELLED, SEEN, ERRORS, MODELS = 3000, 6000, 5, 4.0, 3
STEPS, RATE, DECAY = 400, 0.1, 5e-5
FOLDS, HELD_OUT = 5, 0
_LETTERS = bytes(c if chr(c).islower() and c < 128 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> np.ndarray:
    """CRC-32 of each distinct word, ascending."""
    distinct = set(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    return np.unique(np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["positive", "words"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], float]:
    """Chosen words, their places in each positive and each unlabelled document, and the class prior."""
    usable = (labels.where(F.col("toxic").isNotNull() & (fold_of(FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("_llm_key"))
              .agg(F.max("toxic").alias("toxic")))
    counts = usable.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    prior = (counts["k"] or 0) / max(1, counts["n"])
    positives = drawn(usable.where("toxic = 1").select("_llm_key"), F.col("_llm_key"), POSITIVES)
    light = docs.where(fold_of(FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("_llm_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    others = drawn(light.select("_llm_key"), F.col("_llm_key"), UNLABELLED).distinct()
    # both lists of ids are bounded by the sample
    parts = [light.join(F.broadcast(ids), "_llm_key").select(F.lit(flag).alias("positive"), "text").mapInArrow(_word_sets, "positive boolean, words array<long>")
             .orderBy("words").limit(most) for flag, ids, most in ((True, positives, 2 * POSITIVES), (False, others, UNLABELLED))]
    sets = written(parts[0].unionByName(parts[1]).withColumn("doc", F.monotonically_increasing_id()), "words")
    n, k = (sets.where(c).count() for c in ("positive", "not positive"))
    each = sets.select("doc", "positive", F.explode("words").alias("word"))
    seen, elsewhere = (F.sum(F.col("positive").cast("long") if p else (~F.col("positive")).cast("long")) for p in (True, False))
    told = each.groupBy("word").agg(seen.alias("seen"), elsewhere.alias("elsewhere")).where(F.col("seen") >= SEEN)
    share = (F.col("seen") + F.col("elsewhere")) / F.lit(float(n + k))
    gap = F.abs(F.col("seen") / F.lit(float(max(1, n))) - F.col("elsewhere") / F.lit(float(max(1, k))))
    apart = gap / F.sqrt(share * (1 - share) * F.lit(1 / max(1, n) + 1 / max(1, k)) + F.lit(1e-12))
    words = np.array(sorted(r["word"] for r in told.where(apart >= ERRORS).select("word").collect()), np.int64)
    chosen = docs.sparkSession.createDataFrame([(int(w), i) for i, w in enumerate(words)], "word long, place int")
    held = each.join(F.broadcast(chosen), "word").groupBy("doc", "positive").agg(F.array_sort(F.collect_list("place")).alias("places")).collect()
    rows = sorted((r["positive"], list(r["places"])) for r in held)
    found = {flag: [np.array(x, np.int64) for p, x in rows if p == flag] for flag in (True, False)}
    for flag, size in ((True, n), (False, k)):
        found[flag] += [np.zeros(0, np.int64)] * (size - len(found[flag]))
    return words, found[True], found[False], prior


def fit(words: np.ndarray, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, models: int = MODELS, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Linear classifiers as (word hashes ascending, weights, bias) from the places of words in documents."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(models):
        half = rng.permutation(len(unlabelled))[: max(1, len(unlabelled) // 2)] if len(unlabelled) > 1 else np.arange(len(unlabelled))
        docs = [*positives, *(unlabelled[i] for i in half)]
        pos, unl = len(positives), max(1, len(half))
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        slot = np.concatenate([*docs, np.zeros(0, np.int64)])
        w, b = np.zeros(len(words)), float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
        m, s = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        for step in range(1, STEPS + 1):
            g = np.clip(np.bincount(owner, w[slot], len(docs)) + b, -30, 30)
            p = 1 / (1 + np.exp(-g))
            soft = np.log1p(np.exp(g))  # loss of g as a negative; softplus(-g) that of a positive
            negative = soft[pos:].sum() / unl - prior * soft[:pos].mean()
            as_negative = np.r_[-prior * p[:pos] / pos, p[pos:] / unl]
            if negative >= 0:
                d = as_negative.copy()
                d[:pos] += prior * (p[:pos] - 1) / pos
            else:
                d = -as_negative
            grad = np.r_[np.bincount(slot, d[owner], len(words)) + DECAY * w, d.sum()]
            m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
            change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            w, b = w - change[:-1], b - change[-1]
        out.append((words, w, float(b)))
    return out


def probability(models: list[tuple[np.ndarray, np.ndarray, float]], prior: float, texts: list[str]) -> np.ndarray:
    if not models:
        return np.full(len(texts), prior)
    sets = [words_of(t).astype(np.int64) for t in texts]
    owner, flat = np.repeat(np.arange(len(texts)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.int64)])
    total = np.zeros(len(texts))
    for words, w, b in models:
        slot = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
        hit = words[slot] == flat if len(words) else np.zeros(len(flat), bool)
        total += 1 / (1 + np.exp(-np.clip(np.bincount(owner[hit], w[slot[hit]], len(texts)) + b, -30, 30)))
    return total / len(models)


def _score(models, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [probability(models, prior, batch.column(1).slice(at, 256).to_pylist()) for at in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.zeros(0)]))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), from ``labels`` (doc_id, toxic): doc_id, held_out, score, predicted."""
    words, positives, unlabelled, prior = sample(docs, labels)
    models = fit(words, positives, unlabelled, prior) if positives else []
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = light.mapInArrow(_score(models, prior), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold_of(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
