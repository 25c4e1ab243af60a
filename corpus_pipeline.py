"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next one.

1. language: documents whose text holds no letter, so that no language can be told (``und``), go; so do those of which
   the network is much less sure than of the documents it could learn from: below ``SURE`` times the score that all but
   ``RARE`` of these reach.
2. exact: of equal texts the one with the largest id stays.
3. near: of each group of texts linked by a similarity of 0.8 or more on five-word shingles the document with the
   smallest id stays.
4. benchmark: documents that hold a passage of a benchmark item go.
5. mix: the remaining documents in training order, once for each time the mix takes them, with their position and the
   words taken (mix_position, mix_words).

Every stage works on all rows that the one before kept and returns their columns unchanged, whatever further columns
there are; the last one adds two. Nulls, empty texts, repeated rows and empty tables: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import decontaminate, exact_dedup, language_id, mixing, similar, simhash
from tidecast.llm.common import row_id, table, without, written

#: A text whose score is below SURE times the RARE quantile of learnable documents' scores is in none of the languages.
RARE, SURE = 0.0001, 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(language_id.identify(docs), "languages")
    low = found.where("learnable").agg(F.percentile_approx("score", RARE, 100_000)).first()[0]
    rejected = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < SURE * (low or 0.0))
    bad = found.where(rejected).select(row_id().alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    return without(docs, bad)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_rows(docs, exact_dedup.decide(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, similar.judge(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, decontaminate.judge(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_training_order(docs, mixing.mix(docs))


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: SQL can express neither a trained network nor reachability over fingerprints within reason; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
