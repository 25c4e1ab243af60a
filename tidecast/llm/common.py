"""What the training-data operators share: tables, written hand-offs, row keys and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.session import new_path

#: Stands for a null id where rows are matched by id, so that rows without one are matched too.
NULL_ID = -(2**63)

ID = "_llm_id"

#: Rows of a few numbers or digests each that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a lost executor re-reads files, nothing is recomputed."""
    spark = df.sparkSession
    path = new_path(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_id(column: str = "doc_id") -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID).cast("long"))


def shown_id(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != F.lit(NULL_ID).cast("long"), column)


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest_of(column: str = "text") -> Column:
    """SHA-256 of the whole text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text_of(column).cast("binary"), 256))


def fold_of(folds: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def few(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``bound`` rows; joined by shuffle beyond it."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without those of ``gone`` (id, digest) and with one each of ``repeated`` (id, digest).

    Texts are shuffled only where they are repeated, as long as ``gone`` and ``repeated`` are few enough to broadcast.
    """
    def named(df: DataFrame) -> DataFrame:
        return few(df.select(F.col("id").alias("_llm_at"), F.col("digest").alias("_llm_sha")))

    keyed = docs.select("*", row_id().alias(ID), digest_of().alias("_llm_digest"))
    same = (F.col(ID) == F.col("_llm_at")) & (F.col("_llm_digest") == F.col("_llm_sha"))
    left = keyed.join(named(gone), same, "left_anti")
    if repeated is not None and repeated.limit(1).count():
        left = left.join(named(repeated), same, "left_anti").unionAll(left.join(named(repeated), same, "left_semi").dropDuplicates([ID, "_llm_digest"]))
    return left.drop(ID, "_llm_digest")


def power_of_two(n: float) -> int:
    """The exponent of the least power of two that is not below n."""
    return max(0, (max(1, int(-(-n // 1))) - 1).bit_length())


def drawn(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hashes of ``key``, however the rows are dealt out.

    A filter leaves about twice as many, so that few rows are sorted.
    """
    rows = df.count()
    rank = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(2**31))
    some = df if rows <= 2 * limit else df.where(rank < int(2**31 * 2 * limit / rows))
    return some.orderBy(rank, key).limit(limit)
