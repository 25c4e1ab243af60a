"""Landing raw tables as Parquet, build-or-read tables and file fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 8 << 20


def land(df: DataFrame, path: str, date_column: str) -> None:
    """Write a raw table as Parquet by year, so that cut-off filters prune whole folders.

    Rebalancing sends a year's rows together but lets Spark split a large year over many writer tasks
    and merge small ones, so file sizes stay even however the rows are spread.
    """
    dated = df.withColumn("year", F.year(date_column))
    dated.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def build_or_read(spark: SparkSession, root: str, name: str, inputs_key: str,
                  build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``root/name-inputs_key`` when it was written in full before, else build and write it.

    ``inputs_key`` is the fingerprint of the inputs, so changed inputs lead to a new table.
    """
    path = f"{root}/{name}-{inputs_key}"
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _stream_digest(paths: pd.Series) -> pd.Series:
    from pyarrow import fs

    def one(path: str) -> str:
        filesystem, name = fs.FileSystem.from_uri(path)
        digest = hashlib.sha256()
        with filesystem.open_input_stream(name) as stream:
            while chunk := stream.read(_CHUNK):
                digest.update(chunk)
        return digest.hexdigest()

    return paths.map(one)


def file_fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Name, size and SHA-256 of every file.

    Only path and length are taken from the scan (file contents are pruned away); each task then
    streams its files in chunks, so a file never has to fit in memory.
    """
    digest = F.pandas_udf(_stream_digest, "string")
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .select("path", F.col("length").alias("bytes"))
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "bytes",
        digest(F.regexp_replace("path", "^file:/+", "file:///")).alias("sha256"),
    )


def listing_fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Hash of name, size and time of every file: tells changed inputs without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    entry = F.concat_ws("|", F.element_at(F.split("path", "/"), -1), "length", F.unix_micros("modificationTime"))
    return files.select(F.sha2(entry, 256).alias("sha256"))


def combined_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over all file hashes in ascending order, first 16 hex digits.

    The digest is sequential by definition, so the sorted hashes (64 bytes a file) stream through one task.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            n += len(batch)
            digest.update("".join(batch["sha256"]).encode())
        yield pd.DataFrame({"files": [n], "fingerprint": [digest.hexdigest()[:16]]})

    ordered = files.select("sha256").repartition(1).sortWithinPartitions("sha256")
    return ordered.mapInPandas(fold, "files BIGINT, fingerprint STRING")
