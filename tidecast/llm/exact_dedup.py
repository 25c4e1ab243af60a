"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every partition hashes its texts (SHA-256), sorts the hashes in blocks, cuts them to fingerprints of
   log2(documents) + 10 bits and sends each owner (a range of fingerprints) its distinct ones, as Golomb-coded gaps.
2. An owner decodes what all blocks sent, finds the fingerprints that came from more than one, and answers
   each block with a bitmap.
3. A block turns its bitmaps into suspects. Only their texts are fetched and compared, byte by byte.

A block sends a fingerprint once however many copies it holds, so a text with a third of all rows costs an
owner one entry a block. Ids and digests wait in the written cells; texts never enter Python.

Defined cases: a null text is empty, and empty texts are copies of each other. A null id counts as the smallest
and is shown as null. Of rows with equal id and text, one is kept. An empty table gives an empty result. Other
columns are ignored, whatever their names. Two different texts with one SHA-256 would stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ID, digest_of, few, power_of_two, row_id, shown_id, text_of, without, written

#: Documents a block holds at most, and fingerprints an owner is given on average at most.
BLOCK_ROWS, OWNER_ROWS = 1 << 17, 1 << 22
#: Bits beyond log2(documents): one unique document in about 2^10 becomes a suspect by chance.
SPARE_BITS = 10

_CELLS = "block long, owner long, n int, k int, gaps binary, rests binary, ids array<long>, digests binary, firsts binary"


def golomb_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Gaps of ascending distinct values: quotients by 2^k in unary, remainders in k bits, in two streams."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)) + np.uint64(1)).astype(np.int64) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    return np.packbits(unary).tobytes(), np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()


def golomb_decode(unary: bytes, rests: bytes, n: int, k: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rests, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + low).astype(np.uint64)


def _block_cells(block: int, ids: list, digests: list[bytes], bits: int, owner_bits: int) -> pa.RecordBatch:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    prints = raw[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)
    order = np.argsort(prints, kind="stable")
    prints, raw, ids = prints[order], raw[order], np.array(ids, dtype=object)[order]
    low = bits - owner_bits
    owners = (prints >> np.uint64(low)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owners, prepend=-1))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(prints))):
        mine = prints[a:b] & np.uint64((1 << low) - 1)
        first = np.diff(mine, prepend=~mine[:1]) != 0
        distinct = mine[first]
        k = max(0, low - power_of_two(len(distinct)))
        gaps, rests = golomb_encode(distinct, k)
        rows.append((block, int(owners[a]), len(distinct), k, gaps, rests, list(ids[a:b]), raw[a:b].tobytes(),
                     np.packbits(first).tobytes()))
    names = [c.split()[0] for c in _CELLS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _to_cells(bits: int, owner_bits: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, digests = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            digests += batch.column(1).to_pylist()
            while len(ids) >= block_rows:
                yield _block_cells((part << 24) + seq, ids[:block_rows], digests[:block_rows], bits, owner_bits)
                ids, digests, seq = ids[block_rows:], digests[block_rows:], seq + 1
        if ids:
            yield _block_cells((part << 24) + seq, ids, digests, bits, owner_bits)

    return run


def _answer(cells: pa.Table) -> pa.Table:
    """One owner: which fingerprints of each cell came from other blocks too."""
    columns = [cells.column(c).to_pylist() for c in ("block", "owner", "n", "k", "gaps", "rests")]
    values = [golomb_decode(g, r, n, k) for _, _, n, k, g, r in zip(*columns)]
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    same = np.diff(flat[order]) == 0
    twice = np.zeros(len(flat), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    parts = np.split(twice, np.cumsum([len(v) for v in values])[:-1])
    return pa.table({"block": pa.array(columns[0], pa.int64()), "owner": pa.array(columns[1], pa.int64()),
                     "bitmap": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with their bitmaps: every document with its digest, and whether it is a suspect."""
    for batch in batches:
        for row in batch.to_pylist():
            m = len(row["ids"])
            slot = np.cumsum(np.unpackbits(np.frombuffer(row["firsts"], np.uint8))[:m].astype(np.int64)) - 1
            elsewhere = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[: row["n"]].astype(bool)
            suspect = elsewhere[slot] | (np.bincount(slot, minlength=row["n"])[slot] > 1)
            raw = pa.py_buffer(row["digests"])
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), m, [None, raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), digests, pa.array(suspect)], names=[ID, "digest", "suspect"])


def marked(docs: DataFrame, block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS,
           spare_bits: int = SPARE_BITS) -> DataFrame:
    """Every document as (id, digest, suspect); all copies of a text are suspects, few others are."""
    rows = docs.count()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner_bits = min(24, max(power_of_two(rows / owner_rows), power_of_two(min(partitions, max(1, rows // 64)))))
    bits = min(62, max(owner_bits + 1, power_of_two(rows) + spare_bits))
    hashed = docs.select(row_id().alias(ID), digest_of().alias("digest"))
    cells = written(hashed.mapInArrow(_to_cells(bits, owner_bits, block_rows), _CELLS), "cells")
    answers = (cells.select("block", "owner", "n", "k", "gaps", "rests")
               .groupBy("owner").applyInArrow(_answer, "block long, owner long, bitmap binary"))
    back = cells.drop("gaps", "rests", "k").join(answers, ["block", "owner"])
    return back.select("n", "ids", "digests", "firsts", "bitmap").mapInArrow(_mark, f"{ID} long, digest binary, suspect boolean")


def decide(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the row that stays for its text, copies, and whether it is this one.

    Columns: doc_id, keep_id (largest id of the text), group_size, kept, text_sha256.
    """
    marks = written(marked(docs, **sizes), "marks")
    suspects = marks.where("suspect").select(ID, "digest")
    texts = docs.select(row_id().alias(ID), digest_of().alias("digest"), text_of().alias("text"))
    verified = (texts.join(few(suspects.distinct()), [ID, "digest"], "left_semi").groupBy("digest")
                .agg(F.min("text").alias("low"), F.max("text").alias("high"), F.max(ID).alias("keep"),
                     F.count("*").alias("group_size"))
                .select("digest", "group_size", F.when(F.col("low") == F.col("high"), F.col("keep"))
                        .otherwise(F.raise_error(F.lit("two different texts have one SHA-256"))).alias("keep")))
    groups = written(verified, "groups")
    repeats = suspects.groupBy(ID, "digest").agg(F.count("*").alias("times"))
    copies = (repeats.join(groups, "digest")
              .select(ID, "keep", "group_size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn"))
              .select(ID, "keep", "group_size", ((F.col(ID) == F.col("keep")) & (F.col("turn") == 1)).alias("kept"), "digest"))
    single = marks.where("not suspect").select(
        ID, F.col(ID).alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return single.unionByName(copies).select(
        shown_id(ID).alias("doc_id"), shown_id("keep").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keep, with all their columns, whatever they are called."""
    rows = decisions.groupBy(row_id().alias("id"), F.unhex("text_sha256").alias("digest")).agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    rows = written(rows.where("not kept or times > 1"), "changes")
    return without(docs, rows.where("not kept"), rows.where("kept"))


def query(spark, sf_dir):
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept,
       text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
