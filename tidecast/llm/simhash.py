"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits, by majority over the XXH64 hashes of the text's word shingles. Two link at 4 or fewer
differing bits. It is cut into three segments (22, 21 and 21 bits). The binary Golay code of length 23 covers the space
with balls of radius 3 around 4,096 codewords, so two words that differ in at most 2 bits share a codeword within
distance 4: their midpoint's codeword. A word has 1 or 6 such codewords, which are its fuzzy keys.

With 4 errors over three segments there are two cases (pigeonhole):
* a segment is equal, and of the others one has at most 2 errors: key = (equal segment, codeword of the other), 6 tables;
* each has an error, then two have exactly one, so that one half of each is equal, and the third has at most 2:
  key = (half of one, half of another, codeword of the third), 12 tables.
Keys have 31 to 35 bits, so that distinct fingerprints rarely meet by chance. Those that share a key are verified.

Only distinct fingerprints get keys, so copies cost nothing. A key with many is cut into blocks, every two of which are
compared in a task of their own. Within a task no pairs are listed: a search that visits
each fingerprint once against those not yet reached gives a spanning forest of the verified links, which is all that
connected components need. The components come from ``graph.components``.

Defined cases: a null text has no words; without words the fingerprint is zero, and zero links like any other; fewer
words than a shingle count as one; a null id is the smallest and shown as null; equal rows get equal results; a very long
text is hashed in pieces; an empty table gives an empty result. Other columns are ignored, whatever their names;
``one_of_each`` returns them, but for names that begin with _llm_.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ID, digest_of, few, row_id, shown_id, text_of, without, written
from tidecast.llm.graph import components

WORDS, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of a key that are compared in one task; more are compared block by block.
BLOCK = 4096
#: Segments as (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0xC75


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of a text, as an unsigned number."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    starts = np.zeros(len(tokens), np.int64)
    np.cumsum([len(t) + 1 for t in tokens[:-1]], out=starts[1:])
    ends = np.append(starts[1:] - 1, len(joined))
    counts, m = np.zeros(64, np.int64), max(1, len(tokens) - words + 1)
    first, last = starts[:m].tolist(), ends[-m:].tolist()
    for at in range(0, m, 65536):  # a long text in pieces
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + 65536], last[at:at + 65536])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > m).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles, from their hashes (uint64): the bits that over half of them set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=[ID, "digest", "print"])

    return run


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of the 4,096 messages, and for each of the 2,048 syndromes its error patterns of weight 4 or less (0 fills)."""
    parity = np.zeros(4096, np.uint32)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY << (bit - 11)
        parity[message] = rest
    one = np.array([1 << i for i in range(23)], np.uint32)
    patterns, level = [np.zeros(1, np.uint32)], np.zeros(1, np.uint32)
    for _ in range(4):
        level = np.unique((level[:, None] | one)[(level[:, None] & one) == 0])
        patterns.append(level)
    every = np.concatenate(patterns)
    syndromes = parity[every >> 11] ^ (every & 0x7FF)
    table, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for pattern, syndrome in zip(every.tolist(), syndromes.tolist()):
        table[syndrome, filled[syndrome]] = pattern
        filled[syndrome] += 1
    return parity, table


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, print) for all keys of distinct fingerprints (uint64)."""
    parity, table = golay_tables()
    exact = [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = []
    for word in exact:
        pattern = table[parity[word >> 11].astype(np.int64) ^ (word & 0x7FF)]
        near.append(np.where(pattern < 0, -1, (word[:, None] ^ pattern) >> 11))
    keys, owners, tag = [], [], 0

    def add(fixed: np.ndarray, codewords: np.ndarray) -> None:
        nonlocal tag
        key = (np.int64(tag) << 34) | (fixed[:, None] << 12) | codewords
        row, column = np.nonzero(codewords >= 0)
        keys.append(key[row, column])
        owners.append(prints[row])
        tag += 1

    for k in range(3):
        i, j = [s for s in range(3) if s != k]
        add(exact[i], near[k])
        add(exact[j], near[k])
        for a in (exact[i] & 0x7FF, exact[i] >> 11):
            for b in (exact[j] & 0x7FF, exact[j] >> 11):
                add(a << 11 | b, near[k])
    return np.concatenate(keys), np.concatenate(owners)


def _to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 4096):
            keys, owners = fuzzy_keys(prints[at:at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners.view(np.int64))], names=["key", "print"])


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, as (one, others): each is compared with those not yet reached."""
    found, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= distance
            if near.any():
                found.append((one, rest[near]))
                queue.extend(rest[near])
                rest = rest[~near]
    return found


def _links(distance: int):
    def edges(keys: np.ndarray, prints: np.ndarray, seen: set[bytes]) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        sizes = np.diff(starts, append=len(keys))
        pair = starts[sizes == 2]
        close = np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= distance
        ones, others = [prints[pair][close]], [prints[pair + 1][close]]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            run = np.sort(prints[a:a + n])
            if len(seen) > 100_000:
                seen.clear()  # it only spares repeated work
            if (mark := run.tobytes()) not in seen:
                seen.add(mark if n < 64 else mark[:0])
                for one, near in forest(run, distance):
                    ones.append(np.full(len(near), one))
                    others.append(near)
        links = np.stack([np.concatenate(ones), np.concatenate(others)]).view(np.int64)
        links = np.unique(np.sort(links, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, set()
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows < 500_000 or held[-1][0][0] == held[-1][0][-1]:
                continue
            keys, prints = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            yield edges(keys[:cut], prints[:cut], seen)
            held, rows = [(keys[cut:], prints[cut:])], len(keys) - cut
        if rows:
            yield edges(*(np.concatenate(c) for c in zip(*held)), seen)

    return run


def _by_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """The rows (key, print) with a part: keys of more than ``block`` prints are cut into blocks, and every two of these meet.

    A print goes to as many parts as its key has blocks, and a part holds the prints of two blocks, so that no task gets a
    whole hot key and no link within it is lost.
    """
    heavy = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(
        "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print", F.lit("block")), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    met = keyed.join(few(written(heavy, "heavy")), "key", "left")
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)
    return met.select("key", F.explode(parts).alias("part"), "print")


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (``print``), as many as connect all that are connected."""
    keyed = _by_blocks(prints.select("print").mapInArrow(_to_keys, "key long, print long"), block)
    one = keyed.select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), "print")
    met = one.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_links(distance), "a long, b long")
    return met.distinct()


def judge(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id (smallest id reachable), text_sha256, root.

    Unrelated components can share their smallest id, where it is missing or repeated; root is one fingerprint of a
    component and tells them apart.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys find links of at most {DISTANCE} bits")
    prints = written(docs.select(row_id().alias(ID), digest_of().alias("digest"), text_of().alias("text"))
                     .mapInArrow(_fingerprints(words), f"{ID} long, digest binary, print long"), "prints")
    distinct = written(prints.groupBy("print").agg(F.min(ID).alias("low")), "distinct")
    roots = components(written(links(distinct, distance), "links")).withColumnRenamed("node", "print")
    lowest = written(roots.join(distinct, "print").groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
    linked = roots.join(lowest, "root").select("print", "root", "lowest")
    named = written(distinct.join(linked, "print", "left").select("print", F.coalesce("root", "print").alias("root"), F.coalesce("lowest", "low").alias("component")), "components")
    return prints.join(named, "print").select(
        shown_id(ID).alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        shown_id("component").alias("component_id"), F.lower(F.hex("digest")).alias("text_sha256"), "root")


def one_of_each(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per component: the smallest id, of its texts the one with the smallest SHA-256."""
    low = F.min(F.struct("id", "digest"))
    rows = decisions.groupBy("root", row_id().alias("id"), F.unhex("text_sha256").alias("digest")).agg(F.count("*").alias("times"))
    rows = written(rows, "members")
    stay = rows.groupBy("root").agg(low.alias("low")).select(F.col("low.id").alias("id"), F.col("low.digest").alias("digest"), F.lit(True).alias("kept"))
    rows = written(rows.join(stay, ["id", "digest"], "left").where("kept is null or times > 1"), "changes")
    return without(docs, rows.where("kept is null"), rows.where("kept"))


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_sha256", "root")
