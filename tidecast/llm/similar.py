"""Texts that share at least four fifths of their word shingles: SimHash with Golay keys links what its fingerprints can
tell, MinHash bands find what they can't, an exact prefix filter the pairs, and the shingle sets decide.

1. Every text has a SimHash fingerprint over its set of five-word shingles. ``simhash.links`` joins fingerprints of 4 or fewer
   differing bits by their Golay keys. Each text is compared with one of those that its fingerprint links it to, and with
   one of an equal fingerprint; links that the sets confirm are contracted before anything else is looked for.
2. A pair of similarity 0.8 differs in some ten bits of 64, so fingerprints alone miss most such pairs. Two texts of Jaccard
   similarity s agree in a MinHash with probability s, in all ROWS of a band with s^ROWS. With 32 bands of 5 a pair of
   similarity 0.8 shares no band with probability 3e-6, one of 0.85 with 2e-8. Texts that share a band or a linked
   fingerprint with another are candidates; only their shingles are looked at again, and written once.
3. Shingles are ordered from the rarest to the most common among candidates. Sets of n and m shingles that are similar
   have sizes within 4:5 and share one of their first n / 5 + 1 and m / 5 + 1 shingles, and after the first one that they
   share enough must be left in both. So a text with many shingles of its own, as edited copies below the similarity
   have, meets no other at all, and common lines are no meeting place.
4. Links, not pairs: a round compares each text with one other, the first by a hash among those it may be similar to, and
   contracts the new links; shingles all of whose texts are in one component are done. After ROUNDS such rounds, which
   join large groups of copies, the pairs of different components that still pass the filters are compared, so that no
   link among components is missed. A last filter looks at these: a bitmap of BITS bits per set, one bit for each shingle's
   hash. Where bitmaps differ the shingles do, so sets whose bitmaps differ too much are not similar, for certain, and what
   passes is nearly all links.

Defined cases: a null text is empty; texts without a word are all alike; fewer words than a shingle count as one shingle;
rows of equal text (by SHA-256) are one node; a missing or repeated id changes nothing; a very long text has as many
shingles as words; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm import simhash
from tidecast.llm.common import digest_of, few, row_id, shown_id, text_of, written
from tidecast.llm.graph import components

WORDS, SEED, BANDS, ROWS = 5, 42, 32, 5
#: The least similarity, as a fraction.
SHARE = (4, 5)
#: Bits of a set's bitmap, a power of two.
BITS = 2048
#: Rounds that compare each text with one other before all pairs that are left are compared.
ROUNDS = 3


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(tokens[i:i + words]), SEED) for i in range(max(1, len(tokens) - words + 1))], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles (not empty), one a band."""
    factors = np.random.default_rng(SEED).integers(0, 2**31, (2, BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(found), 1024):
        np.minimum(least, (low[at:at + 1024] * factors[0] + high[at:at + 1024] * factors[1]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        keys = [bands(s).view(np.int64) if len(s) else [] for s in sets]
        prints = np.fromiter(map(simhash.majority, sets), np.uint64, len(sets)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints)],
                                         names=["digest", "n", "bands", "print"])


def bitmap(found: np.ndarray) -> np.ndarray:
    """BITS bits, as signed longs: those that the shingles' hashes name."""
    bits = np.zeros(BITS, np.uint8)
    bits[(found >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))],
                                         names=["node", "shingles", "bits"])


def _prefixes(sets: DataFrame) -> DataFrame:
    """(shingle, node, n, at) for the shingles that other sets have too and by which a set (node, shingles) can be met."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    ordered = each.join(shared, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
    own = F.col("n") - F.size("shared")  # shingles of this set alone, which come first
    met = ordered.select("node", "n", own.alias("own"), F.expr("slice(shared, 1, greatest(0, cast(floor(n / 5) as int) + 1 - (n - size(shared))))").alias("shared"))
    return met.select("node", "n", "own", F.posexplode("shared").alias("at", "x")).select(
        F.col("x.shingle").alias("shingle"), "node", "n", (F.col("own") + F.col("at")).alias("at"))


def _may_be_similar() -> Column:
    """Of rows (n, at) and (n_b, at_b) that meet in a shingle: sizes within 4:5 and enough shingles left."""
    some, whole = SHARE
    left = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return ((F.least("n", "n_b") * whole >= F.greatest("n", "n_b") * some) & (left * (some + whole) >= (F.col("n") + F.col("n_b")) * some))


def _bits_allow() -> Column:
    """Whether sets of n and n_b shingles can be similar, by their bitmaps: bits that differ stand for shingles of one alone."""
    some, whole = SHARE
    differ = F.aggregate(F.zip_with("bits", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return (F.col("n") + F.col("n_b") - differ) * (some + whole) >= (F.col("n") + F.col("n_b")) * (2 * some)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    at_a, at_b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    met = pairs.join(at_b, "b").join(at_a, "a")
    both, some, whole = F.size(F.array_intersect("set_a", "set_b")), *SHARE
    return met.where(both * (some + whole) >= (F.size("set_a") + F.size("set_b")) * some).select("a", "b")


def _still_open(rows: DataFrame) -> DataFrame:
    """Rows of the shingles that texts of different roots share."""
    mixed = rows.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle")
    return rows.join(mixed, "shingle", "left_semi")


def by_fingerprint(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (node, n, print) to compare: each with one of an equal fingerprint and one of a linked fingerprint."""
    own = sketches.where("n > 0").select("node", "print")
    distinct = written(own.groupBy("print").agg(F.min("node").alias("low")), "distinct")
    equal = own.join(distinct, "print").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    linked = simhash.links(distinct)
    for x in "ab":
        linked = linked.join(distinct.select(F.col("print").alias(x), F.col("low").alias(f"node_{x}")), x)
    linked = linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("rank"), "b")).alias("low")).select("a", F.col("low.b").alias("b"))
    return equal.unionByName(nearest)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_sha256, root (the same for all texts of a component)."""
    rows = docs.select(digest_of().alias("digest"), text_of().alias("text"))
    sketches = written(rows.mapInArrow(_sketch, "digest binary, n long, bands array<long>, print long").dropDuplicates(["digest"])
                       .withColumn("node", F.monotonically_increasing_id()), "sketches")
    keyed = sketches.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    alike = written(by_fingerprint(sketches), "alike")
    met = keyed.join(shared, "key", "left_semi").select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = written(met.distinct().join(sketches.select("node", "digest"), "node"), "candidates")
    texts = rows.join(few(wanted), "digest").select("node", "text")
    sets = written(texts.mapInArrow(_sets, "node long, shingles array<long>, bits array<long>").dropDuplicates(["node"]), "sets")
    links = written(_links(alike, sets), "links")
    roots = components(links) if links.limit(1).count() else None
    index = _prefixes(sets).withColumn("root", F.col("node"))
    if roots is not None:
        index = index.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    index = written(_still_open(index), "index")
    for turn in range(ROUNDS + 1):
        if not index.limit(1).count():
            break
        if turn < ROUNDS:
            place = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "n", "at", "root")
            first = index.groupBy("shingle").agg(F.min(place).alias("low")).select(
                "shingle", F.col("low.rank").alias("rank"), *[F.col(f"low.{c}").alias(f"{c}_b") for c in ("node", "n", "at", "root")])
            met = index.join(first, "shingle").where((F.col("root") != F.col("root_b")) & _may_be_similar())
            pairs = met.groupBy("node").agg(F.min(F.struct("rank", "node_b")).alias("low")).select(F.col("node").alias("a"), F.col("low.node_b").alias("b"))
        else:
            index = index.join(sets.select("node", "bits"), "node")
            other = index.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root", "bits")])
            met = index.join(other, "shingle").where((F.col("root") < F.col("root_b")) & _may_be_similar() & _bits_allow())
            pairs = met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
        links = written(_links(written(pairs, "pairs"), sets), "links")
        if not links.limit(1).count():
            continue
        if roots is not None:
            at_a, at_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
            links = links.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
            links = written(links.where("a <> b").distinct(), "links")
        step = components(links).select(F.col("node").alias("root"), F.col("root").alias("further"))
        if roots is None:
            roots = step.select(F.col("root").alias("node"), F.col("further").alias("root"))
        else:
            moved = roots.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            new = step.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("further").alias("root"))
            roots = written(moved.unionByName(new), "roots")
        if turn < ROUNDS:
            index = written(_still_open(index.join(step, "root", "left").select("shingle", "node", "n", "at", F.coalesce("further", "root").alias("root"))), "index")
    named = sketches.select("digest", "node", F.when(F.col("n") == 0, F.lit(-1).cast("long")).alias("empty"))
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node"))
    named = named.select("digest", F.coalesce("empty", "node").alias("root"))
    out = docs.select(row_id().alias("id"), digest_of().alias("digest")).join(named, "digest")
    return out.select(shown_id("id").alias("doc_id"), F.lower(F.hex("digest")).alias("text_sha256"), "root")
