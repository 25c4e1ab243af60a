"""Substring dedup: words that lie in a run of words seen earlier go, found by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash among its runs of three
words, so equal windows have equal minimisers. Consecutive windows with one minimiser travel as one packed string (a
super-k-mer) to the minimiser's bucket, about three words for each word of text in place of ``window`` words.

1. A task packs the super-k-mers of some megabytes of text at a time and sends each bucket one compressed cell. Equal
   strings of a cell are sent once, with their earliest position: only the earliest one of equal strings can hold the
   first occurrence of a window, so a passage with a third of all rows costs a bucket one string a cell.
2. A bucket keeps the earliest of equal strings, cuts the strings into windows, sorts these by content and position and
   returns the first of each, as runs of consecutive windows. Equality is decided on the words themselves.
3. A document's runs are gathered. The windows that are not among them start earlier elsewhere, and their words go. Only
   documents that lose some of their words are read again.

Buckets hold ``bucket_bytes`` on average. Where the text around a common passage differs everywhere, the strings of one
minimiser differ too and can be more than a bucket holds. Such minimisers are estimated on a sample of texts, and their
windows travel one by one, dealt by their own content. That only changes the bucket a window goes to, no result.

Earlier means: smaller id (a missing id is the smallest), for rows of equal id the smaller SHA-256 of the text, then the
smaller start. Of rows equal in id and text one counts as first.

Defined cases: a null text has no words; texts of fewer words than a window lose none; a document all of whose windows
start earlier is empty; equal rows are told apart as above; a very long text is cut into super-k-mers like any other; an
empty table gives an empty result. Other columns are ignored, whatever their names; ``without_repeats`` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ID, digest_of, few, power_of_two, row_id, shown_id, text_of, written

WINDOW = 20
#: Words of the runs among which a minimiser is chosen.
GRAM = 3
#: Packed bytes that a bucket is given on average, bytes of text that are packed at a time.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 3 << 20
#: One text in so many is sampled to find minimisers with more than a quarter of a bucket, and how many of them are split at most.
SAMPLE, SPLIT = 64, 100_000
#: Windows of a super-k-mer at most; a longer run of windows with one minimiser is sent in several.
LONGEST = 256

_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes
_CELLS = "bucket long, strings binary, ids binary, ties binary, starts binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    one, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    one[:1] = inverse[:1] = 1
    return np.cumprod(one), np.cumprod(inverse)


class Packer:
    """Super-k-mers of texts: buffer, and per super-k-mer its text, first word, windows, bytes and minimiser."""

    def __init__(self, window: int, split: np.ndarray):
        self.window, self.split = window, split
        self.gram = min(GRAM, window)
        self.powers = _powers(1)

    def pack(self, texts: list[bytes]) -> tuple[bytes, tuple[np.ndarray, ...]]:
        """``texts`` hold words with one space between them."""
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        if len(raw) > len(self.powers[0]):
            self.powers = _powers(len(raw))
        stops = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.concatenate([[0], stops[:-1] + 1])
        text = np.repeat(np.arange(len(texts)), np.diff(np.flatnonzero(raw[stops] == 10), prepend=-1))
        first = np.searchsorted(text, text)  # index of the first word of a word's text
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[0][:len(raw)])])
        words = _mixed((sums[stops] - sums[starts]) * self.powers[1][starts])
        none = (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
        count = len(words) - self.window + 1
        if count < 1:
            return joined, none
        grams = words[: len(words) - self.gram + 1].copy()
        for k in range(1, self.gram):
            grams = grams * np.uint64(0x9FB21C651E98DF25) + words[k: len(words) - self.gram + 1 + k]
        least, span, need = _mixed(grams), 1, self.window - self.gram + 1
        while span < need:
            step = min(span, need - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        good = text[:count] == text[self.window - 1:]
        new = good.copy()
        new[1:] &= ~(good[:-1] & (least[1:] == least[:-1]))
        lone = np.isin(least, self.split) & good if len(self.split) else np.zeros(count, bool)
        new |= lone
        at = np.flatnonzero(new)
        if not len(at):
            return joined, none
        ends = np.minimum(np.append(at[1:], count), _run_ends(good)[at])
        pieces = -(-(ends - at) // LONGEST)
        if pieces.max() > 1:
            turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = np.repeat(at, pieces) + turn * LONGEST
            ends = np.minimum(np.repeat(ends, pieces), at + LONGEST)
        route = least[at].copy()
        if lone.any():
            whole = np.zeros(lone[at].sum(), np.uint64)
            for k in range(self.window):
                whole = whole * np.uint64(0x9FB21C651E98DF25) + words[at[lone[at]] + k]
            route[lone[at]] = _mixed(whole)
        return joined, (text[at], at - first[at], ends - at, starts[at], stops[ends + self.window - 2], route)


def _run_ends(good: np.ndarray) -> np.ndarray:
    """For each place the next place that is not good."""
    bad = np.append(np.flatnonzero(~good), len(good))
    return bad[np.searchsorted(bad, np.arange(len(good)))]


def _spaced(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").split())  # of bytes, so at the six ASCII blanks only


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (id, tie, words) with a total of about ``size`` bytes, in order of id and tie."""
    held, total = [], 0
    for batch in batches:
        for i, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            held.append((i, tie, _spaced(text.as_py())))
            total += len(held[-1][2])
            if total >= size:
                yield sorted(held)
                held, total = [], 0
    if held:
        yield sorted(held)


def _to_cells(window: int, bits: int, split: list[int], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, squeeze = Packer(window, np.array(split, np.int64).view(np.uint64)), zstandard.ZstdCompressor(level=3).compress
        for rows in _chunks(batches, chunk_bytes):
            rows = [r for r in rows if r[2].count(b" ") >= window - 1]
            if not rows:
                continue
            joined, (text, start, _, low, high, route) = packer.pack([r[2] for r in rows])
            ids = np.array([r[0] for r in rows], np.int64)
            bucket = (_mixed(route) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(route), np.int64)
            order = np.argsort(bucket, kind="stable")  # so that the first of equal strings is the earliest
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                mine, firsts = order[a:b], {}
                for k, x, y in zip(mine.tolist(), low[mine].tolist(), high[mine].tolist()):
                    firsts.setdefault(joined[x:y], k)
                kept = np.fromiter(firsts.values(), np.int64, len(firsts))
                ties = b"".join(rows[t][1] for t in text[kept].tolist())
                parts = (b"\n".join(firsts), ids[text[kept]].tobytes(), ties, start[kept].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket[mine[0]]], pa.int64()), *(pa.array([squeeze(p)], pa.binary()) for p in parts)],
                    names=[c.split()[0] for c in _CELLS.split(", ")])

    return run


def _counted(window: int):
    """How often each minimiser begins a super-k-mer, a row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, np.zeros(0, np.uint64))
        for rows in _chunks(batches, CHUNK_BYTES):
            _, (_, _, _, low, high, route) = packer.pack([r[2] for r in rows if r[2]] or [b"-"])
            keys, where = np.unique(route, return_inverse=True)
            size = np.bincount(where, high - low, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(size)], names=["key", "size"])

    return run


def _earliest(window: int):
    """One bucket: the first occurrence of each window, as runs of consecutive ones (id, tie, start << 20 | windows)."""
    def run(cells: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        parts = {c: [open_(x) for x in cells.column(c).to_pylist()] for c in ("strings", "ids", "ties", "starts")}
        strings = pa.array([s for p in parts["strings"] for s in p.split(b"\n")], pa.large_binary())
        del cells
        ids = np.frombuffer(b"".join(parts["ids"]), np.int64)
        starts = np.frombuffer(b"".join(parts["starts"]), np.int32).astype(np.int64)
        ties = np.frombuffer(b"".join(parts["ties"]), "S32") if any(parts["ties"]) else None
        rank = np.unique(ids, return_inverse=True)[1] if ties is None else _ranked(ids, ties)
        place = rank << 32 | starts
        coded = strings.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((place, code))
        one = order[np.diff(code[order], prepend=-1) != 0]  # the earliest of equal strings, by code
        split = pc.split_pattern(coded.dictionary.cast(pa.large_string()), " ")
        tokens = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = split.offsets.to_numpy(zero_copy_only=False)
        lengths = np.diff(ends) - (window - 1)
        owner = np.repeat(np.arange(len(one)), lengths)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at, position = ends[owner] + step, place[one][owner] + step
        seed = 0
        while True:  # by a hash of the words; should different windows have one, by another hash
            values = np.random.default_rng(seed).integers(0, 2**64, int(tokens.max()) + 1, np.uint64)[tokens]
            hashed = np.zeros(len(at), np.uint64)
            for k in range(window):
                hashed = hashed * np.uint64(0x9FB21C651E98DF25) + values[at + k]
            order = np.lexsort((position, hashed))
            same = hashed[order[1:]] == hashed[order[:-1]]
            a, b = at[order[1:][same]], at[order[:-1][same]]
            if all((tokens[a + k] == tokens[b + k]).all() for k in range(window)):
                break
            seed += 1
        first = np.ones(len(at), bool)
        first[order[1:][same]] = False
        won = np.flatnonzero(first)
        head = np.ones(len(won), bool)
        head[1:] = (np.diff(won) != 1) | (owner[won[1:]] != owner[won[:-1]])
        heads = won[head]
        many = np.diff(np.append(np.flatnonzero(head), len(won)))
        row = one[owner[heads]]
        return pa.table({"id": pa.array(ids[row]), "tie": pa.array([b""] * len(row) if ties is None else [bytes(ties[r:r + 1].tobytes()) for r in row.tolist()], pa.binary()),
                         "run": pa.array((starts[row] + step[heads]) << 20 | many)})

    return run


def _ranked(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Ranks by id, then by the 32 bytes of the tie."""
    words = np.frombuffer(ties.tobytes(), ">u8").reshape(-1, 4).astype(np.uint64)
    order = np.lexsort((*words.T[::-1], ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (words[order[1:]] != words[order[:-1]]).any(axis=1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _left(window: int):
    """What is left of texts that lose some words: (id, digest, n_removed, kept)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, runs in zip(batch.column(2), batch.column(3).to_pylist()):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                gone = np.ones(len(words) - window + 1, np.int64)
                for r in runs:
                    gone[r >> 20:(r >> 20) + (r & 0xFFFFF)] = 0
                edge = np.zeros(len(words) + 1, np.int64)
                edge[: len(gone)] += gone
                edge[window:] -= gone
                stay = np.cumsum(edge)[:-1] == 0
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[ID, "digest", "n_removed", "kept"])

    return run


def _words() -> Column:
    """The words of the text with one space between them."""
    return F.trim(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", " "))


def judge(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES,
          sample: int = SAMPLE, kept_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, text_sha256.

    With ``kept_text`` the words that are left come too, as ``kept``: null where none is removed, or all are.
    """
    norm = F.col("norm")
    light = written(docs.select(row_id().alias(ID), digest_of().alias("digest"), _words().alias("norm")).select(
        ID, "digest", F.octet_length("norm").cast("long").alias("size"), F.sha2(norm.cast("binary"), 256).alias("sha"),
        F.when(norm == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words")), "light")
    long_enough = light.where(F.col("n_words") >= window)
    rows = written(long_enough.groupBy(ID, "digest").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words")), "rows")
    repeated = bool(rows.groupBy(ID).count().where("count > 1").limit(1).count())
    total = long_enough.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tie = F.col("digest") if repeated else F.unhex(F.lit(""))
    texts = docs.select(row_id().alias(ID), digest_of().alias("digest"), text_of().alias("text")).select(ID, tie.alias("tie"), "text")
    packed = 3 * total
    counts = (texts.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(sample)) == 0).mapInArrow(_counted(window), "key long, size long")
              .groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") * sample > max(bucket_bytes // 4, 1)))
    split = [r["key"] for r in counts.orderBy(F.desc("size"), "key").limit(SPLIT).collect()] if packed > bucket_bytes else []
    bits = power_of_two(packed / bucket_bytes)
    cells = texts.mapInArrow(_to_cells(window, bits, split, chunk_bytes), _CELLS)
    runs = cells.groupBy("bucket").applyInArrow(_earliest(window), "id long, tie binary, run long")
    firsts = written(runs.groupBy(F.col("id").alias(ID), "tie").agg(
        F.sum(F.col("run").bitwiseAND(F.lit(0xFFFFF))).alias("n_first"), F.collect_list("run").alias("runs")), "firsts")
    met = rows.withColumn("tie", tie).join(firsts, [ID, "tie"], "left")
    n_first, windows = F.coalesce("n_first", F.lit(0)), F.col("n_words") - (window - 1)
    lost = written(met.where(n_first < windows).select(ID, "digest", "copies", "n_words", n_first.alias("n_first"), F.when(n_first > 0, F.col("runs")).alias("runs")), "lost")
    partial = lost.where("n_first > 0").select(ID, "digest", "runs")
    again = docs.select(row_id().alias(ID), digest_of().alias("digest"), text_of().alias("text")).join(few(partial.select(ID, "digest")), [ID, "digest"], "left_semi")
    left = (again.join(partial, [ID, "digest"])
            .select(ID, "digest", "text", "runs").mapInArrow(_left(window), f"{ID} long, digest binary, n_removed long, kept string"))
    shown = F.col("kept") if kept_text else F.lit(None).cast("string")
    left = written(left.select(ID, "digest", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"), shown.alias("kept"))
                   .groupBy(ID, "digest").agg(F.max(F.struct("n_removed", "kept_sha", "kept")).alias("left")), "left")
    # rows with no loss are not joined; of equal rows one has what ``left`` says and the others lose all
    touched = lost.select(ID, "digest", "n_first", F.lit(1).cast("long").alias("copies")).join(left, [ID, "digest"], "left")
    copied = rows.where("copies > 1").select(ID, "digest", F.col("copies").alias("times"))
    fate = touched.join(copied, [ID, "digest"], "full_outer").select(
        ID, "digest", F.coalesce("n_first", F.lit(-1)).alias("n_first"), "left", F.coalesce("times", F.lit(1)).alias("times"))
    special = light.join(fate.select(ID, "digest"), [ID, "digest"], "left_semi").groupBy(ID, "digest").agg(
        F.max("n_words").alias("n_words"), F.max("sha").alias("sha")).join(fate, [ID, "digest"])
    turned = special.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn"))
    all_gone = (F.col("turn") > 1) | (F.col("n_first") == 0)
    whole = F.col("n_first") == -1
    changed = turned.select(
        ID, "digest", "n_words",
        F.when(all_gone, F.col("n_words")).when(whole, 0).otherwise(F.col("left.n_removed")).alias("n_removed"),
        F.when(all_gone, F.lit(_EMPTY)).when(whole, F.col("sha")).otherwise(F.col("left.kept_sha")).alias("kept_sha256"),
        F.when(~all_gone, F.col("left.kept")).alias("kept"))
    same = light.join(fate.select(ID, "digest"), [ID, "digest"], "left_anti").select(
        ID, "digest", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    out = same.unionByName(changed).select(
        shown_id(ID).alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.lower(F.hex("digest")).alias("text_sha256"), "kept")
    return out if kept_text else out.drop("kept")


def without_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that is left; equal rows are one row; texts that lose no word stay as they are, empty ones go."""
    judged = judge(docs, kept_text=True, **sizes)
    first = judged.groupBy(row_id().alias("_llm_at"), F.unhex("text_sha256").alias("_llm_sha")).agg(F.min(F.struct("n_removed", "n_words", "kept")).alias("_llm_left"))
    keyed = docs.select("*", row_id().alias(ID), digest_of().alias("_llm_digest")).dropDuplicates([ID, "_llm_digest"])
    met = keyed.join(first, (keyed[ID] == first["_llm_at"]) & (keyed["_llm_digest"] == first["_llm_sha"]))
    stay = met.where("_llm_left.n_words = 0 or _llm_left.n_removed < _llm_left.n_words")
    return stay.withColumn("text", F.coalesce("_llm_left.kept", "text")).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, sha256(coalesce(text, '')) AS digest,
             row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS r FROM documents),
s AS (SELECT r, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM d),
g AS (SELECT s.r, i, array_to_string(d.w[i:i + {WINDOW - 1}], ' ') AS gram FROM s JOIN d USING (r)),
o AS (SELECT r, i, row_number() OVER (PARTITION BY gram ORDER BY r, i) > 1 AS again FROM g),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
c AS (SELECT p.r, p.i, p.word, coalesce(max(CAST(again AS INT)) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS gone
      FROM p LEFT JOIN o ON p.r = o.r AND p.i = o.i),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
