"""Phrase collocations per language, counted with HAT-tries.

1. A task numbers its words and counts, for every word of a piece of text, the up to four words from there on, in a trie
   whose containers are hash tables of the remaining words; a container that grows too large bursts into one container a
   next word. A phrase's count is the sum of the subtree under it, so that one insertion a word counts all lengths.
2. When the trie holds too much, whole subtrees (those under one first word, largest first) are spilled as sorted runs, and
   after some megabytes of text all of them, so that words can be numbered anew; each run is cut by prefix partition: the hash of language and first three words. One- and two-word phrases go to the
   partitions of their own hashes, with their subtrees' sums. Runs are compressed.
3. A partition merges its runs: equal entries are summed, and a three-word phrase sums its continuations.
4. Scores, containment and ranks are joins of the phrases frequent enough, all whose parts are frequent enough too.

However often a phrase occurs, it is one entry a run. A three-word phrase with more text after it than a part of a
partition (estimated on a sample of texts) is split: its continuations are dealt by their own hashes and its sum is sent
apart. That changes where an entry goes, no result. Memory holds one trie of bounded size in a task, one partition's runs
in a merge.

Defined cases: a null text is empty; a null language is ``und``, together with texts that say so; equal rows count each;
very long texts are counted in parts without losing a phrase; equal scores rank by count, then by the phrase's bytes; an empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import power_of_two, text_of, written

#: Words of a phrase at most.
LONGEST = 4
#: Occurrences of a candidate at least, percent of a phrase's occurrences that lie in a longer one to drop it, phrases returned.
LEAST, SHARE, TOP = 30, 80, 2000
#: Bytes of phrases that a partition merges on average, entries a task's trie holds, entries of a container before it bursts.
BUCKET_BYTES, HELD, BURST = 32 << 20, 400_000, 4096
#: Bytes of text counted at a time; one text in so many is sampled; three-word phrases that are split at most.
CHUNK_BYTES, SAMPLE, SPLIT = 4 << 20, 64, 100_000

#: Words that are numbered at a time; a longer text is cut, each part read with the three words after it.
WORDS = 1_000_000
#: Word numbers have 21 bits; 0 stands for the end of a piece.
_BITS = 21
_MASK = (1 << _BITS) - 1
_RUNS = "bucket long, lang string, phrases binary, counts binary"
#: Between three words and the fourth: counted for the three words too, or sent apart.
_JOINED, _APART = b"\t", b"\v"
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)

_ENDS = b".,;:!?\n\v\f\r"
#: A-Z in lower case, one byte for all ends of pieces, tabs as spaces.
_TABLE = bytes(46 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Container(dict):
    """Remaining words, packed in one number, and their count."""


class HatTrie:
    """Counts of rows of four word numbers: under a first word a container, or once it has burst one container a next word."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.sizes, self.size = burst, {}, Counter(), 0

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """``rest`` packs the three words after ``first``."""
        for key, mine in _groups(first, rest):
            before = self.size
            self._into(self.root, key, mine, LONGEST - 1)
            self.sizes[key] += self.size - before

    def _into(self, parent: dict, key: int, rest: list[int], left: int) -> None:
        child = parent.get(key)
        if child is None:
            child = parent[key] = Container()
        if type(child) is Container:
            self.size -= len(child)
            for k in rest:
                child[k] = child.get(k, 0) + 1
            self.size += len(child)
            if left > 1 and len(child) > self.burst:
                shift = _BITS * (left - 1)
                node = parent[key] = {}
                for k, n in child.items():
                    node.setdefault(k >> shift, Container())[k & (1 << shift) - 1] = n
        else:
            packed, shift = np.array(rest, np.int64), _BITS * (left - 1)
            for k, mine in _groups(packed >> shift, packed & (1 << shift) - 1):
                self._into(child, k, mine, left - 1)

    def take(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove the subtrees under these first words: (first, rest, count) of their entries."""
        rests, counts, sizes = [], [], []

        def gather(child: dict, prefix: int, left: int) -> None:
            if type(child) is Container:
                rests.extend([k | prefix for k in child] if prefix else child)
                counts.extend(child.values())
                return
            for k, below in child.items():
                gather(below, prefix | k << _BITS * (left - 1), left - 1)

        for key in keys:
            gather(self.root.pop(key), 0, LONGEST - 1)
            sizes.append(self.sizes.pop(key))
        self.size -= sum(sizes)
        return np.repeat(np.array(keys, np.int64), sizes), np.array(rests, np.int64), np.array(counts, np.int64)

    def largest(self, entries: int) -> list[int]:
        """First words whose subtrees hold so many entries, the largest first."""
        chosen, held = [], 0
        for key, n in self.sizes.most_common():
            if held >= entries:
                break
            chosen.append(key)
            held += n
        return chosen


def _groups(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order].tolist()
    cuts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    bounds = [*cuts.tolist(), len(values)]
    for key, a, b in zip(keys[cuts].tolist(), bounds, bounds[1:]):
        yield key, values[a:b]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Numbers of words, from 1; 0 is the end of a piece."""

    def __init__(self):
        self.numbers = defaultdict(count(1).__next__, {b".": 0})
        self.hashes = np.zeros(0, np.uint64)

    def hashed(self) -> np.ndarray:
        if len(self.hashes) < len(self.numbers):
            new = list(self.numbers)[len(self.hashes):]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes

    def sequences(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first, rest) for every word but the last three tokens, which only follow others."""
        a = np.array(list(map(self.numbers.__getitem__, tokens)), np.int64)
        a, b, c, d = a[:-3], a[1:-2], a[2:-1], a[3:]
        c = np.where(b == 0, 0, c)
        d = np.where(c == 0, 0, d)
        word = a > 0
        return a[word], (b << 2 * _BITS | c << _BITS | d)[word]


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words and ends of pieces, as ``.``, of the texts: up to WORDS tokens at a time and the three that follow."""
    tokens = []
    for text in texts:
        tokens += text.translate(_TABLE).replace(b".", b" . ").split()
        tokens.append(b".")
    tokens += [b"."] * 3
    for at in range(0, len(tokens) - 3, WORDS):
        yield tokens[at:at + WORDS + 3]


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, list[bytes]]]:
    """About ``size`` bytes of text at a time, by language."""
    held, total = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[lang].append(text.as_py().encode("utf-8", "surrogatepass"))
            total += len(held[lang][-1])
            if total >= size:
                yield held
                held, total = defaultdict(list), 0
    if held:
        yield held


def _three(lang: np.uint64, hashes: np.ndarray, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hash of language and first three words."""
    key = (lang + hashes[first]) * _MULTIPLIER
    key = (key + hashes[rest >> 2 * _BITS]) * _MULTIPLIER
    return _mixed(key + hashes[rest >> _BITS & _MASK])


def _runs(bits: int, split: list[int], held: int, burst: int):
    apart = np.array(split, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, CHUNK_BYTES):
            tries, words = defaultdict(lambda: HatTrie(burst)), Vocabulary()
            for lang, mine in texts.items():
                for tokens in _parts(mine):
                    if len(words.numbers) + len(tokens) > _MASK:  # before numbers get too long
                        yield from _all_spilled(tries, words, held, bits, apart)
                        words = Vocabulary()
                    tries[lang].add(*words.sequences(tokens))
                    while sum(t.size for t in tries.values()) > held:
                        most = max(tries, key=lambda x: tries[x].size)
                        yield from _spilled(most, tries[most], held // 2, words, bits, apart)
            yield from _all_spilled(tries, words, held, bits, apart)

    return run


def _all_spilled(tries: dict[str, HatTrie], words: Vocabulary, held: int, bits: int, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lang, trie in tries.items():
        while trie.size:
            yield from _spilled(lang, trie, held, words, bits, apart)


def _spilled(lang: str, trie: HatTrie, entries: int, words: Vocabulary, bits: int, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
    first, rest, counts = trie.take(trie.largest(entries))
    hashes, texts = words.hashed(), pa.array(list(words.numbers), pa.binary())
    rank = np.empty(len(texts), np.int64)
    rank[pc.sort_indices(texts).to_numpy()] = np.arange(len(texts))
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
    keys, orders, fourth, phrases, sums = [], [], [], [], []

    def entry(key: np.ndarray, columns: list[np.ndarray], last: np.ndarray | None, mark: bytes, n: np.ndarray) -> None:
        order = np.zeros(len(n), np.int64)
        for c in columns:
            order = order << _BITS | rank[c]
        keys.append(key)
        orders.append(order << _BITS * (3 - len(columns)))
        fourth.append(np.zeros(len(n), np.int64) if last is None else rank[last] + 1)
        head = pc.binary_join_element_wise(*[texts.take(pa.array(c)) for c in columns], b" ") if len(columns) > 1 else texts.take(pa.array(columns[0]))
        phrases.append(head if last is None else pc.binary_join_element_wise(head, texts.take(pa.array(last)), mark))
        sums.append(n)

    def summed(*columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort(columns[::-1])
        new = np.any([np.diff(c[order], prepend=-1) != 0 for c in columns], axis=0)
        cut = np.flatnonzero(new)
        return *(c[order][cut] for c in columns), np.add.reduceat(n[order], cut)

    one, n_one = summed(first, n=counts)
    entry(_mixed(seed + hashes[one]), [one], None, b"", n_one)
    second, third, last = rest >> 2 * _BITS, rest >> _BITS & _MASK, rest & _MASK
    two = second > 0
    if two.any():
        a, b, n = summed(first[two], second[two], n=counts[two])
        entry(_mixed((seed + hashes[a]) * _MULTIPLIER + hashes[b]), [a, b], None, b"", n)
    three = np.flatnonzero(third > 0)
    key = _three(seed, hashes, first[three], rest[three])
    lone = np.isin(key, apart)
    if lone.any():
        at = three[lone]
        a, b, c, n = summed(first[at], second[at], third[at], n=counts[at])
        entry(_three(seed, hashes, a, b << 2 * _BITS | c << _BITS), [a, b, c], None, b"", n)
    for part, ended, mark in ((~lone & (last[three] == 0), True, b""), (~lone & (last[three] > 0), False, _JOINED), (lone & (last[three] > 0), False, _APART)):
        if part.any():
            at, own = three[part], key[part]
            if mark == _APART:
                own = _mixed(own + hashes[last[at]])
            entry(own, [first[at], second[at], third[at]], None if ended else last[at], mark, counts[at])
    entry(_mixed(np.array([seed])), [np.zeros(1, np.int64)], None, b"", np.array([counts.sum()]))  # "." alone: all words
    bucket = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(sum(map(len, keys)), np.int64)
    order = np.lexsort((np.concatenate(fourth), np.concatenate(orders), bucket))
    bucket, lines, sums = bucket[order], pa.concat_arrays(phrases).take(pa.array(order)), np.concatenate(sums)[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), lines), b"\n")
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for i, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        yield pa.RecordBatch.from_arrays([
            pa.array([bucket[x]], pa.int64()), pa.array([lang]), pa.array([squeeze(joined[i].as_py())], pa.binary()),
            pa.array([squeeze(sums[x:y].tobytes())], pa.binary())], names=["bucket", "lang", "phrases", "counts"])


def _frequent(least: int):
    """One partition: phrases of ``least`` occurrences or more, and for the phrase ``.`` the number of all words."""
    def run(cells: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        langs, phrases, counts = cells.column("lang").to_pylist(), cells.column("phrases"), cells.column("counts")
        out = []
        for lang in sorted(set(langs)):
            mine = [i for i, x in enumerate(langs) if x == lang]
            runs = pa.chunked_array([pa.array(open_(phrases[i].as_py()).split(b"\n"), pa.large_binary()) for i in mine])
            coded = runs.combine_chunks().dictionary_encode()
            n = np.concatenate([np.frombuffer(open_(counts[i].as_py()), np.int64) for i in mine])
            entries = coded.dictionary
            total = np.zeros(len(entries), np.int64)
            np.add.at(total, coded.indices.to_numpy(zero_copy_only=False), n)
            del runs, coded, n
            joined = pc.match_substring(entries, _JOINED).to_numpy(zero_copy_only=False)
            apart = pc.match_substring(entries, _APART).to_numpy(zero_copy_only=False)
            heads = pc.replace_substring_regex(entries, pattern=r"\t.*", replacement=b"").dictionary_encode()
            of = heads.indices.to_numpy(zero_copy_only=False)
            whole = np.zeros(len(heads.dictionary), np.int64)
            np.add.at(whole, of[~apart], total[~apart])
            lone = np.zeros(len(whole), bool)
            lone[of[apart]] = True
            some = (whole >= least) & ~lone | np.isin(np.arange(len(whole)), pc.index_in(pa.array([b"."], pa.large_binary()), heads.dictionary).to_numpy(zero_copy_only=False))
            more = (joined | apart) & (total >= least)
            for names, sums in ((heads.dictionary.filter(pa.array(some)), whole[some]), (pc.replace_substring_regex(entries.filter(pa.array(more)), pattern=r"[\t\v]", replacement=b" "), total[more])):
                out.append(pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "phrase": names.cast(pa.large_string()).cast(pa.string()), "n": pa.array(sums)}))
        return pa.concat_tables(out)

    return run


def _sampled_threes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _texts(batches, CHUNK_BYTES):
        for lang, mine in texts.items():
            for tokens in _parts(mine):
                words = Vocabulary()
                first, rest = words.sequences(tokens)
                seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
                keys, n = np.unique(_three(seed, words.hashed(), first, rest)[rest >> _BITS & _MASK > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def counted(docs: DataFrame, least: int = LEAST, bucket_bytes: int = BUCKET_BYTES, held: int = HELD, burst: int = BURST, sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, n) of phrases of up to four words with ``least`` occurrences; the phrase ``.`` has the number of all words."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    size = 5 * read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]  # four words a word, and their counts
    split = []
    if size > bucket_bytes:
        drawn = read.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(sample)) == 0).mapInArrow(_sampled_threes, "key long, n long")
        heavy = drawn.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * sample * 32 > max(1, bucket_bytes // 4))
        split = [r["key"] for r in heavy.orderBy(F.desc("n"), "key").limit(SPLIT).collect()]
    runs = read.mapInArrow(_runs(power_of_two(size / bucket_bytes), split, held, burst), _RUNS)
    return runs.groupBy("bucket").applyInArrow(_frequent(least), "lang string, phrase string, n long")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, **sizes: int) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score."""
    big = "decimal(38,0)"
    counts = written(counted(docs, least, **sizes), "phrases")
    totals = counts.where("phrase = '.'").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = counts.where("phrase <> '.'")
    candidates = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).withColumnRenamed("n", "a")
    size, words = F.size("words"), F.col("words")
    # contained in a longer phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: _part(words, s, m))))
    inner = candidates.where(size > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = candidates.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast(big) * 100 < F.col("a").cast(big) * share))
    # the cut that scores lowest
    cuts = free.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, size).alias("right"))
    ahead = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    behind = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(ahead, ["lang", "left"]).join(behind, ["lang", "right"]).withColumn(
        "score", F.expr(f"(cast(a as {big}) * 2000000) div (cast(l as {big}) + cast(r as {big}))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), F.asc("phrase"))
    first = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def query(spark, sf_dir):
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, len(w) - i + 1 AS room, w, i, unnest(range(1, {LONGEST + 1})) AS m FROM s),
f AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM g WHERE m <= room GROUP BY lang, w[i:i + m - 1], m HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
x AS (SELECT lang, ws, a, m, unnest(range(2, m)) AS size FROM c),
y AS (SELECT lang, ws, a, size, unnest(range(1, m - size + 2)) AS i FROM x),
z AS (SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM y GROUP BY 1, 2),
e AS (SELECT c.* FROM c LEFT JOIN z USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a),
k AS (SELECT *, unnest(range(1, m)) AS k FROM e),
q AS (SELECT k.lang, k.phrase, k.a, k.k, u.a AS l, v.a AS r, CAST((CAST(k.a AS HUGEINT) * 2000000) // (u.a + v.a) AS BIGINT) AS score
      FROM k JOIN f u ON u.lang = k.lang AND u.phrase = array_to_string(ws[1:k.k], ' ') JOIN f v ON v.lang = k.lang AND v.phrase = array_to_string(ws[k.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= {TOP}
"""
