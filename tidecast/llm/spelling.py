"""Spelling variants: words one edit apart, found by pivotal grams, grouped under their most frequent form.

1. Runs of letters are counted in the tasks, then by word. A run whose CRC-32 with its document's id is divisible by
   ``SLIPS`` loses a letter, always the same one; this makes the slips of the pen that the operator is to undo.
2. The bigrams of a word are ordered from the rarest (by the number of places in distinct words) to the most common.
   Its prefix holds the first three and all equal in rank to the third. Two of the prefix that don't overlap, the rarest
   such two by dynamic programming, are its pivots. One edit leaves one of two disjoint pivots as it is. That pivot is in
   the other word's prefix if the other's last prefix gram isn't rarer, so each pair is found from one of its sides.
3. Position limits: the edit lies on one side of the pivot that stays, so the letters from the other end of the word up to
   the pivot are the same in both words. The join key is a hash of these letters: of the beginning up to and with the
   gram, or of the rest from the gram on. Lengths differ by at most one. The edit distance decides.
4. A word's form is its near word of largest count, if at least ``TIMES`` times its own. Forms grow along the way, so
   that roots are found by doubling pointers a few times.

Only the table of bigrams comes to the driver: the alphabet has 90 letters, so at most 8,100 rows. Texts are read once;
all else works on distinct words.

Defined cases: a null text has no words; a null id is written as nothing before the colon; equal rows count each; of near
words of equal count the smallest in code-point order is the form; a long text or word is treated like any other; an empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import text_of, written

#: Letters of a word, occurrences of a word, and how many times a word's own count its form must have, at least.
LETTERS, LEAST, TIMES = 6, 5, 5
#: One run in so many loses a letter.
SLIPS = 199
#: Words, and letters of words, that a task counts before it passes them on.
HELD_WORDS, HELD_LETTERS = 300_000, 20_000_000

_RUN = "[a-zÀ-ÿ]{%d,}"
_MODULUS, _BASE = 2**61 - 1, 1_000_003


def _counts(letters: int, slips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total, size = re.compile(_RUN % letters).findall, Counter(), 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = zlib.crc32(f"{one}:".encode())
                lower = text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, so A-Z only
                for word, n in Counter(runs(lower)).items():
                    drawn = zlib.crc32(word.encode(), begun)
                    if drawn % slips == 0:
                        k = drawn % len(word)
                        word = word[:k] + word[k + 1:]
                        if len(word) < letters:
                            continue
                    if word not in total:
                        size += len(word)
                    total[word] += n
                if len(total) >= HELD_WORDS or size >= HELD_LETTERS:
                    yield passed_on()
                    total, size = Counter(), 0
        if total:
            yield passed_on()

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = Counter()
        for word in batch.column(0).to_pylist():
            total.update(map("".join, zip(word, word[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])


def pivots_of(places: list[tuple[int, int]]) -> list[int]:
    """Of grams as (position, weight), in order of position, the positions of the two of least weight that don't overlap."""
    best_one: list[tuple[int, int]] = []  # the lightest single gram among the first i, as (weight, position)
    best_two: tuple[int, list[int]] | None = None
    for i, (p, w) in enumerate(places):
        fit = i - 1 if i and places[i - 1][0] + 1 < p else i - 2  # the last gram that ends before this one
        if fit >= 0:
            found = (best_one[fit][0] + w, [best_one[fit][1], p])
            best_two = found if best_two is None else min(best_two, found)
        best_one.append(min(best_one[-1], (w, p)) if best_one else (w, p))
    return best_two[1] if best_two else []


def _keys(weights: dict[str, int]):
    """Rows (word, n, letters, last, pivot, key): the keys of a word's prefix grams, those of its pivots marked."""
    ranks = {g: r for r, (_, g) in enumerate(sorted((n, g) for g, n in weights.items()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = list(map("".join, zip(word, word[1:])))
                rank = [ranks[g] for g in grams]
                last = sorted(rank)[2]
                prefix = [p for p, r in enumerate(rank) if r <= last]
                pivots = set(pivots_of([(p, weights[grams[p]]) for p in prefix]))
                codes = [ord(c) for c in word]
                begins = list(accumulate(codes, lambda h, c: (h * _BASE + c) % _MODULUS, initial=1))
                ends = list(accumulate(reversed(codes), lambda h, c: (h * _BASE + c) % _MODULUS, initial=1))
                for p in prefix:
                    for key in (begins[p + 2], ends[len(word) - p] | 1 << 61):
                        rows.append((word, n, len(word), last, p in pivots, key))
            columns = zip(*rows) if rows else [[]] * 6
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["word", "n", "letters", "last", "pivot", "key"])

    return run


def words(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, slips: int = SLIPS) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    return read.mapInArrow(_counts(letters, slips), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) once for each two words (word, n), of four letters at least, that are one edit apart."""
    grams = vocabulary.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    weights = {r["gram"]: r["n"] for r in grams.collect()}  # at most 90 * 90
    keyed = vocabulary.select("word", "n").mapInArrow(_keys(weights), "word string, n long, letters int, last int, pivot boolean, key long")
    keyed = written(keyed, "grams")
    one = keyed.where("pivot").select("key", *[F.col(c).alias(f"{c}_a") for c in ("word", "n", "letters", "last")])
    other = keyed.select("key", *[F.col(c).alias(f"{c}_b") for c in ("word", "n", "letters", "last")])
    alike = ((F.abs(F.col("letters_a") - F.col("letters_b")) <= 1) & (F.col("last_a") <= F.col("last_b")) & (F.col("word_a") != F.col("word_b")))
    met = one.join(other, (one["key"] == other["key"]) & alike & (F.levenshtein("word_a", "word_b", 1) == 1))
    a, b = F.struct(F.col("word_a").alias("word"), F.col("n_a").alias("n")), F.struct(F.col("word_b").alias("word"), F.col("n_b").alias("n"))
    return (met.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()
            .select(F.col("low.word").alias("a"), F.col("low.n").alias("n_a"), F.col("high.word").alias("b"), F.col("high.n").alias("n_b")))


def group(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, times: int = TIMES, slips: int = SLIPS) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    if letters < 4:
        raise ValueError("words of fewer than four letters have no two disjoint bigrams")
    vocabulary = written(words(docs, letters, least, slips), "words")
    pairs = written(near_pairs(vocabulary), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    big = -F.col("best.less") >= F.col("n") * times
    judged = written(vocabulary.join(best, "word", "left").select(
        "word", F.when(big, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(big, -F.col("best.less")).alias("form_n")), "forms")
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The letters beyond ASCII, and characters of one byte that stand for them where the edit distance counts bytes.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(c for c in map(chr, range(35, 127)) if not ("a" <= c <= "z" or c == "'"))[:64]

SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda acc, x: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, b)) AS crc),
d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
u AS (SELECT r, id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) AS run FROM d),
g AS (SELECT id, run, count(*) AS n FROM u WHERE length(run) >= {LETTERS} GROUP BY r, id, run),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
        ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END)) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda acc, x: xor(acc >> 8, t.crc[(xor(acc, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS len, translate(word, '{_WIDE}', '{_NARROW}') AS narrow FROM s WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {LEAST}),
p AS (SELECT x.word, y.word AS other, y.n AS other_n FROM v x JOIN v y ON x.word <> y.word AND abs(x.len - y.len) <= 1 AND levenshtein(x.narrow, y.narrow) = 1),
m AS (SELECT word, n_near, other, other_n FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM p) WHERE k = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * n THEN other END AS form, CASE WHEN other_n >= {TIMES} * n THEN other_n END AS form_n FROM v LEFT JOIN m USING (word)),
w AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL),
o AS (SELECT word, arg_max(here, step) AS root FROM w GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
"""
