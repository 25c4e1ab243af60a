"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

A window is N consecutive words of a benchmark item (all words of a shorter item). Any place where a document holds a
window of L words covers a whole block of b = (min(L, N) + 1) / 2 words counted from the document's start, so the scan
hashes only every b-th position and looks those hashes up among all b-grams of the benchmark. A hit carries the words
around it; the windows in them are compared, as text, with the benchmark's. What remains are true occurrences only.

DataFrame operations only. The n-gram sets are broadcast behind a check of their size and joined by shuffle beyond it.
The documents are read once, and what leaves the scan is one row per document plus its hits.

Words: A-Z lower-cased, then runs of digits, letters a-z and all characters beyond ASCII.

Defined cases: null texts have no words; an item without words has no windows; items with equal windows all count;
rows with a null or repeated id are judged apart (rows are told apart by id and digest of the text, so equal rows
count once each with the same result); an empty benchmark leaves every document clean; an empty table gives an empty
result; a very long text is scanned whole. Other columns are ignored, whatever their names; ``clean_rows`` and
``without_spans`` return them, but for names that begin with _llm_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ID, digest_of, row_id, shown_id, text_of, without, written

#: Words of a window.
N = 10
#: Benchmark n-grams that are broadcast at most (16 bytes each in the hash table; windows carry their text, about 100).
BROADCAST_GRAMS, BROADCAST_WINDOWS = 4_000_000, 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(column: str = "text") -> Column:
    """The words of the text, in order, with one space between them."""
    return F.trim(F.regexp_replace(F.translate(text_of(column), _UPPER, _LOWER), _NO_WORD, " "))


def _grams(words: Column, length: Column) -> Column:
    """All runs of ``length`` words, joined by spaces; none where there are fewer."""
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, length), " "))


def _bounded(df: DataFrame, bound: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item, length, gram) for every distinct window of every item (item_id, text); item is the id as text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normalised().alias("norm")).where("norm <> ''")
    split = items.select("item", F.split("norm", " ").alias("words"))
    sized = split.withColumn("length", F.least(F.size("words"), F.lit(n)))
    return sized.select("item", "length", F.explode(_grams(F.col("words"), F.col("length"))).alias("gram")).distinct()


def _block_size(length: Column) -> Column:
    return F.floor((length + 1) / 2).cast("int")


def occurrences(docs: DataFrame, benchmark_windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` as (id, digest, n_words), and the occurrences as (id, digest, at, length, gram)."""
    grams = benchmark_windows.withColumn("b", _block_size(F.col("length")))
    pieces = grams.select("b", F.explode(_grams(F.split("gram", " "), F.col("b"))).alias("piece")).distinct()
    keys = pieces.select(F.xxhash64("piece", "b").alias("key")).distinct().withColumn("hit", F.lit(True))
    sizes = sorted(r["b"] for r in grams.select("b").distinct().collect())  # at most (n + 1) / 2 numbers
    base = docs.select(row_id().alias(ID), digest_of().alias("digest"), normalised().alias("norm"))
    n_words = F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)

    def pieces_of(b: int) -> Column:
        return F.regexp_extract_all("norm", F.lit("(?:[^ ]+ ){0,%d}+[^ ]+" % (b - 1) if b > 1 else "[^ ]+"), F.lit(0)).alias(f"f{b}")

    def blocks(b: int) -> Column:
        found = F.col(f"f{b}")  # a column of its own, so that it isn't cut anew for each of its elements
        return F.transform(found, lambda x, i: F.struct(
            F.lit(b).alias("b"), i.alias("i"), F.when(i > 0, F.get(found, i - 1)).alias("before"), x.alias("piece"), F.get(found, i + 1).alias("after")))

    cut = base.select(ID, "digest", n_words.cast("long").alias("n_words"), *[pieces_of(b) for b in sizes])
    first = F.array(F.struct(F.lit(0).alias("b"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("before"),
                             F.lit("").alias("piece"), F.lit(None).cast("string").alias("after")))
    # outer, though never empty: else the size of the array becomes a filter, and all of it is computed twice
    scanned = cut.select(ID, "digest", "n_words", F.explode_outer(F.concat(first, *[blocks(b) for b in sizes])).alias("x"))
    scanned = scanned.select(ID, "digest", "n_words", "x.*").withColumn("key", F.xxhash64("piece", "b"))
    met = scanned.join(_bounded(keys, BROADCAST_GRAMS), "key", "left").where("hit or i = -1")
    kept = written(met.select(ID, "digest", "n_words", "b", "i", "before", "piece", "after"), "grams")
    around = kept.where("i >= 0").select(
        ID, "digest", "b", (F.col("i") * F.col("b") - F.when(F.col("before").isNull(), 0).otherwise(F.col("b"))).alias("start"),
        F.split(F.concat_ws(" ", "before", "piece", "after"), " ").alias("words"))
    lengths = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda d: 2 * F.col("b") - 1 + d)
    tried = around.select(ID, "digest", "start", "words", F.explode(lengths).alias("length"))
    placed = tried.select(ID, "digest", "start", "length", F.posexplode(_grams(F.col("words"), F.col("length"))).alias("offset", "gram"))
    windows_only = _bounded(benchmark_windows.select("length", "gram").distinct(), BROADCAST_WINDOWS)
    true = placed.join(windows_only, ["length", "gram"]).select(
        ID, "digest", (F.col("start") + F.col("offset")).alias("at"), "length", "gram").distinct()
    return kept.where("i = -1").select(ID, "digest", "n_words"), true


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_sha256."""
    grams = written(windows(benchmark, n), "windows")
    rows, found = occurrences(docs, grams)
    key = [ID, "digest"]
    found = written(found, "occurrences")
    cover = F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("length") - 1))))
    hits = found.select(*key, "at", "length").distinct().groupBy(*key).agg(F.size(cover).cast("long").alias("n_hit"))
    items = (found.select(*key, "length", "gram").distinct().join(_bounded(grams, BROADCAST_WINDOWS), ["length", "gram"])
             .select(*key, "item").distinct().groupBy(*key)
             .agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names")))
    judged = written(hits.join(items, key), "contaminated")
    out = rows.join(judged, key, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        shown_id(ID).alias("doc_id"), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def clean_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = decisions.where("contaminated").select(row_id().alias("id"), F.unhex("text_sha256").alias("digest"))
    return without(docs, written(bad.distinct(), "dropped"))


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text) of every row, normalised, without the words that lie inside an occurrence."""
    _, found = occurrences(docs, written(windows(benchmark, n), "windows"))
    key = [ID, "digest"]
    cover = found.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("length") - 1)))).alias("covered"))
    keyed = docs.select(row_id().alias(ID), digest_of().alias("digest"), normalised().alias("norm"))
    joined = keyed.join(cover, key, "left")
    rest = F.filter(F.split("norm", " "), lambda w, i: ~F.array_contains("covered", i))
    return joined.select(shown_id(ID).alias("doc_id"), F.when(F.col("covered").isNull(), F.col("norm")).otherwise(F.array_join(rest, " ")).alias("text"))


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_sha256")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {N}) AS l, unnest(list_transform(range(1, greatest(len(w), {N}) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) AS g FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dl AS (SELECT doc_id, w, l FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dw AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM dl),
h AS (SELECT doc_id, dw.i, dw.l, item FROM dw JOIN bw USING (l, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
