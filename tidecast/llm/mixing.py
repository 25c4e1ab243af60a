"""Mixing sources to target weights by a time-varying curriculum.

A source's weight is a base weight times a piecewise linear schedule over training time [0, 1]. The schedule's
integral is the source's cumulative token demand. Documents of a source stand in hash order; a document that begins
at the source's token c is trained where the demand reaches c, so demand is inverted to give its position. Tokens
beyond the source's size go round again (each document at most twice). Range-sorting by position is the mix.

Running token counts need no large window: documents fall into buckets by the first digits of an MD5 of id, source and text,
bucket totals are summed first, and only a bucket is ordered row by row, so a hot source is spread over all buckets.

Defined cases: a null text has no words and is never taken; a null source is a source of its own, last in order;
a null id hashes like an empty one; rows with equal hashes follow each other by id, size and the text's SHA-256; a very
long text is one number, its size; columns of any name may come along, but for names that begin with _llm_. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import ID, NULL_ID, digest_of, row_id, shown_id, text_of, written

#: Base weights by rank of the source in code-point order, repeating, and their schedules as (time, factor) knots:
#: the first class fades out, the second stays, the third comes in.
WEIGHTS = (3, 1, 2)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))
#: The mix takes HALVES / 2 of all words, and of a source at most REPEATS times its size.
HALVES, REPEATS = 3, 2
#: Rows that a bucket holds on average at most.
BUCKET_ROWS = 1024

_WORD = r"[^\x20\x09-\x0D]+"
_BIG = "decimal(38,0)"


def position_sql(u: str, kind: str, schedules=SCHEDULES) -> str:
    """Training time at which the share ``u`` of a source's demand is reached (SQL; ``kind`` is the schedule's number)."""
    arms = []
    for n, knots in enumerate(schedules):
        area = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:]))
        below, cases = 0.0, []
        for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
            y = f"({u} * {area!r}D - {below!r}D)"
            bend = 2 * (m1 - m0) / (t1 - t0)
            below += (t1 - t0) * (m0 + m1) / 2
            cases.append((below / area, f"{t0!r}D + 2.0D * {y} / ({m0!r}D + sqrt({m0 * m0!r}D + {bend!r}D * {y}))"))
        text = " ".join(f"WHEN {u} < {end!r}D THEN {f}" for end, f in cases[:-1])
        arms.append(f"WHEN {kind} = {n} THEN " + (f"CASE {text} ELSE {cases[-1][1]} END" if text else cases[-1][1]))
    return f"CASE {' '.join(arms)} END"


def targets(sizes: DataFrame, weights=WEIGHTS, halves: int = HALVES) -> DataFrame:
    """Water-filling over the table of sources (missing, source, source_size): kind, target, exact until one division."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("kind", (F.row_number().over(Window.orderBy("missing", "source")) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1).cast("long"))
    order = Window.orderBy((F.col("source_size").cast(_BIG) * 6 / F.col("weight")), "missing", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    big = {c: F.col(c).cast(_BIG) for c in ("source_size", "weight")}
    filled = (ranked
              .withColumn("budget", F.sum(big["source_size"]).over(everything) * halves)
              .withColumn("room", F.sum(big["weight"]).over(everything) - F.coalesce(F.sum(big["weight"]).over(before), F.lit(0).cast(_BIG)))
              .withColumn("left", F.col("budget") - F.coalesce(F.sum(big["source_size"]).over(before), F.lit(0).cast(_BIG)) * (2 * REPEATS))
              .withColumn("full", big["source_size"] * (2 * REPEATS) * F.col("room") <= big["weight"] * F.col("left")))
    spent = F.coalesce(F.sum(F.when(F.col("full"), big["source_size"])).over(everything), F.lit(0).cast(_BIG)) * (2 * REPEATS)
    open_weight = F.sum(F.when(~F.col("full"), big["weight"])).over(everything)
    share = (big["weight"] * (F.col("budget") - spent)).cast("double") / (open_weight * 2).cast("double")
    return filled.select("missing", "source", "source_size", "kind",
                         F.when(F.col("full"), (F.col("source_size") * REPEATS).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, halves: int = HALVES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), range-sorted by first position.

    Columns: doc_id, size, source_size, target, taken, first_position, second_position (null where not taken), and
    source and digest (the text's SHA-256), by which ``in_training_order`` finds the row again.
    """
    light = written(docs.select(
        row_id().alias(ID), F.regexp_count(text_of(), F.lit(_WORD)).cast("long").alias("size"),
        F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), digest_of().alias("digest")).select(
        ID, "size", "missing", "source", F.md5(F.concat_ws("|", "id", "source", F.lower(F.hex("digest"))).cast("binary")).alias("draw"), "digest"), "sizes")
    rows, digits = light.count(), 1
    while digits < 32 and rows > bucket_rows * 16**digits:
        digits += 1
    key = ["missing", "source", "bucket"]
    light = light.withColumn("bucket", F.substring("draw", 1, digits))
    buckets = light.groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("missing", "source").agg(F.sum("bucket_size").alias("source_size"))
    preceding = Window.partitionBy("missing", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(preceding), F.lit(0)))
              .join(targets(sizes, weights, halves), ["missing", "source"]).drop("bucket_size"))
    inside = Window.partitionBy(*key).orderBy("draw", ID, "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = (light.join(written(starts, "starts"), key)
              .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("goal", F.floor("target").cast("long")))

    def words(goal: Column) -> Column:
        return F.least(F.greatest(goal - F.col("at"), F.lit(0).cast("long")), F.col("size"))

    taken = (placed.withColumn("once", words(F.col("goal")))
             .withColumn("again", words(F.col("goal") - F.col("source_size")))
             .withColumn("u1", F.when(F.col("once") > 0, F.col("at") / F.col("target")))
             .withColumn("u2", F.when(F.col("again") > 0, (F.col("at") + F.col("source_size")) / F.col("target"))))
    out = taken.select(
        shown_id(ID).alias("doc_id"), "size", "source_size", "target", (F.col("once") + F.col("again")).alias("taken"),
        F.expr(position_sql("u1", "kind", schedules)).alias("first_position"),
        F.expr(position_sql("u2", "kind", schedules)).alias("second_position"),
        F.when(~F.col("missing"), F.col("source")).alias("source"), "digest")
    # the id splits the documents that are not taken, which have no position
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc()]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def in_training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` once per time the mix takes them, with all their columns, position and words taken, range-sorted.

    Rows are matched by id, source and digest of the text; of rows equal in these, the k-th gets the k-th row's turns, so
    that each turn meets one row. Rows and turns are dealt out together, once; a key's rows are as many as its copies.
    """
    source = F.col("source").cast("string")
    turns = mixed.where("taken > 0").select(
        row_id().alias(ID), source.alias("_llm_source"), F.col("digest").alias("_llm_digest"), F.lit(0).alias("_llm_side"),
        F.col("first_position").alias("_llm_first"), F.array(
            F.struct(F.col("first_position").alias("at"), F.least("taken", "size").alias("words")),
            F.struct(F.col("second_position").alias("at"), F.greatest(F.col("taken") - F.col("size"), F.lit(0)).alias("words")),
        ).alias("_llm_turns"))
    rows = docs.select(row_id().alias(ID), source.alias("_llm_source"), digest_of().alias("_llm_digest"), F.lit(1).alias("_llm_side"),
                       F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("_llm_row"))
    same = [ID, "_llm_source", "_llm_digest"]
    met = (turns.unionByName(rows, allowMissingColumns=True).repartition(*same)  # one exchange for both windows
           .withColumn("_llm_copy", F.row_number().over(Window.partitionBy(*same, "_llm_side").orderBy("_llm_first")))
           .withColumn("_llm_turns", F.lag("_llm_turns").over(Window.partitionBy(*same).orderBy("_llm_copy", "_llm_side")))
           .where("_llm_side = 1").select("_llm_row", F.explode("_llm_turns").alias("_llm_at")).where("_llm_at.at is not null"))
    out = met.select("_llm_row.*", F.col("_llm_at.at").alias("mix_position"), F.col("_llm_at.words").alias("mix_words"))
    return out.repartitionByRange("mix_position").sortWithinPartitions("mix_position")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "digest")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id, {NULL_ID}) AS i, source IS NULL AS missing, coalesce(source, '') AS s,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || sha256(coalesce(text, ''))) AS draw
           FROM documents),
src AS (SELECT missing, s, CAST(sum(size) AS HUGEINT) AS source_size, (row_number() OVER (ORDER BY missing, s) - 1) % 3 AS kind FROM d GROUP BY 1, 2),
w AS (SELECT *, CAST([3, 1, 2][kind + 1] AS HUGEINT) AS weight FROM src),
o AS (SELECT *, sum(source_size) OVER () * {HALVES} AS budget,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 6 // weight, missing, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
        sum(source_size) OVER () * {HALVES} - {2 * REPEATS} * coalesce(sum(source_size) OVER (ORDER BY source_size * 6 // weight, missing, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft
      FROM w),
f AS (SELECT *, {2 * REPEATS} * source_size * room <= weight * lft AS isfull FROM o),
t AS (SELECT missing, s, source_size, kind, CASE WHEN isfull THEN CAST({REPEATS} * source_size AS DOUBLE)
        ELSE CAST(weight * (budget - {2 * REPEATS} * coalesce(sum(source_size) FILTER (isfull) OVER (), 0)) AS DOUBLE)
             / CAST(2 * sum(weight) FILTER (NOT isfull) OVER () AS DOUBLE) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.kind, CAST(floor(t.target) AS BIGINT) AS goal,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.missing, d.s ORDER BY d.draw, d.i, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM d JOIN t USING (missing, s)),
q AS (SELECT *, least(greatest(goal - pos, 0), size) AS once, least(greatest(goal - source_size - pos, 0), size) AS again FROM p),
u AS (SELECT *, CASE WHEN once > 0 THEN pos / target END AS u1, CASE WHEN again > 0 THEN (pos + source_size) / target END AS u2 FROM q)
SELECT doc_id, size, source_size, target, once + again AS taken,
  CASE WHEN u1 IS NOT NULL THEN @1 END AS first_position,
  CASE WHEN u2 IS NOT NULL THEN @2 END AS second_position
FROM u
"""


def _duck(sql: str) -> str:
    """Spark's double literals (1.5D) as DuckDB writes them (1.5e0)."""
    return re.sub(r"(\d\.\d+)D\b", r"\1e0", sql)


SQL = SQL.replace("@1", _duck(position_sql("u1", "kind"))).replace("@2", _duck(position_sql("u2", "kind")))
