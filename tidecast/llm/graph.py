"""Connected components of a graph too large for one machine, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import written


def _ranked(node: str, turn: int | None) -> Column:
    rank = F.col(node) if turn is None else F.xxhash64(node, F.lit(turn))
    return F.struct(rank.alias("rank"), F.col(node).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; two different longs); root is one node of the component.

    Each round ranks the nodes, points a node at the lowest of itself and its neighbours, follows pointers twice and
    contracts the edges by them. Nodes rank by id, under which a star is done in two rounds; after two such rounds that
    each left over half of the edges, one round ranks them by a hash, new each time, under which only a share of a
    chain's nodes can be roots, in whatever order the ids lie along it. So long chains too shrink by a factor.
    Each round is a written table. Hubs cost a row per task in the aggregation, and in the joins they meet plain
    exchanges, which Spark splits.
    """
    level, steps, slow = edges.select("a", "b"), [], 0
    left = level.count()
    while True:
        turn, slow = (len(steps), 0) if slow == 2 else (None, slow)
        both = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = written(both.select("a", _ranked("b", turn).alias("other")).groupBy("a").agg(F.min("other").alias("low"))
                          .select(F.col("a").alias("node"), F.least(_ranked("a", turn), "low")["id"].alias("root")), "pointers")
        for _ in range(2):
            next_one = pointer.select(F.col("node").alias("root"), F.col("root").alias("further"))
            pointer = pointer.join(next_one, "root").select("node", F.col("further").alias("root"))
        pointer = written(pointer, "pointers")
        steps.append(pointer)
        at_a = pointer.select(F.col("node").alias("a"), F.col("root").alias("x"))
        at_b = pointer.select(F.col("node").alias("b"), F.col("root").alias("y"))
        level = written(level.join(at_a, "a").join(at_b, "b").where("x <> y")
                        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        before, left = left, level.count()
        if not left:
            break
        if turn is None:
            slow = slow + 1 if 2 * left > before else 0
    found = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = written(found.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
    return found
