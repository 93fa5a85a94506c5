"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import discard, written


def _star(edges: DataFrame, large: bool, spent: list[DataFrame]) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours of a node, or the smaller ones and the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # written, so that both sides of the join are plain shuffles and the rows of a hub can be split over tasks
    least = written(least.select("u", F.least("u", "m").alias("m")), "least")
    spent.append(least)
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (u, v).

    Each round writes its edges to the shared folder, so the plan stays short
    and lost executors cost one round.  Rounds are logarithmic in the size of
    the largest component; a table that has not settled after ``most`` raises.
    A null node is no node: edges with one are passed over, as are loops.
    """
    spent: list[DataFrame] = []

    def ordered(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(ordered(edges), "edges")
    before = mark(e)
    for _ in range(most):
        after = written(ordered(_star(_star(e, True, spent), False, spent)), "edges")
        discard(e, *spent)
        spent.clear()
        e, now = after, mark(after)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")
