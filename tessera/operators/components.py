"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scratch import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that is not its component's smallest; root is that smallest node.

    A round makes every node point at its smallest neighbour, by a minimum and a
    join, never by gathering neighbours. The number of rounds grows with the
    logarithm of the longest path. Loops, repeats and both directions are fine.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct())
    raise RuntimeError("components did not settle")


def _stars(e: DataFrame) -> bool:
    """Whether every node points at one other, which points nowhere: then a round would change nothing."""
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("out")).union(e.select("v", F.lit(0)))
    return ends.groupBy("k").agg(F.sum("out").alias("n"), F.min("out").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty()
