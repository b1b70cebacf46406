"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import written


def _star(edges: DataFrame, name: str) -> DataFrame:
    """The least neighbour (or itself) of each node u of edges (u, v): combined per task before the shuffle, then written,
    so that the join with the edges of a node of very many edges may be split."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
    return edges.join(least, "u")


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component for every node of edges (u, v): component is the least node that can be reached.

    Large-star links each node's larger neighbours with its least neighbour, small-star its smaller ones and itself.
    When an alternation changes nothing, every component is a star around its least node.  Loops and repeated edges do no
    harm; an empty table gives none.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    marks = _marks(now)
    for _ in range(most):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "cc-edges")
        small = _star(large, "cc-small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "cc-edges")
        after = _marks(now)
        if after == marks:
            break
        marks = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
