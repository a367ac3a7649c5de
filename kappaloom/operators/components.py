"""Connected components of an edge table by alternating large-star and small-star steps.

Each step points neighbours at the smallest node they know, with a partial
aggregate and an equality join, so no task and no driver ever holds a whole
component; a hub's edges are divided by the skew join. The number of steps
grows with the logarithm of the longest path. Every round is written to the
shared folder, so a lost executor costs at most one round. Rounds end as soon as
the edges are stars, which one count tells, so pairs that are stars already need none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, staged_at


def _towards_least(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """edges (u, v): every listed neighbour v of u, and u itself, is linked to the least of them."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hop = edges.join(least, "u")
    if keep_larger:
        out = hop.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hop.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node a of the edges (a, b) has a second edge, as a or as b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf")))
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("n"))
    return not nodes.where("leaf > 0 AND n > 1").agg(F.count("*")).first()[0]


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: two columns a, b of one orderable type, nulls and self-loops ignored.

    Returns (node, component): each node that has an edge, with the least node it reaches.
    """
    a, b = edges.columns[:2]
    plain = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now, path = staged_at(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _stars(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _towards_least(both, keep_larger=True)
        small = _towards_least(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), keep_larger=False)
        after, after_path = staged_at(small, "edges")
        remove(now.sparkSession, path)
        now, path = after, after_path
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
