"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins over edges that only shrink towards stars; the edges
are written to the shared folder after each round, so no lineage piles up and no link or label
passes the driver. A hub costs one row per task in the aggregations, and its edges are a skewed
equality join, which the adaptive join splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.session import written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node hang on its smallest neighbour, or on itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) but the roots themselves.

    The root is the component's smallest node. Loops and null ends are ignored; an empty table
    gives an empty result.
    """
    c = F.col
    now = edges.filter(c("u") != c("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(now.distinct(), "edges")
    before = None
    while (digest := _digest(now)) != before:
        before = digest
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
    return now.select(c("u").alias("node"), c("v").alias("root"))
