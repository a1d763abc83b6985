"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import compact, materialise


#: Edges of a partition.
EDGES = 250_000


def is_forest(e: DataFrame) -> bool:
    """Whether every node points to one other node, and that one to none."""
    n = e.rdd.getNumPartitions()
    inner = e.select("u").union(e.select("v").distinct()).groupBy("u").count().where("count > 1").coalesce(n)
    return inner.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component its smallest node.

    Each round is a grouped minimum and a join on the node, both with map-side
    combining; a node with many neighbours is split by adaptive skew joins.
    Nulls and loops are ignored. Rounds grow with the logarithm of the largest
    component, and each is checkpointed, so a lost executor costs one round. The
    number of edges, which never grows twofold in a round, sets that of partitions.
    """
    e = compact(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), EDGES)
    while not is_forest(e):
        n = e.rdd.getNumPartitions()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(2 * n))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        # (v, m) of every edge, and (u, m) once
        stars = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        e = materialise(stars.distinct().coalesce(2 * n))
        e = e.coalesce(n)
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(e.select("v", "v").distinct().toDF("node", "component")).distinct()
