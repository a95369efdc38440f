"""Connected components of a table of links by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join back, so a node with very many links
is no bottleneck. Steps are written to the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbor of a node is linked to the smallest of the node and its neighbors."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbors are linked to the smallest of these."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b): the smallest node that can be reached.

    Self-links, repeated links and links with a null are ignored. No links give no rows.
    """
    e = materialize(links.select("a", "b").where("a != b").distinct(), "links")
    seen = None
    while True:
        e = materialize(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
