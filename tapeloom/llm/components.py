"""Connected components of a table of links, by alternating large-star and small-star steps over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: of each node, the larger neighbours are linked to the least of it and its neighbours. Small star: of each
    node, the smaller neighbours and itself are linked to the least of them. ``edges``: a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        made = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        made = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        made = made.unionByName(least.select("a", F.col("least").alias("b")))
    return made.filter("a != b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node that ``links`` (a, b) name; self-links count as nodes
    without others. An empty table gives no rows."""
    nodes_alone = links.filter("a = b").select(F.col("a").alias("node"))
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).alias("mark")
    before = edges.agg(mark).head()["mark"]
    for _ in range(most):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(mark).head()["mark"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = nodes_alone.distinct().join(named.unionByName(roots).select("node").hint("merge"), "node", "left_anti")
    return named.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))
