"""Connected components of an edge table, by alternating stars; nothing goes to the driver but two
numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


SHARE = 1 << 12  # a node with more than this part of all edges is a hub; there are at most twice as many


def _stars(edges: DataFrame, n: int, *, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them and it: the larger ones of a large star
    (edges both ways), all smaller ones of a small star. ``n``: how many edges there are.

    The edges of hubs never come together: their smallest neighbours, a table of bounded size, are
    broadcast to where the edges lie. All other nodes have too few edges to weigh on a task."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree")).withColumnRenamed("a", "at")
    hubs = F.broadcast(least.filter(F.col("degree") * SHARE > n).select("at", "m"))
    at = F.col("a") == F.col("at")
    few = edges.join(hubs, at, "left_anti").join(least.filter(F.col("degree") * SHARE <= n).select("at", "m").hint("merge"), at)
    joined = edges.join(hubs, at).unionByName(few)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("at").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (a, b: long): root is the component's smallest
    node. Loops and repeated edges do no harm; without edges the result is empty."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        larger = materialise(_stars(edges, before[0], large=True), "edges")
        n = larger.count()
        old, edges = edges, materialise(_stars(larger, n, large=False), "edges")
        now = _sum(edges)
        forget(old, larger)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
