"""Connected components of a link table, by alternating stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.store import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on links (a > b): link neighbours to the smallest one.

    The large step links every larger neighbour of a node, the small step every smaller
    one. Both keep the components. The smallest neighbour is an aggregate with partial
    sums; links meet it in an equi-join, so a node with many links can be split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = written(low.select("a", F.least("a", "m").alias("m")), "stars")
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = written(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")
        linked = edges.join(low, "a")
        out = linked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(low.select("a", F.col("m").alias("b")))
    return out.distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b); component is the smallest node.

    Nulls and loops link nothing; repeated and reversed links count once; no links give
    no rows. Each step is written to the shared folder; only two sums reach the driver.
    """
    clean = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(clean.distinct(), "links")
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == state:
            break
        state = tuple(mark)
        edges = written(_stars(written(_stars(edges, True), "large"), False), "small")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
