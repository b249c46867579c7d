"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; a component is named by its smallest node.

    ``links`` has (a, b). Rounds of large-star and small-star steps: each node's larger
    neighbours move to its smallest one, then its smaller ones do. Every round is a
    written table, so lineage stays short and lost executors cost a read; the number of
    rounds grows with the logarithm of a component's width, and they end when one changes nothing. Smallest neighbours are found by an
    aggregate and joined back, so a node with very many links is pre-aggregated and its
    join can be split.
    """
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: (larger neighbour, smallest).
        large = edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: now every edge points down; the node and its neighbours point to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        edges = written(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
