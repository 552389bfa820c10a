"""Connected components of a table of links, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import written


def connected(links: DataFrame) -> DataFrame:
    """Components of links (a, b: long): a row (node, comp) for each node with a link; comp is the smallest node.

    Large-star and small-star rounds: each node's larger neighbours, then its smaller ones, are linked to its smallest
    neighbour. Rounds go on until the links don't change, about the logarithm of the longest chain; stars, the usual
    case, need two. Links of a node are never gathered; each round's table is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
