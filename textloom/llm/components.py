"""Connected components of links, by alternating large and small stars.

Each step is an aggregation with partial sums and an equi-join on nodes; no neighbourhood is gathered anywhere, and what
the driver sees of a round is whether it was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, thin


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every node with a link; root is the least node of its component."""
    edges = thin(cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    while True:
        # done once every node has one edge, to a node that has none
        joints = edges.groupBy("u").agg(F.count("*").alias("n"))
        inner = edges.select(F.col("v").alias("u")).distinct().join(joints, "u", "left_semi").select(F.lit(1).alias("x"))
        if inner.unionByName(joints.where("n > 1").select(F.lit(1).alias("x"))).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = thin(cut(small.where("u <> v").distinct()))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
