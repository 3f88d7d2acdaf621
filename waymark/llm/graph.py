"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b: long). Large-star and small-star steps in turn
    until only separate stars are left; each step is a minimum per node and a join, so a node of very many edges is
    combined before it is shuffled and its join side may be split. No edges: no rows."""
    now = materialize(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct())
    while True:
        # stars that share no node are components
        shared = now.groupBy("high").agg(F.count("*").alias("n")).filter("n > 1").select("high")
        inner = now.select(F.col("low").alias("high")).join(now.select("high"), "high", "left_semi")
        if not shared.unionAll(inner).limit(1).count():
            break
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        small = large.withColumnRenamed("high", "u").join(least, "u").select("m", F.explode(F.array("low", "u")).alias("high")).filter("m < high")
        now = materialize(small.select(F.col("m").alias("low"), "high").distinct())
    own = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(own)
