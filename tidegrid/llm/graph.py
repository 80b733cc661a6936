"""Connected components by alternating star operations; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v): the smallest node it can reach.

    Large star ties the larger neighbours of a node to its smallest one, small star the
    smaller ones. Both keep components, and end in stars whose centres are the labels."""
    spark = edges.sparkSession
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(least, "u")
        e = written(tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(tied.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        e.select(F.col("v"), F.col("v")).distinct())
