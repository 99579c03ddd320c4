"""Connected components of an edge table, and the checkpoint folder of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; the component is its smallest id.

    Alternating large-star and small-star steps; each is an aggregate with a map-side part
    and a join that AQE splits where one id has very many edges.  The edge table is
    checkpointed after every round, so its lineage stays short and survives executors.
    """
    cur = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())

    def stars(df):
        """Whether every id has one edge and none is at both ends: nothing is left to do."""
        ends = df.select(F.col("u").alias("id"), F.lit(1).alias("out")).union(df.select("v", F.lit(0))).groupBy("id")
        return not ends.agg(F.sum("out").alias("out"), F.min("out").alias("least")).filter("out > 1 or (out = 1 and least = 0)").head(1)
    while not stars(cur):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # every edge now goes from a larger to a smaller id
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v"))).distinct())
        cur = cut_lineage(small)
    roots = cur.select(F.col("v").alias("u"), "v").distinct()
    return cur.union(roots).groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
