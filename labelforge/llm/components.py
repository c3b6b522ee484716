"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import stored


def connected_components(spark: SparkSession, links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of the links; ``root`` is the smallest node
    of its component.  Links to itself are ignored; repeated links are harmless.

    Each round links every node's larger neighbours to its smallest neighbour
    (large star), then its smaller neighbours and itself (small star).  Minima
    are pre-aggregated and written, so that the joins can split a hub's rows.  Rounds
    are written to the shared folder; the driver sees a count and a checksum.
    """
    edges = stored(spark, links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(spark, both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = stored(spark, large, "large-star")
        low = stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(spark, small, "small-star")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
