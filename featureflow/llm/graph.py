"""Connected components of an edge table, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.sources.storage import checkpointed


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node it reaches.

    Each round moves every neighbour of a node to the smallest one it sees, first upwards and then
    downwards, so that paths halve and a hub needs one minimum (combined before the shuffle), never a
    list of its neighbours. The edges of a round are checkpointed; only a count and a checksum reach
    the driver. Loops, repeated edges and edges with a null end change nothing.
    """
    pairs = edges.where(F.col(a) != F.col(b))
    stars = checkpointed(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpointed(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        after = _signature(stars)
        if after == before:
            break
        before = after
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
