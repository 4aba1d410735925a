"""Connected components of an edge table by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest one around it;
small-star does so for the smaller neighbours. Both are one aggregate and one
join on ids; the number of rounds grows with the logarithm of the longest
chain. Every round is written, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snipflow.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) of every id of ``edges`` (a, b): the smallest id reachable.

    The steps written for the last rounds stay in ``scratch``."""
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .distinct(), f"{name}0")
    state, k = None, 0
    while True:
        new = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.bit_xor(F.xxhash64(F.lit(1), F.col("u"), F.col("v")))).first()
        if new == state or new[0] == 0:
            break
        state, k = new, k + 1
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low2.select("u", F.col("m").alias("v"))).distinct())
        e = scratch.save(small, f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 2}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
