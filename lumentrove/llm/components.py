"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined in the map tasks) and a join back on
the node; the tables are written to the shared folder between rounds, so the
lineage stays short and no link or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def table_digest(links: DataFrame) -> tuple[int, ...]:
    """Count and 128 order-free bits of a table of distinct links, which tell two of them apart without a shuffle of either."""
    return tuple(links.agg(F.count(F.lit(1)), *[F.coalesce(F.bit_xor(F.xxhash64(F.lit(salt), "u", "v")), F.lit(0)) for salt in (1, 2)]).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Null ends and self-links are ignored; repeated links count once.  A round
    that changes the links moves some node to a smaller one and none to a larger
    one, so the rounds come to an end; there are about as many as the logarithm
    of the longest path.
    """
    now = scratch.materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    last = table_digest(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = scratch.materialise(small, "links")
        told = table_digest(new)
        changed = told != last
        scratch.release(now)
        now, last = new, told
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
