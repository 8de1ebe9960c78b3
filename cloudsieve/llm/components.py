"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MOST_ROUNDS = 60
#: Edges of one partition, about.
PARTITION = 20_000


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs`` (u, v): link every v (and, for ``small``, u itself) to the least node around u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = pairs.join(least, "u")
    if small:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
    return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an edge, ``root`` being the least node of its component.

    Large-star and small-star steps alternate until the edge set no longer changes; it is then one star per
    component. Each round costs groupings and joins keyed by node, which adaptive execution splits when a node is
    hot; the number of edges never grows. Only a count and a checksum of the edges reach the driver.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    check = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = check(edges)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the number of edges never grows, so the last count says how many partitions they need
        edges = cut_lineage(_stars(_stars(both, small=False), small=True).coalesce(1 + seen[0] // PARTITION))
        now = check(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
