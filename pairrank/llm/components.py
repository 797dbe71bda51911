"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.runtime import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) for every node that has an edge to another.

    Alternates large-star and small-star steps until nothing changes, which takes a number
    of rounds logarithmic in the longest path. Each round's edges, at most as many as at
    first, are written, so a lost executor costs no earlier round.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    links = materialise(links, "links")
    seen = _signature(links)
    while seen[0]:
        # Every node passes its larger neighbours on to the smallest node it knows.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # And itself and its smaller neighbours likewise.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _signature(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _signature(links: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first())
