"""Connected components by DataFrame rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that occurs in edges. Nodes are longs; nulls and loops are ignored.

    Each round is written to the shared folder and reads only the last one's rows; their number never grows. The number of
    rounds grows with the logarithm of a component's size; the loop ends when a round changes nothing.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = written(links, "links")
    mark = (0, None)
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        # large-star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")  # a plain table lets adaptive execution split a hot node
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small-star: u itself and every smaller neighbour are linked to the smallest
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
