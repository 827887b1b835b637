"""Bounded relationship traversal: one join a hop instead of one call a node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paging import MAX_HOPS
from .closure import cut

# Fixed values of the query contract.
EDGES_PER_NODE, MAX_EDGES, MAX_NODES = 100, 2000, 500


def hop_paths(edges: DataFrame, starts: DataFrame, max_hops: int = 1, per_node: int | None = EDGES_PER_NODE, max_edges: int = MAX_EDGES, max_nodes: int = MAX_NODES) -> DataFrame:
    """start, hops, nodes, edge_ids, truncated of all simple paths of 1..max_hops hops from each start.

    edges: edge_id, source, target, rank (the order of a node's edges; edge_id, as text, decides ties); starts: start. A node is
    expanded once for each start, on the first path that reaches it (in the order of hops, then of the path's edges), but
    every path that reaches it is returned. per_node: edges followed from one node; max_edges, max_nodes: edges followed
    and nodes expanded from one start, in the same order. truncated: the start's paths met one of these bounds.
    """
    if isinstance(max_hops, bool) or not isinstance(max_hops, int) or not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be an integer from 1 to {MAX_HOPS}")
    edges = edges.select("source", "target", F.struct(F.col("rank").cast("long").alias("rank"), F.col("edge_id").cast("string").alias("edge_id")).alias("edge"))
    path = F.array().cast("array<struct<rank:bigint,edge_id:string>>")
    frontier = starts.select("start", F.array("start").alias("nodes"), path.alias("path"), F.col("start").alias("at"))
    expanded = starts.select("start", F.col("start").alias("at"))
    used = starts.select("start", F.lit(0).cast("long").alias("used"))
    cuts, out = [], None
    for hops in range(1, max_hops + 1):
        reached = frontier.join(edges, frontier.at == edges.source).drop("source")
        if per_node is not None:
            # only edges of the frontier are ranked, and the limit goes before the shuffle; one edge beyond it shows that there are more
            nth = F.row_number().over(Window.partitionBy("start", "at").orderBy("edge"))
            reached = cut(reached.withColumn("nth", nth).where(F.col("nth") <= per_node + 1))
            cuts.append(reached.where(F.col("nth") > per_node).select("start"))
            reached = reached.where(F.col("nth") <= per_node)
        # what one start follows is bounded by max_nodes pages
        turn = F.row_number().over(Window.partitionBy("start").orderBy("path", "edge"))
        reached = cut(reached.join(used, "start").withColumn("turn", turn + F.col("used")))
        cuts.append(reached.where(F.col("turn") > max_edges).select("start"))
        reached = reached.where(F.col("turn") <= max_edges)
        paths = reached.where(~F.array_contains("nodes", F.col("target"))).select("start", F.lit(hops).alias("hops"), F.concat("nodes", F.array("target")).alias("nodes"), F.concat("path", F.array("edge")).alias("path"), F.col("target").alias("at"))
        out = paths if out is None else out.union(paths)
        if hops < max_hops:
            first = F.row_number().over(Window.partitionBy("start", "at").orderBy("path"))
            fresh = paths.join(expanded, ["start", "at"], "left_anti").withColumn("nth", first).where("nth = 1").drop("nth")
            held = expanded.groupBy("start").agg(F.count("*").alias("held"))
            fresh = fresh.join(held, "start").withColumn("nth", F.row_number().over(Window.partitionBy("start").orderBy("path")) + F.col("held"))
            fresh = cut(fresh)
            cuts.append(fresh.where(F.col("nth") > max_nodes).select("start"))
            frontier = fresh.where(F.col("nth") <= max_nodes).select("start", "nodes", "path", "at")
            expanded = expanded.union(frontier.select("start", "at"))
            used = used.join(reached.groupBy("start").agg(F.count("*").alias("more")), "start", "left").select("start", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"))
    short = reduce(DataFrame.union, cuts).distinct().withColumn("truncated", F.lit(True))
    return out.join(short, "start", "left").select("start", "hops", "nodes", F.col("path.edge_id").alias("edge_ids"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
