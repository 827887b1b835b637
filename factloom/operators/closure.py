"""Transitive closures and merge components by rounds of joins; each round is cut by a written checkpoint."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all run on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", reflexive: bool = False, max_depth: int = 64, start: tuple[str, object] | None = None) -> DataFrame:
    """child, parent, depth (shortest) for every pair connected upwards; with reflexive also each node and itself at depth 0.

    start: ("child", value) or ("parent", value) follows paths from that node alone, instead of finding all pairs first. Semi-naive: a
    round joins only the pairs found last with the edges, and keeps those not known yet, so cycles end; it writes
    the new pairs alone. Raises if max_depth rounds do not suffice, instead of leaving pairs out.
    """
    step = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct()
    down = start is not None and start[0] == "parent"
    fixed, moving = ("parent", "child") if down else ("child", "parent")
    found = step if start is None else step.where(F.col(start[0]) == start[1])
    frontier = cut(found.withColumn("depth", F.lit(1)))
    known = [frontier]
    ahead = step.select(F.col(fixed).alias("mid"), F.col(moving).alias("end"))
    for depth in range(2, max_depth + 2):
        new = frontier.select(fixed, F.col(moving).alias("mid")).join(ahead, "mid").select(fixed, F.col("end").alias(moving)).distinct()
        old = reduce(DataFrame.union, known).select("child", "parent")
        frontier = cut(new.join(old, ["child", "parent"], "left_anti").select("child", "parent", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"the hierarchy is deeper than {max_depth}")
        known.append(frontier)
    out = reduce(DataFrame.union, (k.select("child", "parent", "depth") for k in known))
    if reflexive:
        nodes = step.select("child").union(step.select("parent")).distinct()
        if start is not None:
            nodes = nodes.where(F.col("child") == start[1])
        out = out.where("child <> parent").union(nodes.select("child", F.col("child").alias("parent"), F.lit(0).alias("depth")))
    return out


def redirects(merges: DataFrame, splits: DataFrame | None = None, max_depth: int = 100) -> DataFrame:
    """duplicate, survivor: the last live merge of each duplicate, followed to the end of its chain.

    merges, splits: duplicate, survivor, sequence. A split undoes a merge into the same survivor if it comes later.
    Pointer jumping halves the chains each round, so a chain of length n takes log2(n) rounds.
    """
    state = merges.select("duplicate", "survivor", "sequence", F.lit(True).alias("merged"))
    if splits is not None:
        state = state.union(splits.select("duplicate", "survivor", "sequence", F.lit(False)))
    last = state.groupBy("duplicate").agg(F.max_by(F.struct("survivor", "merged"), "sequence").alias("s"))
    now = last.where("s.merged and duplicate <> s.survivor").select("duplicate", F.col("s.survivor").alias("survivor"))
    rounds = max(1, max_depth.bit_length())
    for _ in range(rounds):
        ahead = now.select(F.col("duplicate").alias("mid"), F.col("survivor").alias("end"))
        joined = now.join(ahead, now.survivor == ahead.mid, "left")
        new = cut(joined.select("duplicate", F.coalesce("end", "survivor").alias("survivor"), F.col("end").isNotNull().alias("moved")))
        now = new.select("duplicate", "survivor")
        if new.where("moved").isEmpty():
            return now
    raise ValueError("merge chains form a cycle or exceed the depth")


def canonical(df: DataFrame, column: str, redirect: DataFrame) -> DataFrame:
    """df with the column's merged ids replaced by their survivors."""
    r = redirect.select(F.col("duplicate").alias("_d"), F.col("survivor").alias("_s"))
    return df.join(r, F.col(column) == F.col("_d"), "left").withColumn(column, F.coalesce("_s", column)).drop("_d", "_s")


def cycle_nodes(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that reach themselves."""
    return closure(edges, child, parent).where("child = parent").select("child").distinct()
