"""Embedding near-deduplication by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, written
from .graph import components

LEAF = 512  # vectors in an interval that is compared as a whole
SLACK = 1e-5  # bounds are in single precision; what they leave is decided in double


def _axes(sample: np.ndarray, dims: int) -> np.ndarray:
    """The leading principal directions of a sample, as columns. Any orthonormal columns give right results; these skip most."""
    values, vectors = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")[:dims]])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    scale = np.abs(rows).max(axis=1, keepdims=True)  # against overflow of squares
    rows = rows / scale
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _projected(axes: np.ndarray, cell: float):
    """cells: the grid cell of each vector. p: its projections, and the length of what they leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column("vec")) @ axes
                cells = np.clip(np.floor(p / cell) + 128, 0, 255).astype(np.uint8)
                rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))
                p = np.column_stack((p, rest)).astype(np.float32)
                n = np.arange(len(p) + 1)
                yield pa.record_batch([batch.column("id"), batch.column("w"), batch.column("vec"), binaries(cells.reshape(-1), n * axes.shape[1]), pa.ListArray.from_arrays(pa.array((n * p.shape[1]).astype(np.int32)), pa.array(p.reshape(-1)))], names=["id", "w", "vec", "cells", "p"])

    return run


def _blocks(size: int):
    """Consecutive rows of the sorted partition as one row: ids, weights, vectors, and the box of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            p = rows.column("p").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            vec = rows.column("vec").combine_chunks().flatten()
            wrap = lambda x: pa.array([x])
            edge = lambda x: pa.array([x], pa.list_(pa.float32()))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), edge(p.min(axis=0)), edge(p.max(axis=0)), wrap(rows.column("id").to_numpy().astype(np.int64).tobytes()), wrap(rows.column("w").to_numpy().astype(np.int64).tobytes()), wrap(p.tobytes()), wrap(vec.to_numpy(zero_copy_only=False).tobytes())], names=["part", "nth", "lo", "hi", "ids", "ws", "p", "vecs"])

        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= size:
                yield block(held.slice(0, size))
                held = held.slice(size)
                nth += 1
        if held is not None and held.num_rows:
            yield block(held)

    return run


def _merged(group: pa.Table) -> pa.Table:
    """Neighbouring blocks as one block."""
    group = group.sort_by([("old", "ascending"), ("nth", "ascending")])
    ends = lambda k, f: pa.array([f(np.array(group.column(k).to_pylist()), axis=0)], pa.list_(pa.float32()))
    joined = {k: pa.array([b"".join(group.column(k).to_pylist())], pa.binary()) for k in ("ids", "ws", "p", "vecs")}
    return pa.table({"part": group.column("part").slice(0, 1), "nth": pa.array([0], pa.int32()), "lo": ends("lo", np.min), "hi": ends("hi", np.max), **joined})


def bundles(counts: list[int], block: int) -> list[int]:
    """A number for each part: neighbours share it as long as their rows fit one block together."""
    out, number, held = [], -1, block + 1
    for n in counts:
        if held + n > block:
            number, held = number + 1, 0
        held += n
        out.append(number)
    return out


def interval_pairs(lo: np.ndarray, hi: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs i <= j of boxes of a sequence that may be within eps: the sequence joined with itself, halved recursively, far halves skipped."""
    n = len(lo)
    out: list[tuple[int, int]] = []
    if not n:
        return out
    stack = [(0, n, 0, n)]
    while stack:
        a, b, c, d = stack.pop()
        gap = np.maximum(0, np.maximum(lo[a:b].min(axis=0) - hi[c:d].max(axis=0), lo[c:d].min(axis=0) - hi[a:b].max(axis=0)))
        if gap @ gap > eps * eps:
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
            continue
        m, k = (a + b) // 2, (c + d) // 2
        if (a, b) == (c, d):
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            stack += [(a, b, c, k), (a, b, k, d)]
    return out


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches by the links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _near(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with x @ y >= threshold. The product of p and q is never less (their last column bounds what is not projected), so it goes first."""
    few = p @ q.T >= np.float32(threshold - SLACK)
    if upper:
        few &= np.triu(np.ones(few.shape, bool), 1)
    at = np.flatnonzero(few)
    if len(at) > few.size // 20:
        a, b = np.nonzero(few & (x @ y.T >= threshold))
        return a, b
    a, b = np.divmod(at, len(y))
    sure = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return a[sure], b[sure]


def _leaf_join(kind: str, dim: int, dims: int, threshold: float, eps: float):
    """One pair of blocks, or a block with itself: the links of each vector, counted with weights, and links that span components."""
    real = np.float64 if kind == "double" else np.float32

    def unpack(group: pa.Table, i: int) -> tuple:
        get = lambda k: group.column(k)[i].as_buffer()
        p = np.frombuffer(get("p"), np.float32).reshape(-1, dims + 1)
        raw = np.frombuffer(get("vecs"), real).reshape(len(p), dim)
        x = _matrix(pa.FixedSizeListArray.from_arrays(pa.array(raw.reshape(-1)), dim))
        return np.frombuffer(get("ids"), np.int64), np.frombuffer(get("ws"), np.int64), p, x

    def boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(p), LEAF)
        return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)

    def run(group: pa.Table) -> pa.Table:
        same = group.num_rows == 1
        ids, ws, p, x = unpack(group, 0)
        ids2, ws2, p2, x2 = (ids, ws, p, x) if same else unpack(group, 1)
        links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
        lo, hi = boxes(p)
        lo2, hi2 = boxes(p2)
        if same:
            pairs = interval_pairs(lo, hi, eps)
        else:
            gap = np.maximum(0, np.maximum(lo[:, None] - hi2[None], lo2[None] - hi[:, None]))
            pairs = np.argwhere(np.einsum("ijk,ijk->ij", gap, gap) <= eps * eps).tolist()
        ends: list[tuple] = []
        for i, j in pairs:
            s, e, s2, e2 = i * LEAF, min(len(x), (i + 1) * LEAF), j * LEAF, min(len(x2), (j + 1) * LEAF)
            a, b = _near(x[s:e], x2[s2:e2], p[s:e], p2[s2:e2], threshold, same and i == j)
            if len(a):
                links[s:e] += np.bincount(a, ws2[s2:e2][b], e - s).astype(np.int64)
                links2[s2:e2] += np.bincount(b, ws[s:e][a], e2 - s2).astype(np.int64)
                # links that span the leaf's components say as much as all links
                own = _local_components(e - s + e2 - s2, a, b + e - s)
                at = np.flatnonzero(own != np.arange(len(own)))
                name = np.concatenate((ids[s:e], ids2[s2:e2]))
                ends.append((name[at], name[own[at]]))
        if same:
            links = links + links2
            links2 = links2[:0]
        who = np.concatenate((ids[links > 0], ids2[: len(links2)][links2 > 0]))
        count = np.concatenate((links[links > 0], links2[links2 > 0]))
        a = np.concatenate([x[0] for x in ends] or [np.zeros(0, np.int64)])
        b = np.concatenate([x[1] for x in ends] or [np.zeros(0, np.int64)])
        return pa.table([pa.array(np.concatenate((who, a))), pa.array(np.concatenate((np.full(len(who), -1), b)), mask=np.arange(len(who) + len(b)) < len(who)), pa.array(np.concatenate((count, np.zeros(len(a), np.int64))))], names=["a", "b", "links"])

    return run


def _one_dimension(nodes: DataFrame, kind: str, dim: int, threshold: float, dims: int, block: int, sample: int) -> DataFrame:
    """a, b, links: rows with b are links that span components, the others count the links of a. nodes: id, w, vec of `dim` numbers."""
    # cosine >= threshold: unit vectors are at most that far apart, and so are their projections with the lengths of the rest
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    dims = min(dims, dim)
    taken = nodes.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    axes = _axes(_matrix(taken), dims)
    placed = nodes.mapInArrow(_projected(axes, eps), f"id long, w long, vec array<{kind}>, cells binary, p array<float>")
    parts = max(1, min(2048, -(-nodes.count() // block)))
    # the grid order of the cells; within a cell the projections themselves, so that a crowded cell can be divided as well
    ordered = placed.repartitionByRange(parts, "cells", "p", "id").sortWithinPartitions("cells", "p", "id").select("id", "w", "vec", "p")
    layout = "part int, nth int, lo array<float>, hi array<float>, ids binary, ws binary, p binary, vecs binary"
    blocks = written(ordered.mapInArrow(_blocks(block), layout), "blocks")
    spark = nodes.sparkSession
    # a session may deal the rows to more parts than asked for: small neighbours become one block again
    filled = blocks.groupBy("part").agg(F.sum(F.length("ids") / 8).cast("long").alias("rows")).orderBy("part").collect()
    number = bundles([r["rows"] for r in filled], block)
    if number and number[-1] + 1 <= 0.75 * len(number):
        names = spark.createDataFrame(pa.table({"old": pa.array([r["part"] for r in filled], pa.int32()), "new": pa.array(number, pa.int32())}))
        moved = blocks.join(F.broadcast(names), blocks.part == names.old).withColumn("part", F.col("new")).select("part", "old", "nth", "lo", "hi", "ids", "ws", "p", "vecs")
        blocks = written(moved.groupBy("part").applyInArrow(_merged, layout), "bundles")
    # recursion over at most 2048 parts on the driver, however many blocks there are
    edge = lambda f, k: F.array(*(f(F.col(k)[i]) for i in range(dims + 1))).alias(k)
    tops = blocks.groupBy("part").agg(edge(F.min, "lo"), edge(F.max, "hi")).orderBy("part").collect()
    near = interval_pairs(np.array([r["lo"] for r in tops]).reshape(-1, dims + 1), np.array([r["hi"] for r in tops]).reshape(-1, dims + 1), eps)
    top_pairs = spark.createDataFrame(pa.table({"pa": pa.array([tops[i]["part"] for i, _ in near], pa.int32()), "pb": pa.array([tops[j]["part"] for _, j in near], pa.int32())}))
    # then over the blocks of the parts that are left
    box = blocks.select("part", "nth", "lo", "hi")
    left, right = (box.select(*(F.col(k).alias(f"{k}_{s}") for k in box.columns)) for s in "ab")
    both = top_pairs.join(left, F.col("pa") == F.col("part_a")).join(right, F.col("pb") == F.col("part_b"))
    far = sum((F.pow(F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]), 2) for i in range(dims + 1)), F.lit(0.0))
    pairs = both.where((far <= eps * eps) & ((F.col("pa") < F.col("pb")) | (F.col("nth_a") <= F.col("nth_b"))))
    # the key of a pair goes to its blocks, and each block once to the group of the pair
    ends = F.array_distinct(F.array(*(F.struct(F.col(f"part_{s}").alias("part"), F.col(f"nth_{s}").alias("nth")) for s in "ab")))
    pairs = written(pairs.select(F.struct("part_a", "nth_a", "part_b", "nth_b").alias("pair"), F.explode(ends).alias("end")).select("pair", "end.*"), "pairs")
    work = pairs.join(blocks.select("part", "nth", "ids", "ws", "p", "vecs"), ["part", "nth"]).select("pair", "ids", "ws", "p", "vecs")
    return written(work.groupBy("pair").applyInArrow(_leaf_join(kind, dim, dims, threshold, eps), "a long, b long, links long"), "near")


def embedding_dedup(
    vectors: DataFrame,
    threshold: float = 0.95,
    dims: int = 16,
    block: int = 8192,
    sample: int = 10_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """One row per input row: id, n_links (other rows with cosine >= threshold), component_id (smallest id reachable), kept.

    Vectors are compared in double precision. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing: 0 links, own component. Vectors of different lengths never link. Equal vectors are one node with a weight,
    so copies are counted but never paired. A row without id links like others; its component is the smallest id reachable,
    null if no row there has one. Other columns are ignored; an empty table gives an empty result.

    The grid's axes are fitted on a bounded sample of `sample` vectors (smallest hashes of the ids); any axes give the same
    result, the sample only decides how much is skipped. All vectors are compared: intervals of the grid order, halved
    recursively, are left out only if their boxes are provably more than the distance of the threshold apart.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    # nodes have numbers of their own, as ids may be missing or repeated
    nodes = rows.where(fine).groupBy("vec").agg(F.min("id").alias("name"), F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id())
    nodes = written(nodes.select("id", "name", "w", "vec"), "nodes")
    sizes = [r[0] for r in nodes.select(F.size("vec")).distinct().collect()]  # one or two in practice
    found = nodes.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("links"))
    for d in sizes:
        found = found.union(_one_dimension(nodes.where(F.size("vec") == d).select("id", "w", "vec"), kind, d, threshold, dims, block, sample))
    comps = components(found.where("b is not null"))
    # a component is named by the smallest id in it
    named = written(comps.join(nodes.select("id", "name"), comps.node == nodes.id).select("node", "component", "name"), "named")
    low = named.groupBy("component").agg(F.min("name").alias("low"))
    named = named.join(low, "component").select("node", "low")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    solved = nodes.join(counts, nodes.id == counts.a).join(named, nodes.id == named.node, "left")
    solved = written(solved.select("vec", (F.col("links") + F.col("w") - 1).alias("n_links"), F.coalesce("low", "name").alias("component")), "solved")
    linked = rows.where(fine).join(solved, "vec").select("id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
