"""Pairs of one block that are scored by the distance of two numbers: each left row's best, and counts by score, without the pairs.

left: left_key, block, at; right: right_key, block, at. The score of a pair is round(score(abs(left at - right at)), digits), where
`score` takes a column or an array and does not grow with the distance. Equal numbers of a block are one row with a weight. A number
is odd if it is null, NaN or infinite; then all finite numbers are alike to it, and there are four odd ones at most.

The distinct numbers of a block's right side are in memory in one task, as arrays; its left side is dealt to as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import ranked_top

#: Left numbers of a task that looks for the best, and pairs of one that counts.
LEFT_OF_TASK, PAIRS_OF_TASK = 50_000, 100_000_000
#: Pairs that are in memory at once, and that are scored at once; runs of more than so many rows for each of k are reduced one by one.
AT_ONCE, IN_CACHE, WIDE = 1_000_000, 16_384, 64


def _odd(at: str) -> Column:
    return F.col(at).isNull() | F.isnan(at) | (F.abs(at) == float("inf"))


def _scored(pairs: DataFrame, score: Callable, digits: int) -> DataFrame:
    """pairs: left_at, right_at."""
    return pairs.withColumn("score", F.round(score(F.abs(F.col("left_at") - F.col("right_at"))), digits))


def nearest_top(left: DataFrame, right: DataFrame, k: int, score: Callable, digits: int) -> DataFrame:
    """left_key, right_key, score, rank: what `ranked_top` keeps of all pairs.

    Of the rows with one number the k smallest keys are enough. Of a block's right rows in order of their numbers, k on either side hold the
    k nearest; from the score of the k-th, the rows that may round to as much are a run around it. Wide runs keep the k smallest keys of
    each score that surely rounds alike. What is left is scored and ranked as pairs are.
    """
    left, right = (side.where("block is not null").withColumn("at", F.col("at").cast("double")) for side in (left, right))
    at = left.select("block", F.col("at").alias("left_at")).distinct()
    kind = F.when(_odd("right_at"), F.coalesce(F.col("right_at").cast("string"), F.lit("null"))).otherwise("finite")
    few = ranked_top(right.select("right_key", "block", F.col("at").alias("right_at"), F.lit(0).alias("score")), k, ("block", "right_at")).select("right_key", "block", "right_at")
    kinds = ranked_top(few.withColumn("kind", kind).withColumn("score", F.lit(0)), k, ("block", "kind"))
    chosen = ["block", "left_at", "right_key", "right_at"]
    odd = at.where(_odd("left_at")).join(kinds, "block").select(chosen).union(at.where(~_odd("left_at")).join(kinds.where("kind <> 'finite'"), "block").select(chosen))
    parts = at.groupBy("block").agg(F.ceil(F.count("*") / LEFT_OF_TASK).cast("int").alias("parts"))
    a, b = _dealt(at.where(~_odd("left_at")), few.where(~_odd("right_at")), parts)
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*a.select("block", "left_at").schema, *b.select("right_key", "right_at").schema))
    near = a.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInArrow(_runs(k, score, digits), layout)
    best = ranked_top(_scored(near.select(chosen).union(odd), score, digits), k, ("block", "left_at")).drop("rank", "right_at")
    rows = left.select("left_key", F.col("block").alias("b"), "at")
    return ranked_top(rows.join(best, (F.col("b") == F.col("block")) & F.col("at").eqNullSafe(F.col("left_at"))).select("left_key", "right_key", "score"), k)


def score_counts(left: DataFrame, right: DataFrame, score: Callable, digits: int) -> DataFrame:
    """score, n: how many of all pairs have each score; null and NaN are scores too.

    Distinct numbers meet as arrays, and the scores of a task that surely round alike leave it as one row, so what is shuffled is at
    most a row for each score and task. The work grows with the product of a block's distinct numbers.
    """
    left, right = (side.where("block is not null").groupBy("block", F.col("at").cast("double").alias(f"{c}_at")).agg(F.count("*").alias(f"{c}_n")) for side, c in ((left, "left"), (right, "right")))
    sizes = left.groupBy("block").agg(F.count("*").alias("l")).join(right.groupBy("block").agg(F.count("*").alias("r")), "block")
    parts = sizes.select("block", F.ceil(F.col("l") * F.col("r") / PAIRS_OF_TASK).cast("int").alias("parts"))
    a, b = _dealt(left.where(~_odd("left_at")), right.where(~_odd("right_at")), parts)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced by bytes
    a, b = (side.repartition(n, "block", "part") for side in (a, b))
    raw = a.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInArrow(_counts(score, digits), "raw double, sure boolean, n long")
    finite = raw.select(F.when(F.col("sure"), F.col("raw")).otherwise(F.round("raw", digits)).alias("score"), "n")
    odd = left.where(_odd("left_at")).join(right, "block").union(left.where(~_odd("left_at")).join(right.where(_odd("right_at")), "block"))
    return finite.union(_scored(odd, score, digits).select("score", F.col("left_n") * F.col("right_n"))).groupBy("score").agg(F.sum("n").alias("n"))


def _dealt(left: DataFrame, right: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a part of their block: the left side's rows dealt out by their number, the right side's in each."""
    a = left.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("left_at"), "parts").cast("int")).drop("parts")
    return a, right.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _rounded(raw: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The scores, rounded where they are far enough from a half for any way of rounding; whether they are."""
    y = raw * 10.0**digits
    step = np.floor(y + 0.5)
    sure = np.abs(np.abs(y - step) - 0.5) > 1e-7 + 1e-14 * np.abs(y)
    return np.where(sure, step / 10.0**digits, raw), sure


def _runs(k: int, score: Callable, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("right_at", "ascending")])
        u, v, n = left["left_at"].to_numpy(), right["right_at"].to_numpy(), right.num_rows
        of = lambda i, x: score(np.abs(x - v[i]))
        lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        order = np.empty(n, np.int64)  # of the keys, nulls first as `ranked_top` has them
        order[pc.sort_indices(right["right_key"], null_placement="at_start").to_numpy()] = np.arange(n)
        for start in range(0, len(u) if n else 0, AT_ONCE // (2 * k)):
            x = u[start : start + AT_ONCE // (2 * k)]
            mid = np.searchsorted(v, x)
            if n > k:
                first = np.clip(mid - k, 0, n)[:, None] + np.arange(2 * k)
                near = np.where(first < np.minimum(mid + k, n)[:, None], of(np.minimum(first, n - 1), x[:, None]), -np.inf)
                kth = np.partition(near, 2 * k - k, axis=1)[:, 2 * k - k]
                least = kth - 1.001 * 10.0**-digits - 1e-14 * np.abs(kth)
                lo, hi = _edge(lambda i: of(i, x) >= least, np.zeros(len(x), np.int64), mid), _edge(lambda i: of(i, x) < least, mid, np.full(len(x), n))  # noqa: B023
            else:
                lo, hi = np.zeros(len(x), np.int64), np.full(len(x), n)
            wide = hi - lo > WIDE * k
            for i in np.flatnonzero(wide):
                at = np.arange(lo[i], hi[i])
                at = at[np.argsort(order[at])]
                alike, _ = _rounded(of(at, x[i]), digits)
                by = np.argsort(alike, kind="stable")  # within alike, by key
                place = np.arange(len(by)) - np.searchsorted(alike[by], alike[by])
                rights.append(at[by[place < k]])
                lefts.append(np.full(len(rights[-1]), start + i))
            size = np.where(wide, 0, hi - lo)
            lefts.append(np.repeat(np.arange(start, start + len(x)), size))
            rights.append(np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size))
        i, j = np.concatenate(lefts), np.concatenate(rights)
        return pa.table({"block": left["block"].take(i), "left_at": left["left_at"].take(i), "right_key": right["right_key"].take(j), "right_at": right["right_at"].take(j)})

    return chosen


def _edge(holds: Callable, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place in [lo, hi) from which on it holds, else hi, for each at once."""
    while (lo < hi).any():
        open_, mid = lo < hi, (lo + hi) // 2
        yes = open_ & holds(np.where(open_, mid, 0))
        lo, hi = np.where(open_ & ~yes, mid + 1, lo), np.where(yes, mid, hi)
    return lo


def _counts(score: Callable, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("right_at", "ascending")])
        u, v, m, w = (t[c].to_numpy() for t, c in ((left, "left_at"), (right, "right_at"), (left, "left_n"), (right, "right_n")))
        unit, held = 10.0**digits, [(np.empty(0), np.empty(0, np.int64))]
        if len(u) and len(v):
            least, most = (np.floor(score(np.abs(x)) * unit) for x in (np.maximum(u.max() - v[0], v[-1] - u.min()), np.zeros(())))
            few = most - least < 4 * AT_ONCE and m.sum(dtype=float) * w.sum(dtype=float) < 2.0**52
            slack = 1e-7 + 1e-14 * max(abs(least), abs(most))
            sums = np.zeros(int(most - least) + 2 if few else 0)
            wide = min(len(v), IN_CACHE)
            high = max(1, IN_CACHE // wide)
            place, weight, filled = np.empty(AT_ONCE + IN_CACHE, np.int64), np.empty(AT_ONCE + IN_CACHE), 0
            for i, j in ((i, j) for j in range(0, len(v), wide) for i in range(0, len(u), high)):
                raw = score(np.abs(u[i : i + high, None] - v[None, j : j + wide])).ravel()
                n = np.multiply(m[i : i + high, None], w[None, j : j + wide], dtype=float).ravel()
                if not few:
                    held.append(_summed(_rounded(raw, digits)[0], n.astype(np.int64)))
                    if sum(len(x) for x, _ in held) > AT_ONCE:
                        held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    continue
                y = raw * unit
                step = np.floor(y + 0.5)
                y -= step
                unsure = np.flatnonzero(np.abs(np.abs(y, out=y) - 0.5) <= slack)
                if len(unsure):
                    held.append((raw[unsure], n[unsure].astype(np.int64)))
                    n[unsure] = 0
                to = filled + len(raw)
                np.subtract(step, least, out=place[filled:to], casting="unsafe")
                weight[filled:to] = n
                filled = to
                if filled >= AT_ONCE:
                    sums += np.bincount(place[:filled], weight[:filled], len(sums))
                    filled = 0
            if few:
                sums += np.bincount(place[:filled], weight[:filled], len(sums))
                at = np.flatnonzero(sums)
                held.append(((at + least) / unit, sums[at].astype(np.int64)))
        value, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        return pa.table({"raw": value, "sure": _rounded(value, digits)[1], "n": n})

    return counted


def _summed(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values with the sums of n."""
    by = np.argsort(value, kind="stable")
    heads = np.flatnonzero(np.diff(value[by], prepend=np.nan) != 0)
    return value[by[heads]], np.add.reduceat(n[by], heads) if len(heads) else n[:0]
