"""MinHash near-deduplication with fast similarity sketches: banding, stars in buckets, verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, binaries, mix, slices, text_hash, written
from .graph import components

ROWS = 4  # sketch coordinates in a band
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of all texts, and the n+1 offsets. A shorter text is one shingle; none without words."""
    words = Words(texts, LOWER)
    n = words.counts
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    total = int(per.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    owner = np.repeat(np.arange(len(n)), per)
    first = words.offsets[:-1][owner] + np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(n, width)[owner]
    h = words.hashes()[words.codes]
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64)
        for k in range(width):
            word = h[np.minimum(first + k, len(h) - 1)]
            out = np.where(k < size, mix(out * _ODD + word), out)
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])))
    owner, out = owner[new], out[new]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def sketches(sets: np.ndarray, ends: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketching: in round i every element goes to one hashed bin with a value in [i, i+1); the smallest value of a bin stays.

    After `coordinates` rounds, round `coordinates` + j sends every element to bin j, so that each bin is filled for certain;
    most sets fill all bins within a few rounds, and leave then. One row per set; rows of empty sets hold the largest value.
    """
    n, t = len(ends) - 1, coordinates
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, t), none)
    flat = out.reshape(-1)
    live = np.diff(ends) > 0
    owner = np.repeat(np.arange(n), np.diff(ends))
    element = sets
    for i in range(2 * t):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            h = mix(element * _ODD + np.uint64(2 * i + 1))
        bins = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        # the round in the upper bits, 40 hashed bits below: ties between different elements are as unlikely as equal hashes
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, owner * t + bins.astype(np.int64), value)
        live = live & (out == none).any(axis=1)
        stay = live[owner]
        owner, element = owner[stay], element[stay]
    return out


def digests(sets: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    image = memoryview(np.ascontiguousarray(sets)).cast("B")
    return [xxhash.xxh3_128_digest(image[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _signatures(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, ends = shingle_sets(part.column("text"), width)
                sketch = sketches(sets, ends, bands * ROWS)
                with np.errstate(over="ignore"):
                    band = np.zeros((len(sketch), bands), np.uint64)
                    for r in range(ROWS):
                        band = mix(band * _ODD + sketch[:, r::ROWS])
                    band = mix(band + np.arange(bands, dtype=np.uint64) * _ODD).view(np.int64)
                digest = digests(sets, ends)
                low = (sketch & np.uint64(0xFFFF)).astype(np.uint16)
                size = bands * ROWS * np.arange(len(sketch) + 1)
                yield pa.record_batch([part.column("id"), part.column("tag"), pa.array(np.diff(ends)), pa.array(digest, pa.binary()), binaries(low.reshape(-1), size), pa.ListArray.from_arrays(pa.array((np.arange(len(sketch) + 1) * bands).astype(np.int32)), pa.array(band.reshape(-1)))], names=["id", "tag", "n_shingles", "digest", "sketch", "bands"])

    return run


def _sets(width: int, chosen: np.ndarray):
    """digest, set array<long> of the rows whose key falls on a set bit of `chosen`."""
    bits = np.uint64(len(chosen) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slot(batch.column("key").to_numpy(), bits)
            batch = batch.filter(pa.array((chosen[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1))
            for part in slices(batch, "text"):
                sets, ends = shingle_sets(part.column("text"), width)
                yield pa.record_batch([pa.array(digests(sets, ends), pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["digest", "set"])

    return run


def _slot(ids: np.ndarray, bits: np.uint64) -> np.ndarray:
    return mix(ids.view(np.uint64)) % bits


def _bitmap(ids: DataFrame, log2_bits: int) -> np.ndarray:
    """A bit for each id, hashed: 2**log2_bits bits whatever the number of ids. More ids than fit only let more rows pass."""
    words = 1 << (log2_bits - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(words, np.uint64)
        for b in batches:
            at = _slot(b.column(0).to_numpy().astype(np.int64), np.uint64(words * 64))
            np.bitwise_or.at(mine, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        on = np.flatnonzero(mine)
        yield pa.record_batch([pa.array(on), pa.array(mine[on].view(np.int64))], names=["word", "bits"])

    got = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b with den * |A and B| >= num * |A or B| on the full sets."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = two.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    return both.where(den * F.col("both") >= num * (F.col("sum") - F.col("both"))).select("a", "b")


def _needed(bands: int, num: int, den: int):
    """The members of a group that have a possible partner in another component, one whose sketch agrees enough.

    A pair that shares several bands belongs to the first of them, so its sets need to meet only there. Bands are compared as they
    are in the buckets: the sketch holds 16 bits of each coordinate, and would show some bands as shared that are not.
    """
    t = bands * ROWS
    p = num / den
    least = p - 4.5 * (p * (1 - p) / t) ** 0.5  # a pair at the threshold falls below with a chance of 3 in a million

    def run(group: pa.Table) -> pa.Table:
        ids, comp, blocks, bi = (group.column(k).to_numpy() for k in ("id", "component", "block", "bi"))
        own = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), bands)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(ids), bands, ROWS)
        inside = blocks.min() == blocks.max()
        need = np.zeros(len(ids), bool)
        for i in range(len(ids)):
            others = np.flatnonzero((comp[i + 1 :] != comp[i]) & (inside | (blocks[i + 1 :] != blocks[i]))) + i + 1
            same = sketch[others] == sketch[i]
            hit = (same.mean(axis=(1, 2)) >= least) & ((own[others] == own[i]).argmax(axis=1) == bi[0])
            if hit.any():
                need[i] = need[others[hit]] = True
        return group.filter(pa.array(need)).select(["band", "g1", "g2", "id", "component"])

    return run


def _spanning(num: int, den: int, chunk: int = 4096):
    """Links between components in one group, decided on the full sets: as many as span them, not all pairs."""

    def run(group: pa.Table) -> pa.Table:
        ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
        sets = group.column("set").combine_chunks()
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), size)
        _, column, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        # shingles of one member alone meet nothing; the others' columns are numbered anew
        shared = count > 1
        column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(ids), len(ids)), np.float32)  # whole numbers below 2**24 are exact
        for start in range(0, int(shared.sum()), chunk):
            lo, hi = np.searchsorted(column, (start, start + chunk))
            rows = np.zeros((len(ids), chunk), np.float32)
            rows[owner[lo:hi], column[lo:hi] - start] = 1
            both += rows @ rows.T
        both = both.astype(np.int64)
        near = den * both >= num * (size[:, None] + size[None] - both)
        near &= comp[:, None] != comp[None]
        # components as nodes: the first link found between what is not connected yet
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a_out, b_out = [], []
        for a, b in np.argwhere(np.triu(near)).tolist():
            x, y = top(int(comp[a])), top(int(comp[b]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(ids[a])
                b_out.append(ids[b])
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _dealt(buckets: DataFrame, comps: DataFrame, sizes: DataFrame, block: int) -> DataFrame | None:
    """Members of buckets that hold more than one component, dealt out so that any two of different components meet in a group; None if there are none.

    A group is a pair of blocks. A component that fills half a block or more in its bucket has blocks of its own, which
    meet all blocks but each other; the small components share blocks. So members of one large component, such as
    copies with a few changes, are not dealt to each other: their rows grow with their number, not its square.
    """
    marked = buckets.join(comps, buckets.id == comps.node, "left").select("band", "bi", "id", F.coalesce("component", "id").alias("component"))
    marked = written(marked.join(sizes, "id"), "marked")
    load = F.greatest(F.count("*") / block, F.sum("n_shingles") / (block * 2000))
    parts = marked.groupBy("band", "component").agg(load.alias("load"))
    several = parts.groupBy("band").agg(F.count("*").alias("n"), F.ceil(F.sum(F.when(F.col("load") < 0.5, F.col("load")).otherwise(0.0))).cast("int").alias("small")).where("n > 1").select("band", "small")
    several = written(several, "several")
    if several.isEmpty():
        return None
    parts = parts.join(several, "band")
    # large components in order: the first block of each, after the blocks that the small ones share
    large = parts.where("load >= 0.5").withColumn("own", F.ceil("load").cast("int"))
    before = Window.partitionBy("band").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = large.select("band", "component", "own", (F.col("small") + F.coalesce(F.sum("own").over(before), F.lit(0))).cast("int").alias("first"))
    large = written(large, "large")
    total = several.join(large.groupBy("band").agg(F.sum("own").alias("more")), "band", "left").select("band", "small", (F.col("small") + F.coalesce("more", F.lit(0))).cast("int").alias("blocks"))
    rows = marked.join(total, "band").join(large, ["band", "component"], "left")
    # a small component stays together
    rows = rows.withColumn("block", F.when(F.col("own").isNull(), F.pmod(F.xxhash64("component"), F.col("small"))).otherwise(F.col("first") + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("band", "bi", "id", "component", "block", "first", "own", other)
    rows = rows.where("own is null or other < first or other >= first + own")
    return rows.select("band", "bi", "id", "component", "block", F.least("block", "other").alias("g1"), F.greatest("block", "other").alias("g2"))


def near_classes(docs: DataFrame, num: int, den: int, width: int, bands: int, block: int, log2_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, n_shingles, digest) of every row, and (digest, component) of every distinct non-empty set."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text).alias("tag"), text.alias("text"))
    signed = written(rows.mapInArrow(_signatures(width, bands), "id long, tag long, n_shingles long, digest binary, sketch binary, bands array<long>"), "signatures")
    # one node for each distinct set; copies are never paired. Nodes have numbers of their own, as ids may be missing or repeated
    key = F.xxhash64("id", "tag")
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("name"), F.min(key).alias("key"), *(F.first(k).alias(k) for k in ("n_shingles", "sketch", "bands")))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select(F.posexplode("bands").alias("bi", "band"), "id", "key")
    pivots = buckets.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("band", "pivot")
    pivots = written(pivots, "pivots")  # a plain table on this side lets adaptive execution split a hot bucket
    shared = written(buckets.join(pivots, "band"), "buckets")  # only buckets of two sets or more
    chosen = _bitmap(shared.select("key"), log2_bits)
    sets = rows.select(key.alias("key"), "text").mapInArrow(_sets(width, chosen), "digest binary, set array<long>").where("size(set) > 0").dropDuplicates(["digest"])
    sets = written(sets.join(nodes.select("digest", "id"), "digest").select("id", "set"), "sets")
    stars = written(_verified(shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), sets, num, den), "stars")
    comps = components(stars)
    # what no star joined: the members of a bucket that are still apart are compared with each other, in groups
    dealt = _dealt(shared.select("band", "bi", "id"), comps, nodes.select("id", "n_shingles"), block)
    if dealt is not None:
        need = dealt.join(nodes.select("id", "sketch", "bands"), "id").groupBy("band", "g1", "g2").applyInArrow(_needed(bands, num, den), "band long, g1 int, g2 int, id long, component long")
        need = written(need, "need")
        more = need.join(sets, "id").groupBy("band", "g1", "g2").applyInArrow(_spanning(num, den), "a long, b long")
        comps = components(written(stars.union(more), "all"))
    # a component is named by the smallest id in it
    named = written(comps.join(nodes.select("id", "name"), comps.node == nodes.id).select("node", "component", "name"), "named")
    low = named.groupBy("component").agg(F.min("name").alias("low"))
    named = named.join(low, "component").select("node", "low")
    found = nodes.join(named, nodes.id == named.node, "left").select("digest", F.coalesce("low", "name").alias("component"))
    return signed.select("id", F.col("tag").alias("text_hash"), "n_shingles", "digest"), found


def near_dedup(
    docs: DataFrame,
    num: int = 80,
    den: int = 100,
    width: int = 5,
    bands: int = 24,
    block: int = 256,
    log2_bits: int = 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: bool = False,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept; with `hashed` also text_hash, which tells rows of one id apart.

    Texts are linked if den * |A and B| >= num * |A or B| for their sets of `width`-word shingles (A-Z lower-cased; words
    [^\\x20\\x09-\\x0D]+; fewer words: one shingle of all). Shingles are told apart by 64-bit hashes, sets by 128 bits.
    component_id is the smallest id reachable. Every candidate of the banding is decided on the full sets: at a similarity
    of 0.8 a pair shares no band with a chance of 3e-6, at 0.85 of 1e-8. Pairs that no star joined pass an estimate of 4.5 standard
    deviations below the threshold first, which loses a pair at the threshold with a chance of about 3e-6 more, and fewer of nearer pairs.

    Null and empty texts have no shingles and are their own component. Rows without id take part in links like others: their
    component_id is the smallest id reachable, null if no row there has one, and they are kept only in that case. Rows are told apart by
    their texts: rows that repeat an id and a text are one document, rows with one id and several texts are several. Other columns are ignored.
    """
    signed, found = near_classes(docs, num, den, width, bands, block, log2_bits, id_col, text_col)
    cols = ("id", "text_hash", "n_shingles")
    alone = signed.where("n_shingles = 0").select(*cols, F.col("id").alias("component_id"))
    out = signed.where("n_shingles > 0").join(found, "digest").select(*cols, F.col("component").alias("component_id")).union(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *(["text_hash"] if hashed else []))
