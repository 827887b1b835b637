"""Packing: shortest-pack-first over the histogram of piece lengths, then patterns are joined back to pieces by rank."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import slices, written

END_ID = 1
_PIECES = "part int, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass
class Slots:
    """Where pieces of one length go: ranks low.. take `each` places in sequence `first`, then `each` in the next, and so on, from `offset`."""

    length: int
    low: int
    first: int
    each: int
    offset: int


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> list[Slots]:
    """Shortest-pack-first: lengths longest first, each into the packs that hold least so far.

    Packs of one kind (same lengths inside) are held as one pattern with a count; a length that some packs of a kind take
    splits the pattern. So the work depends on the number of lengths and patterns, not on the number of pieces.
    """
    slots: list[Slots] = []
    packs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # tokens held -> (first sequence, count) of packs
    held: list[int] = []  # the keys of packs, sorted
    made = 0

    def put(tokens: int, first: int, count: int) -> None:
        if tokens < capacity:
            if tokens not in packs:
                bisect.insort(held, tokens)
            packs[tokens].append((first, count))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        if length > capacity or length < 1:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            if held and held[0] + length <= capacity:
                tokens = held[0]
                first, count = packs[tokens].pop()
                if not packs[tokens]:
                    del packs[tokens]
                    held.pop(0)
                take = min(left, count)
                slots.append(Slots(length, rank, first, 1, tokens))
                put(tokens + length, first, take)
                put(tokens, first + take, count - take) if count > take else None
            else:
                each = capacity // length
                packs_new = left // each if left >= each else 1
                each = min(each, left)
                take = packs_new * each
                slots.append(Slots(length, rank, made, each, 0))
                put(each * length, made, packs_new)
                made += packs_new
            left -= take
            rank += take
    return slots


def pieces_of(docs: DataFrame, capacity: int, id_col: str, text_col: str, **options) -> DataFrame:
    """Cuts every document's ids (with the end id) every `capacity` ids. part and nth number the pieces of each task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = codec(**options), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, ends = c.encode_units(rows.column("text"))
                n = np.diff(ends) + 1
                count = (n + capacity - 1) // capacity
                owner = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, n[owner] - start)
                image, end = memoryview(ids.astype("<u4")).cast("B"), END_ID.to_bytes(4, "little")
                crc = []
                for a, m, last in zip((ends[owner] + start).tolist(), length.tolist(), (start + length == n[owner]).tolist(), strict=True):
                    x = zlib.crc32(image[4 * a : 4 * (a + m - last)])
                    crc.append(zlib.crc32(end, x) if last else x)
                # the rank of each piece among this task's pieces of its length
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                begins = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1]))) if len(sizes) else np.zeros(0, np.int64)
                per = np.diff(np.concatenate((begins, [len(sizes)])))
                nth = np.empty(len(sizes), np.int64)
                nth[order] = np.arange(len(sizes)) - np.repeat(begins, per) + seen[sizes]
                seen[sizes[begins]] += per
                yield pa.record_batch([pa.array(np.full(len(owner), part, np.int32)), pa.array(nth), rows.column("id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[owner])], names=["part", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has at least its end id, so null and empty texts give one piece of one token. A document that exceeds
    the capacity is cut into full pieces, which fill sequences of their own, and a rest. Equal lengths are told apart by
    rank only, so ties and repeated rows each get their own place. An empty table gives no pieces.

    The driver sees the histogram alone: at most `capacity` rows. Ranks need no window over all pieces of a length: each
    task numbers its own, and counts by task and length are summed up before it.
    """
    pieces = written(pieces_of(docs, capacity, id_col, text_col, **options), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_task.select("length", "part", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    before = written(before, "counts")
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(pack_histogram(histogram, capacity), key=lambda s: (s.length, s.low))
    shift = 1 << 48
    key = np.array([s.length * shift + s.low for s in slots], np.int64)
    place = np.array([(s.low, s.first, s.each, s.offset) for s in slots], np.int64).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            low, first, each, offset = place[np.searchsorted(key, length * shift + rank, side="right") - 1].T
            turn, slot = np.divmod(rank - low, each)
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(first + turn), pa.array(offset + slot * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # `before` grows with the tasks, so it is never broadcast
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def token_sequences(docs: DataFrame, packed: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """sequence_id, ids array<int>: the packed sequences themselves, at most `capacity` ids each, from docs and the result of pack()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(**options)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, ends = c.encode_units(rows.column("text"))
                parts, owner, starts = [], [], []
                for d in range(rows.num_rows):
                    own = np.append(ids[ends[d] : ends[d + 1]], np.uint32(END_ID)).astype(np.int32)
                    for s in range(0, len(own), capacity):
                        parts.append(own[s : s + capacity])
                        owner.append(d)
                        starts.append(s)
                yield pa.record_batch([rows.column("id").take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["id", "start", "ids"])

    cut = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, start long, ids array<int>")
    placed = packed.select(F.col(id_col).alias("id"), "start", "sequence_id", "offset").join(cut, ["id", "start"])
    # a sequence holds at most `capacity` ids, so the lists of a group are bounded
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
