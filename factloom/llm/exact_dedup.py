"""Exact deduplication by Grace hashing: recursive spill partitions until each fits a table that compares complete content."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_hash

#: A run of white space that is not one space already.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_CLASS = pa.schema([("text_sha256", pa.string()), ("content", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalised(text: str):
    """Each run of [\\x20\\x09-\\x0D] as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUN, " ")


class _Table:
    """Distinct contents with their smallest id and count. A dict is an open-addressing table that compares the complete key."""

    def __init__(self):
        self.rows: dict[str, list] = {}
        self.bytes = 0

    def add(self, content: str, low, n: int) -> None:
        row = self.rows.get(content)
        if row is None:
            self.rows[content] = [low, n]
            self.bytes += len(content) + 200
        else:
            row[1] += n
            if low is not None and (row[0] is None or low < row[0]):
                row[0] = low

    def batches(self, with_content: bool) -> Iterator[pa.RecordBatch]:
        keys = list(self.rows)
        start = 0
        while start < len(keys):
            end, size = start, 0
            while end < len(keys) and size < 8 << 20:
                size += len(keys[end]) + 100
                end += 1
            part = keys[start:end]
            rows = [self.rows[k] for k in part]
            digests = [hashlib.sha256(k.encode()).hexdigest() for k in part]
            yield pa.record_batch([digests, part if with_content else pa.nulls(len(part), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=_CLASS)
            start = end


def _local(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Table()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(t, i, 1)
                if held.bytes > table_bytes:
                    yield from held.batches(True)
                    held = _Table()
        yield from held.batches(True)

    return run


def _grace(table_bytes: int, fanout: int):
    def bucket(digest: str, level: int) -> int:
        return int(digest[16 + 2 * level : 18 + 2 * level], 16) % fanout

    def rows_of(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def solve(rows: Iterator[tuple], level: int, place: str) -> Iterator[pa.RecordBatch]:
        """One table if the distinct contents fit; else the table's rows and the rest go to spill files, one a bucket."""
        held = _Table()
        for row in rows:
            held.add(row[1], row[2], row[3])
            if held.bytes > table_bytes and level < 8:
                break
        else:
            yield from held.batches(False)
            return
        names = [os.path.join(place, f"{level}-{b}-{os.urandom(4).hex()}") for b in range(fanout)]
        waiting: list[list] = [[] for _ in names]
        size = 0

        def spill() -> None:
            for name, part in zip(names, waiting, strict=True):
                if part:
                    with open(name, "ab") as f:
                        pickle.dump(part, f)
                    part.clear()

        def again() -> Iterator[tuple]:
            for content, (low, n) in held.rows.items():
                yield hashlib.sha256(content.encode()).hexdigest(), content, low, n
            held.rows.clear()
            yield from rows

        for row in again():
            waiting[bucket(row[0], level)].append(row)
            size += len(row[1]) + 200
            if size > table_bytes // 2:
                spill()
                size = 0
        spill()
        for name in names:
            if os.path.exists(name):
                yield from solve(rows_of(name), level + 1, place)
                os.remove(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        # The spill files are scratch of this one task: a task that is run again makes them again.
        with tempfile.TemporaryDirectory() as place:
            yield from solve(rows, 0, place)

    return run


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 96 << 20, fanout: int = 16) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (smallest id), group_size.

    Each task first folds the copies within its own input, so a text that a third of all rows share
    reaches the shuffle once per input split. A bucket of the shuffle that exceeds table_bytes of
    distinct text is split again into spill files by further digest bits, to any depth needed.
    """
    cols = "text_sha256 string, content string, keep_id long, group_size long"
    local = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("content")).mapInArrow(_local(table_bytes), cols)
    # repartition without a number: adaptive execution may merge small partitions.
    return local.repartition("text_sha256").mapInArrow(_grace(table_bytes, fanout), cols).drop("content")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 96 << 20, fanout: int = 16, hashed: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; with `hashed` also text_hash, which tells rows of one id apart.

    Null text counts as empty. A null id never wins over another id; keep_id is null only if no row of the group has an id,
    and then all its rows are kept. Rows that repeat both id and text are one document: all are kept or none.
    An empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    extra = [text_hash(F.col(text_col)).alias("text_hash")] if hashed else []
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(normalised(text_col), 256).alias("text_sha256"), *extra)
    classes = exact_classes(docs, id_col, text_col, table_bytes, fanout)
    return rows.join(classes, "text_sha256").select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *(["text_hash"] if hashed else []))
