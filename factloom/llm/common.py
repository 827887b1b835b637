"""What the operators share: written intermediate tables, byte-level word splitting, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20

#: A-Z become a-z, every other byte stays (the texts are UTF-8, so no other letter changes).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Call it once their results are written: results read them lazily."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column) -> Column:
    """What tells rows of one id apart by their text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc32_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo mod; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together have about `limit` bytes; a longer text comes alone, never cut."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def body(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a string array (null: empty) one after another, and the n+1 offsets."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offs, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(offs, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


class Words:
    """The words of many texts: `codes` of all words in order, `offsets` of each text's first word, `distinct` words as bytes."""

    def __init__(self, texts: pa.Array, translation: bytes):
        """White space is [\\x20\\x09-\\x0D] after the translation, which maps each byte to one byte."""
        raw, offsets = body(texts)
        raw = raw.translate(translation)
        arr = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
        parts = pc.ascii_split_whitespace(arr)
        ends = np.asarray(parts.offsets).astype(np.int64)
        flat = parts.values
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            ends = np.concatenate(([0], np.cumsum(full)))[ends]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.offsets = ends
        self.distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the distinct words."""
        h = xxhash.xxh64_intdigest
        return np.fromiter((h(w, seed) for w in self.distinct), np.uint64, len(self.distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each l of lengths, one after another."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)


def binaries(pieces: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose rows are the byte images of pieces[ends[i]:ends[i+1]]."""
    offsets = (ends * pieces.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(pieces).tobytes())]).cast(pa.binary())
