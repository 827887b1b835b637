"""Byte-level BPE over whole tables: content-defined chunks, or smaller units, are encoded once and reused.

Encoding is split at *lone spaces*: a space whose neighbours on both sides are no white space. The pre-tokeniser always
starts a new unit there, whatever stands further away, so what lies between two of them encodes alike in any text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, runs, slices

LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
MARK = np.isin(np.arange(256), [*b".,;:!?%#$&*()|\"\n"])


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Encodings of byte strings, in one growing pool. It starts anew once it holds max_entries or max_bytes, so its memory is bounded.

    What one call brings may exceed max_bytes, by the slice of texts that the call encodes at most.
    """

    def __init__(self, encode, max_entries: int, max_bytes: int = 64 << 20):
        self.encode, self.max_entries, self.max_bytes = encode, max_entries, max_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.bytes = 0  # of keys and ids

    def __call__(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pool, and for each key its start and length there."""
        if len(self.index) > self.max_entries or self.bytes > self.max_bytes:
            self.clear()
        known = self.index
        new = list(dict.fromkeys(k for k in keys if k not in known))
        if new:
            got = self.encode([k.decode() for k in new])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))))
            self.bytes += sum(map(len, new)) + 4 * int(sizes.sum())
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        where = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        return self.ids, self.starts[where], self.starts[where + 1] - self.starts[where]


class Codec:
    """Encodes and decodes as the tokenizers library does for the same vocabulary. json_name and ranks_name: files of one vocabulary."""

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken", chunk_bits: int = 7, max_entries: int = 200_000):
        """chunk_bits: content-defined chunks have about 2 ** chunk_bits bytes."""
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(vocabulary_path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary_path(json_name))
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(vocabulary_path(json_name), encoding="utf-8") as f:
            added = {t["id"]: t["content"].encode() for t in json.load(f).get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*ranks.values(), *added]) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for i, b in added.items():
            self.bytes_of[i] = b
        self.specials = sorted(added.values())
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        core = self.fast._core_bpe.encode_ordinary  # the wrapper only adds handling of lone surrogates, which UTF-8 cannot hold
        encode = lambda texts: list(map(core, texts))
        self.chunks, self.joins, self.units = (Memo(encode, max_entries) for _ in range(3))
        self.mask = np.uint32(((1 << chunk_bits) - 1) << 16)
        # a fixed pseudo-random word for each byte value
        self.gear = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), np.uint32)

    @staticmethod
    def lone_spaces(b: np.ndarray) -> np.ndarray:
        """Places of lone spaces. A neighbour that could end or begin a white-space character beyond ASCII disqualifies."""
        if len(b) < 4:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(b[2:-1] == 32) + 2
        before, two, after = b[at - 1], b[at - 2], b[at + 1]
        left = ((before > 32) & (before < 127)) | ((before >= 128) & (two >= 0xC3) & (two <= 0xDF))
        right = ((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xDF))
        return at[left & right]

    @staticmethod
    def unit_starts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of units: lone spaces, text starts, sentence marks after a letter, letters after a line feed that no other white space precedes.

        A run of letters always ends a pre-token, and a line feed never joins what follows, so these are boundaries as well.
        """
        mark = np.zeros(len(b) + 1, bool)
        mark[Codec.lone_spaces(b)] = True
        letter = LETTER[b]
        after = MARK[b[2:]] & (letter[1:-1] | ((b[:-2] == 0xC3) & (b[1:-1] >= 0x80) & (b[1:-1] != 0x97) & (b[1:-1] != 0xB7)))
        mark[2:-1] |= after
        mark[2:-1] |= letter[2:] & (b[1:-1] == 10) & (b[:-2] > 32) & (b[:-2] < 127)
        mark[offsets] = True
        mark[len(b)] = False
        return np.flatnonzero(mark)

    def _special(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Texts that hold a special token's string."""
        found = set()
        for s in self.specials:
            at = raw.find(s)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(s) <= offsets[d + 1]:
                    found.add(d)
                at = raw.find(s, at + 1)
        return sorted(found)

    def _with_special(self, raw: bytes, offsets: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library itself encodes the texts that hold a special token."""
        odd = self._special(raw, offsets)
        if not odd:
            return ids, ends
        parts = [ids[ends[d] : ends[d + 1]] for d in range(len(ends) - 1)]
        for d in odd:
            parts[d] = np.array(self.whole.encode(raw[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def encode_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and the n+1 offsets: each distinct unit is encoded once."""
        raw, offsets = body(texts)
        b = np.frombuffer(raw, np.uint8)
        starts = self.unit_starts(b, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        edges = np.concatenate((starts, [len(b)]))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        pool, at, size = self.units(units.dictionary.to_pylist())
        codes = units.indices.to_numpy(zero_copy_only=False)
        at, size = at[codes], size[codes]
        ids = pool[np.repeat(at, size) + runs(size)]
        ends = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]
        return self._with_special(raw, offsets, ids, ends)

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Content-defined cuts: where a rolling hash of the last 16 bytes has zeros in the mask, moved on to a character's start."""
        with np.errstate(over="ignore"):
            h = self.gear[b]
            for w in (1, 2, 4, 8):
                h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        at = np.flatnonzero((h & self.mask) == 0) + 1
        return at[(at < len(b)) & ((b[np.minimum(at, len(b) - 1)] & 0xC0) != 0x80)]

    def encode_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and the n+1 offsets, by content-defined chunks.

        Each distinct chunk is encoded once. Near its ends a chunk's tokens may differ from those of the whole text, so of a
        chunk only the tokens between its first and last lone space stay; what lies between those of neighbouring chunks is
        encoded anew. Where a chunk has no lone space, or no token starts there, the join takes in the whole chunk: it grows
        until its tokens and the kept ones meet at a place that is a boundary for both.
        """
        raw, offsets = body(texts)
        b = np.frombuffer(raw, np.uint8)
        full = np.diff(offsets) > 0
        if not full.any():
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first_of, last_of = offsets[:-1][full], offsets[1:][full]
        mark = np.zeros(len(b), bool)
        mark[self.cuts(b)] = mark[first_of] = True
        s = np.flatnonzero(mark)
        e = np.concatenate((s[1:], [len(b)]))
        safe = np.concatenate((self.lone_spaces(b), [len(b) + 9]))
        pool, at, size = self.chunks([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        # the first and last lone space that the chunk's own bytes show to be one
        f, last = safe[np.searchsorted(safe, s + 2)], safe[np.searchsorted(safe, e - 1) - 1]
        whole_start, whole_end = np.isin(s, first_of, assume_unique=True), np.isin(e, last_of, assume_unique=True)
        has = (f <= e - 2) | (whole_start & whole_end)
        last = np.where(has & ~(f <= e - 2), e, last)
        lo, hi = np.where(whole_start, s, f), np.where(whole_end, e, last)
        # where those bytes lie among the chunk's tokens
        begins = np.concatenate(([0], np.cumsum(self.size_of[pool])))
        lo_t, hi_t = np.searchsorted(begins, begins[at] + np.minimum(lo, e) - s), np.searchsorted(begins, begins[at] + np.maximum(hi, s) - s)
        has &= (begins[np.minimum(lo_t, len(pool))] == begins[at] + lo - s) & (begins[np.minimum(hi_t, len(pool))] == begins[at] + hi - s)
        k = np.flatnonzero(has)
        lo, hi, lo_t, hi_t = lo[k], hi[k], lo_t[k], hi_t[k]
        # what no kept range covers, text by text
        left, right = np.concatenate((first_of, hi)), np.concatenate((lo, last_of))
        left, right = np.sort(left), np.sort(right)
        gaps = right > left
        left, right = left[gaps], right[gaps]
        own, gap_at, gap_size = self.joins([raw[x:y] for x, y in zip(left.tolist(), right.tolist(), strict=True)])
        both = np.concatenate((pool, own))
        begin, start, length = np.concatenate((lo, left)), np.concatenate((lo_t, gap_at + len(pool))), np.concatenate((hi_t - lo_t, gap_size))
        order = np.argsort(begin, kind="stable")
        begin, start, length = begin[order], start[order], length[order]
        ids = both[np.repeat(start, length) + runs(length)]
        ends = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(begin, offsets)]
        return self._with_special(raw, offsets, ids, ends)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts in order, and the n+1 offsets."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw, np.concatenate(([0], np.cumsum(self.size_of[ids])))[ends]


_codecs: dict[tuple, Codec] = {}


def codec(**options) -> Codec:
    """One codec a worker process and vocabulary."""
    key = tuple(sorted(options.items()))
    if key not in _codecs:
        _codecs[key] = Codec(**options)
    return _codecs[key]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, ids array<int>: whole texts, null as empty (no ids). Repeated rows and null ids stay; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(**options)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = c.encode_chunks(part.column("text"))
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", **options) -> DataFrame:
    """id, text: bytes that are no UTF-8 become U+FFFD; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(**options)
        for batch in batches:
            texts = [b"".join(map(c.bytes_of.__getitem__, x or ())).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, of which only digests leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(**options)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = c.encode_chunks(part.column("text"))
                raw, at = c.decode(ids, ends)
                ids = memoryview(ids.astype("<u4"))
                n = range(part.num_rows)
                yield pa.record_batch([part.column("id"), pa.array(np.diff(ends)), [sha(ids[ends[d] : ends[d + 1]]) for d in n], [sha(raw[at[d] : at[d + 1]]) for d in n]], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
