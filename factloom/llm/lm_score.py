"""Language-model scores from a log-frequency Bloom filter of n-gram counts, and an exact add-one unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, binaries, crc32_mod, mix, slices, written

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of the end of a text and of what stands before its first word: white space, so no word's hash is computed from it.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n", b" "))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (the end last), codes of all tokens with one end a text, the n+1 offsets, hashes of all bigrams."""
    words = Words(texts, LOWER)
    kinds = np.append(words.hashes(), END)
    n = len(words.offsets) - 1
    offsets = words.offsets + np.arange(n + 1)
    codes = np.empty(int(offsets[-1]), np.int64)
    last = np.zeros(len(codes), bool)
    last[offsets[1:] - 1] = True
    codes[~last], codes[last] = words.codes, len(kinds) - 1
    return kinds, codes, offsets, bigrams(kinds, codes, offsets)


def bigrams(kinds: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token the hash of it and the one before it."""
    current = kinds[codes]
    before = np.empty_like(current)
    before[1:] = current[:-1]
    before[offsets[:-1]] = START
    with np.errstate(over="ignore"):
        return mix(before * _ODD + current)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _counts(bits: int, held: int = 3_000_000):
    """kind, bucket, keys, counts: packed counts of one task; kind 0 words, kind 1 bigrams. The bucket is the hash's upper `bits` bits."""

    def packed(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        ends = np.append(ends, len(keys))
        full = np.flatnonzero(np.diff(ends))  # empty buckets make no rows
        ends = np.append(ends[full], len(keys))
        # of a bigram the bucket and the next 32 bits stay; of a word the whole hash
        image = binaries(keys, ends) if kind == 0 else binaries((keys >> np.uint64(32 - bits)).astype(np.uint32), ends)
        return pa.record_batch([pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), image, binaries(counts.astype(np.uint32), ends)], names=["kind", "bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[list] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if sums[kind]:
                    yield packed(kind, *_summed(np.concatenate([k for k, _ in sums[kind]]), np.concatenate([c for _, c in sums[kind]])))
                    sums[kind].clear()

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                kinds, codes, _, pairs = tokens(part.column("text"))
                count = np.bincount(codes, minlength=len(kinds))
                sums[0].append(_summed(kinds, count))
                sums[1].append(_summed(pairs, np.ones(len(pairs), np.int64)))
                size += len(sums[1][-1][0])
                if size > held:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    """The quantised logarithm: 1 for a count of 1, 2 for 2-3, 3 for 4-7, and so on."""
    return np.frexp(counts.astype(np.float64))[1]


@dataclass
class Filter:
    """A bucket's Bloom filter of (n-gram, level) for every level up to that of its count."""

    hashes: int
    image: np.ndarray  # uint8

    @classmethod
    def made(cls, fingerprint: np.ndarray, counts: np.ndarray, hashes: int, false_hits: float, size: int | None = None) -> Filter:
        """As many bits as leave `false_hits` false hits a probe, whatever the number of n-grams; or `size` bits."""
        top = levels(counts)
        if size is None:
            size = max(64, int(np.ceil(-hashes * int(top.sum()) / np.log1p(-(false_hits ** (1 / hashes))))))
        size = -(-size // 8) * 8
        out = cls(hashes, np.zeros(size // 8, np.uint8))
        on = np.zeros(size, np.uint8)
        for level in range(1, int(top.max(initial=0)) + 1):
            for at in out.places(fingerprint[top >= level], level):
                on[at] = 1
        out.image = np.packbits(on, bitorder="little")
        return out

    def places(self, fingerprint: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """Bit numbers."""
        with np.errstate(over="ignore"):
            h = mix(fingerprint.astype(np.uint64) * _ODD + np.uint64(level))
            step = (h >> np.uint64(32)) | np.uint64(1)
            for i in range(self.hashes):
                yield (h + np.uint64(i) * step) % np.uint64(8 * len(self.image))

    def level(self, fingerprint: np.ndarray) -> np.ndarray:
        """Levels are probed upwards until one is missing; 0 for what is not there."""
        out = np.zeros(len(fingerprint), np.uint8)
        live = np.arange(len(fingerprint))
        for level in range(1, 64):
            hit = np.ones(len(live), bool)
            for at in self.places(fingerprint[live], level):
                hit &= (self.image[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            if not len(live):
                break
            out[live] = level
        return out


def estimated(level: np.ndarray) -> np.ndarray:
    """The mean of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (3 * 2.0 ** (level.astype(np.float64) - 1) - 1) / 2, 0.0)


def _reduced(bits: int, hashes: int, false_hits: float, size: int | None):
    """One bucket: exact word counts, and the filter of its words and bigrams."""

    def run(group: pa.Table) -> pa.Table:
        kind, bucket = group.column("kind").to_numpy(), group.column("bucket")[0].as_py()

        def merged(k: int, real: type) -> tuple[np.ndarray, np.ndarray]:
            own = group.filter(pa.array(kind == k))
            keys, counts = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in (("keys", real), ("counts", np.uint32)))
            return _summed(keys, counts.astype(np.int64))

        words, word_counts = merged(0, np.uint64)
        pairs, pair_counts = merged(1, np.uint32)
        short = ((words >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        image = Filter.made(np.concatenate((short, pairs)), np.concatenate((word_counts, pair_counts)), hashes, false_hits, size).image
        n = len(words)
        return pa.table(
            {
                "word": pa.array(np.append(words, np.uint64(0)).view(np.int64)),
                "c": pa.array(np.append(word_counts, 0), pa.int64()),
                "bucket": pa.array(np.full(n + 1, bucket, np.int32)),
                "image": pa.array([None] * n + [image.tobytes()], pa.binary()),
            }
        )

    return run


def _squeezed(x: np.ndarray) -> bytes:
    """The numbers' length in bytes, and their compressed byte planes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(image: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(image[8:], int.from_bytes(image[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a chunk of whole texts: its first row number, ids, and tokens as codes of the chunk's distinct words."""
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            kinds, codes, offsets, _ = tokens(part.column("text"))
            # frequent words get small codes; the end stays last
            order = np.append(np.argsort(-np.bincount(codes, minlength=len(kinds))[:-1], kind="stable"), len(kinds) - 1)
            code = np.empty(len(kinds), np.uint32)
            code[order] = np.arange(len(kinds), dtype=np.uint32)
            row = [rid, part.column("id").to_pylist(), part.column("held_out").to_pylist(), kinds[order].tobytes(), _squeezed(code[codes]), offsets.tolist()]
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["chunk", "ids", "held_out", "kinds", "codes", "offsets"])
            rid += part.num_rows


def _decoded(kinds: bytes, codes: bytes, offsets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kinds, codes, offsets, the sorted distinct n-grams of a chunk, and where in them its kinds and then its bigrams are."""
    k, c, o = np.frombuffer(kinds, np.uint64), _restored(codes, np.uint32).astype(np.int64), np.array(offsets, np.int64)
    return k, c, o, *np.unique(np.concatenate((k, bigrams(k, c, o))), return_inverse=True)


def _probes(bits: int):
    """chunk, bucket, keys: each distinct n-gram of a chunk once, packed for the bucket whose filter holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, *coded = (batch.column(x)[r].as_py() for x in ("chunk", "kinds", "codes", "offsets"))
                keys = _decoded(*coded)[3]
                ends = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
                full = np.flatnonzero(np.diff(ends))
                short = (keys >> np.uint64(32 - bits)).astype(np.uint32)
                # sorted, so their differences are small
                images = [_squeezed(np.diff(short[ends[b] : ends[b + 1]], prepend=np.uint32(0))) for b in full.tolist()]
                yield pa.record_batch([pa.array(np.full(len(full), chunk)), pa.array(full.astype(np.int32)), pa.array(images, pa.binary())], names=["chunk", "bucket", "keys"])

    return run


def _answered(hashes: int):
    """One bucket: the levels of what all chunks ask of its filter; a bucket without filter holds nothing."""

    def run(asked: pa.Table, image: pa.Table) -> pa.Table:
        own = Filter(hashes, np.frombuffer(image.column("image")[0].as_py(), np.uint8)) if image.num_rows else None
        got = []
        for x in asked.column("keys").to_pylist():
            keys = np.cumsum(_restored(x, np.uint32), dtype=np.uint32)
            got.append(_squeezed(own.level(keys) if own else np.zeros(len(keys), np.uint8)))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "levels": pa.array(got, pa.binary())})

    return run


def _scored(shared, mu: float):
    """A row a document: sums over its tokens in the broadcast head, its other words with their counts, and the model's score."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        head, head_counts, total, distinct = shared.value
        floor = total + distinct + 1
        rid, *coded = (chunk.column(x)[0].as_py() for x in ("chunk", "kinds", "codes", "offsets"))
        kinds, codes, offsets, _, place = _decoded(*coded)
        n = len(offsets) - 1
        at = np.minimum(np.searchsorted(head, kinds), max(0, len(head) - 1))
        known = head[at] == kinds if len(head) else np.zeros(len(kinds), bool)
        c = np.where(known, head_counts[at], 0) if len(head) else np.zeros(len(kinds), np.int64)
        token_known = known[codes]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        base = np.bincount(owner, np.log10(c + 1.0)[codes], n)
        n_known = np.bincount(owner, token_known, n).astype(np.int64)
        # words that the head does not hold, once a document
        rest = np.flatnonzero(~token_known)
        key, tf = np.unique(owner[rest] * len(kinds) + codes[rest], return_counts=True)
        row, code = np.divmod(key, len(kinds))
        ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        # buckets are in the order of the sorted n-grams
        level = np.concatenate([_restored(x, np.uint8) for x in answers.sort_by("bucket").column("levels").to_pylist()])
        count = estimated(level)[place]
        one, two = count[: len(kinds)], count[len(kinds) :]
        before = np.empty(len(codes))
        before[1:] = one[codes[:-1]]
        before[offsets[:-1]] = one[-1]  # as many texts begin as end
        two = np.minimum(two, np.minimum(before, one[codes]))
        p = (two + mu * (one[codes] + 1) / floor) / (before + mu)
        score = np.bincount(owner, np.log10(np.minimum(p, 1.0)), n)
        size = np.diff(offsets)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (kinds[code].view(np.int64), tf.astype(np.int64))]
        ids, held_out = (chunk.column(x).combine_chunks().flatten() for x in ("ids", "held_out"))
        return pa.table([pa.array(rid + np.arange(n)), ids, held_out, pa.array(size), pa.array(n_known), pa.array(base - size * np.log10(floor)), pa.array(score), *lists], names=["rid", "id", "held_out", "n_tokens", "n_known", "base", "score", "words", "tfs"])

    return run


def ngram_tables(rows: DataFrame, bits: int, hashes: int, false_hits: float, size: int | None) -> DataFrame:
    """word, c, bucket, image: the exact counts of all words, and one row a bucket (c = 0) with its filter of words and bigrams."""
    packed = rows.select("text").mapInArrow(_counts(bits), "kind int, bucket int, keys binary, counts binary")
    return written(packed.groupBy("bucket").applyInArrow(_reduced(bits, hashes, false_hits, size), "word long, c long, bucket int, image binary"), "ngrams")


def lm_scores(docs: DataFrame, filter_bits: int | None = None, hashes: int = 2, mu: float = 20.0, head: int = 1 << 20, false_hits: float = 0.01, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from all rows with crc32(id) mod 7 <> 2 (a null id hashes as the empty text). base_score is exact: frequent words
    (at most `head`, 16 bytes each) are looked up in a broadcast table, all other words by a join with the whole count table.
    score is a bigram model, p(w|v) = (c(v w) + mu * p(w)) / (c(v) + mu) with p(w) = (c(w) + 1) / (N + V + 1), whose counts
    are read from log-frequency Bloom filters, one a hash bucket. Each has as many bits as its own n-grams and their levels need
    for `false_hits` false hits a probe (about 19 bits a level of an n-gram), so estimates are alike at every size of the input;
    filter_bits fixes the sum of the sizes at 2**filter_bits bits instead. There is a bucket for every bucket_bytes of text, 64 at least. Filters are not broadcast: the distinct n-grams of each
    chunk of texts go to their bucket, and levels come back, a byte each.

    Null and empty texts are the end token alone. Without training rows N = V = 0. Repeated rows are scored alike, and count
    as often as they occur. Words are told apart by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (crc32_mod(id_col, 7) == 2).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # buckets grow with the texts, so what one task merges does not
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(20, max(6, int(np.ceil(np.log2(max(1, held / bucket_bytes))))))
    size = None if filter_bits is None else 1 << max(10, filter_bits - bits)
    merged = ngram_tables(rows.where("not held_out"), bits, hashes, false_hits, size)
    counts = merged.where("c > 0").select("word", "c")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the head: all words of at least 2**level occurrences, for the least level at which they are no more than `head`
    held, level = 0, 63
    for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if held + r["n"] > head:
            break
        held, level = held + r["n"], r["level"]
    top = counts.where(F.col("c") >= F.lit(1 << min(level, 62))).toArrow() if held else pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    words, c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(words)
    shared = spark.sparkContext.broadcast((words[order], c[order], total, distinct))
    encoded = written(rows.mapInArrow(_encoded, "chunk long, ids array<long>, held_out array<boolean>, kinds binary, codes binary, offsets array<long>"), "encoded")
    probes = encoded.select("chunk", "kinds", "codes", "offsets").mapInArrow(_probes(bits), "chunk long, bucket int, keys binary")
    images = merged.where("image is not null").select("bucket", "image")
    answers = probes.groupBy("bucket").cogroup(images.groupBy("bucket")).applyInArrow(_answered(hashes), "chunk long, bucket int, levels binary")
    scored = encoded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(shared, mu), "rid long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, tfs array<long>")
    scored = written(scored, "scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("words", "tfs")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.tfs").alias("tf"))
    rest = counts.where(F.col("c") < F.lit(1 << min(level, 62))) if held else counts
    found = tail.join(rest, "word").groupBy("rid").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("gain"))
    out = scored.select("rid", "id", "held_out", "n_tokens", "n_known", "base", "score").join(found, "rid", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score")
