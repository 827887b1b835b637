"""Quality classifier: a factorisation machine over hashed words, structure statistics and size, scored by the sum-of-squares identity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, body, crc32_mod, mix, slices

#: Upper edges of the bins of each structure statistic; a statistic is one feature for each bin that it reaches (a thermometer code).
EDGES = np.array([0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.17, 0.25, 0.35, 0.5, 0.7, 0.9])
STATS = 12
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91)]] = 1  # upper case
_CLASS[[*range(97, 123), *range(128, 256)]] = 2  # other letters
_CLASS[[*range(48, 58)]] = 3  # digits
_CLASS[[32, *range(9, 14)]] = 4  # white space
_CLASS[[*b".,;:?'\"-"]] = 5  # sentence marks
_CLASS[[*b"!"]] = 6
_CLASS[[*b"|"]] = 7


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, columns, values of the feature matrix: distinct hashed words (unit length a text), then bins of statistics."""
    raw, offsets = body(texts)
    n = len(offsets) - 1
    b = np.frombuffer(raw, np.uint8)
    length = np.diff(offsets)
    owner = np.repeat(np.arange(n), length)
    kinds = np.bincount(owner * 8 + _CLASS[b], minlength=8 * n).reshape(n, 8)[:, :8].astype(np.float64)
    words = Words(texts, LOWER)
    w = words.rows()
    # distinct words of each text with their counts
    key, tf = np.unique(w * max(1, len(words.distinct)) + words.codes, return_counts=True)
    row, code = np.divmod(key, max(1, len(words.distinct)))
    weight = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(row, weight * weight, n))
    value = weight / norm[row] if len(row) else weight
    column = (mix(words.hashes(1)) % np.uint64(buckets)).astype(np.int64)[code] if len(row) else np.zeros(0, np.int64)
    count = np.maximum(1, words.counts)
    distinct = np.bincount(row, minlength=n)
    size = np.maximum(1, length)
    lines = np.bincount(owner[b == 10], minlength=n) if len(b) else np.zeros(n)
    longest = np.fromiter(map(len, words.distinct), np.float64, len(words.distinct))
    letters = np.bincount(w, longest[words.codes], n) if len(w) else np.zeros(n)
    stats = np.column_stack(
        (
            kinds[:, 1] / size,
            kinds[:, 3] / size,
            kinds[:, 0] / size,
            kinds[:, 5] / size,
            kinds[:, 6] / count,
            kinds[:, 7] / count,
            lines / count,
            1 - distinct / count,
            np.minimum(1, letters / count / 20),
            np.bincount(row, (tf - 1) * (tf > 1), n) / count if len(row) else np.zeros(n),
            np.minimum(1, np.log1p(words.counts) / 12),
            np.minimum(1, np.log1p(length) / 16),
        )
    )
    on = stats[:, :, None] >= EDGES
    r, s, e = np.nonzero(on)
    bias = np.arange(n)
    rows = np.concatenate((row, r, bias))
    columns = np.concatenate((column, buckets + s * len(EDGES) + e, np.full(n, buckets + STATS * len(EDGES))))
    values = np.concatenate((value, np.full(len(r), 0.3), np.ones(n)))
    return rows, columns, values


@dataclass
class Machine:
    buckets: int
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, n: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """w.x + sum over pairs <v_i, v_j> x_i x_j, the latter as half of (sum v x)^2 - sum (v x)^2: linear in the features."""
        out = np.bincount(rows, self.linear[columns] * values, n)
        for k in range(self.factors.shape[1]):
            vx = self.factors[columns, k] * values
            total = np.bincount(rows, vx, n)
            out += 0.5 * (total * total - np.bincount(rows, vx * vx, n))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(len(texts), *features(texts, self.buckets)), -40, 40)))


def train(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, buckets: int = 1 << 15, rank: int = 4, epochs: int = 6, least_steps: int = 300, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss, in a fixed order of pseudo-random batches: `epochs` passes, and more if that gives less than least_steps batches."""
    rng = np.random.default_rng(seed)
    width = buckets + STATS * len(EDGES) + 1
    params = [np.zeros((width, 1)), rng.normal(0, 0.05, (width, rank))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    ends = np.searchsorted(rows, np.arange(len(labels) + 1))
    step = 0
    passes = max(epochs, -(-least_steps // -(-len(labels) // batch))) if len(labels) else 0
    for _ in range(passes):
        shuffled = rng.permutation(len(labels))
        for s in range(0, len(shuffled), batch):
            docs = shuffled[s : s + batch]
            size = ends[docs + 1] - ends[docs]
            at = np.repeat(ends[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r, c, x = np.repeat(np.arange(len(docs)), size), columns[at], values[at]
            used, local = np.unique(c, return_inverse=True)
            machine = Machine(buckets, params[0][:, 0], params[1])
            p = 1 / (1 + np.exp(-np.clip(machine.margin(len(docs), r, c, x), -40, 40)))
            g = ((p - labels[docs]) / len(docs))[r] * x
            grads = [np.bincount(local, g, len(used))[:, None], np.empty((len(used), rank))]
            for k in range(rank):
                v = params[1][c, k]
                total = np.bincount(r, v * x, len(docs))
                grads[1][:, k] = np.bincount(local, g * (total[r] - v * x), len(used))
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + decay * params[i][used]
                first[i][used] = 0.9 * first[i][used] + 0.1 * grad
                second[i][used] = 0.99 * second[i][used] + 0.01 * grad * grad
                params[i][used] -= rate * (first[i][used] / (1 - 0.9**step)) / (np.sqrt(second[i][used] / (1 - 0.99**step)) + 1e-8)
    return Machine(buckets, params[0][:, 0].copy(), params[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 1 << 15, **options) -> Machine:
    """Trains on at most `sample` labelled rows that are not held out, those with the smallest hashes of their ids.

    Labels that are null or contradict each other are left out; of texts that share an id the smallest counts. `sample` bounds what reaches the driver; nothing else about
    the operator depends on it.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc32_mod(id_col, 5) != 0))
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other").select("id", "label")
    chosen = given.orderBy(F.crc32(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary")), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # one text an id, however often it is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_ in batches:
            for part in slices(batch_, "text", 2 << 20):
                row, column, value = features(part.column("text"), buckets)
                order = np.lexsort((column, row))
                ends = pa.array(np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (column.astype(np.int32), value)]
                yield pa.record_batch([part.column("id"), part.column("label"), *lists], names=["id", "label", "columns", "values"])

    # features are made where the texts are; the driver gets those of the sample alone
    got = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("double").alias("label"), "text").mapInArrow(run, "id long, label double, columns array<int>, values array<double>").orderBy("id", "columns").toArrow()
    columns, values = (got.column(k).combine_chunks() for k in ("columns", "values"))
    sizes = np.diff(columns.offsets.to_numpy()) if len(columns) else np.zeros(0, np.int64)
    return train(np.repeat(np.arange(len(sizes)), sizes), columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), got.column("label").to_numpy(), buckets=buckets, **options)


def quality_scores(docs: DataFrame, machine: Machine, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Null and empty texts are scored by their statistics (all least).

    One pass without a shuffle; the model's size is fixed by its buckets. Repeated rows are scored alike; a null id is hashed
    as the empty text for held_out. Labels, language, source and id are no inputs; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                score = machine.score(part.column("text"))
                yield pa.record_batch([part.column("id"), part.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (crc32_mod(id_col, 5) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, machine: Machine, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                yield part.filter(pa.array(machine.score(part.column(text_col)) >= cut))

    return docs.mapInArrow(run, docs.schema)
