import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm.packing import pack, pack_histogram, token_sequences


def placed(histogram, slots):
    """(sequence, offset, length) of every rank of every length."""
    for length, n in histogram.items():
        own = sorted((s for s in slots if s.length == length), key=lambda s: s.low)
        for s, high in zip(own, [x.low for x in own[1:]] + [n], strict=True):
            for r in range(high - s.low):
                yield s.first + r // s.each, s.offset + r % s.each * length, length


@pytest.mark.parametrize("histogram", [{}, {1: 5000}, {2048: 3, 2047: 2, 1: 7}, {1500: 40, 600: 3}, Counter(np.random.default_rng(1).integers(1, 2049, 5000).tolist())])
def test_histogram(histogram):
    seqs = defaultdict(list)
    for q, o, n in placed(histogram, pack_histogram(histogram, 2048)):
        seqs[q].append((o, n))
    assert sum(map(len, seqs.values())) == sum(histogram.values()) and set(seqs) == set(range(len(seqs)))
    for rows in seqs.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 2048


def check(rows, got, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), capacity):
            part = np.array(ids[s : s + capacity], "<u4")
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return sum(r.length for r in got) / (capacity * max(1, len(seqs)))


def test_pack(docs, texts, odd, odd_rows, none):
    assert check(list(texts.items()), pack(docs).collect(), 2048) > 0.98
    check([(r[0], r[1]) for r in odd_rows], pack(odd, 64).collect(), 64)
    assert pack(none).count() == 0


def test_sequences(docs, texts):
    packed = pack(docs, 256)
    ids = {r.sequence_id: r.ids for r in token_sequences(docs, packed, 256).collect()}
    for r in packed.collect():
        part = np.array(ids[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32


def test_pipeline(spark, sf, texts):
    """Stage by stage against plain versions on the smallest tables."""
    from test_dedup import near_expected

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = corpus_pipeline.quality(spark, docs, sf)
    assert first.columns == docs.columns
    ids = {r.doc_id for r in first.collect()}
    assert sum((labels[i] == 1) == (i in ids) for i in labels) >= 0.97 * len(labels) and all(i in ids for i, q in labels.items() if q == 1)
    second = corpus_pipeline.exact(spark, first, sf)
    low = {}
    for i in ids:
        key = " ".join(f"|{texts[i]}|".split())
        low[key] = min(i, low.get(key, i))
    assert {r.doc_id for r in second.collect()} == set(low.values()) and second.columns == docs.columns
    third = corpus_pipeline.near(spark, second, sf)
    want = {i for i, (_, c) in near_expected([(i, texts[i]) for i in low.values()], 80, 100).items() if i == c}
    assert {r.doc_id for r in third.collect()} == want and third.columns == docs.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == want
    check([(i, texts[i]) for i in want], rows, 2048)


def test_one_id_with_two_texts(spark, sf):
    """A text that goes takes no other text of its id along."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base), (5, "a text of its own, unlike the others here"), (None, base), (6, base + " more"), (6, None)]
    frame = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.exact(spark, frame, sf).collect())
    assert exact == sorted([("1", base), ("5", rows[2][1]), ("6", base + " more"), ("6", "None")])
    near = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.near(spark, frame, sf).collect())
    assert near == sorted([("1", base), ("5", rows[2][1]), ("6", "None")])


def test_stages_on_odd_rows(spark, sf, odd, odd_rows, none):
    """Null ids and texts, repeated rows, clashing columns: stages keep their columns and lose only what they decide on."""
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        ids = [str(r.doc_id) for r in out.collect()]
        if name == "quality":  # no labelled row: nothing is known against any text
            assert sorted(ids) == sorted(str(r[0]) for r in odd_rows)
        elif name == "exact":
            assert "2" in ids and "4" not in ids and ids.count("3") == 1
        else:
            assert "1" in ids and "2" not in ids and ids.count("5") == 2
        assert stage(spark, none, sf).count() == 0
    check([(r[0], r[1]) for r in odd_rows], corpus_pipeline.packing(spark, odd, sf).collect(), 2048)
    assert corpus_pipeline.packing(spark, none, sf).count() == 0
