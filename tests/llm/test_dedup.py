import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from factloom.llm import exact_dedup as ed
from factloom.llm.embedding_dedup import bundles, embedding_dedup, interval_pairs
from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.graph import components
from factloom.llm.near_dedup import near_dedup, sketches
from factloom.llm.queries import ORACLE_SQL, QUERIES


def oracle(sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    return sorted(rel.columns), sorted(map(tuple, rel.select(*sorted(rel.columns)).fetchall()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert (cols, sorted(tuple(r) for r in df.select(cols).collect())) == oracle(sf, name)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def closed(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(7, 7)], "a long, b long")).collect()}
    want = closed({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_expected(rows, num, den):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in closed(ids, links).items()}


def variants(spark):
    """A base text absent from the table, of which every row is a near copy: stars alone would not connect them."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 300)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(300, rng.integers(1, 9), replace=False):
            words[at] = f"v{rng.integers(0, 10_000)}"
        rows.append((i + 1, " ".join(words)))
    return rows + [(500 + i, rows[0][1]) for i in range(40)]


def test_near(spark, docs, texts):
    for num, rows, frame in ((85, list(texts.items()), docs), (80, v := variants(spark), spark.createDataFrame(v, "doc_id long, text string"))):
        got = {r.doc_id: r for r in near_dedup(frame, num=num, den=100, block=20).collect()}
        want = near_expected(rows, num, 100)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_rows_without_id_and_ids_with_several_texts(spark):
    v = variants(spark)
    rows = [(None, v[0][1]), (None, v[1][1]), (7, v[2][1]), (7, "alone " * 9), (7, "alone " * 9), (3, v[3][1]), (None, "quite other words than all of the rest"), (9, "u u u"), (9, "w w w")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hashed=True).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("None", "3", False), ("None", "3", False), ("7", "3", False), ("7", "7", True), ("7", "7", True), ("3", "3", True), ("None", "None", True), ("9", "9", True), ("9", "9", True)]
    )
    assert len({(r.doc_id, r.text_hash) for r in got}) == 8


def test_crowded_buckets_of_two_components(spark):
    """Copies of two texts that share buckets and are not alike: members of one component are not dealt to each other."""
    from factloom.llm import near_dedup as nd

    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(70)]
    other = base[:58] + [f"o{i}" for i in range(12)]
    rows = []
    for i in range(2400):
        words = list((base, other)[i % 2])
        words[0 if rng.random() < 0.5 else 1] = f"v{i}"
        rows.append((i, " ".join(words)))
    dealt = []
    keep = nd._dealt
    nd._dealt = lambda *a: dealt.append(keep(*a)) or dealt[0]
    try:
        got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=100).collect()}
    finally:
        nd._dealt = keep
    sets = [shingles(t) for _, t in rows]
    index = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(index)), np.float32)
    for i, x in enumerate(sets):
        m[i, [index[y] for y in x]] = 1
    both = m @ m.T
    size = m.sum(axis=1)
    assert got == closed(range(len(rows)), np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size[None] - both), 1)).tolist())
    if dealt and dealt[0] is not None:
        assert dealt[0].count() < 24 * 2400 * (2400 / 100) * 0.7


def test_near_odd(odd, none):
    got = near_dedup(odd).collect()
    assert len(got) == 15
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].component_id == by[2].component_id == 1 and by[6].component_id == by[7].component_id == 6
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (3, 4, 5))
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles) == [(6, 1, False)] and len([r for r in got if r.doc_id is None]) == 2
    assert by[10].n_shingles == 2 and near_dedup(none).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 3000):
        own = rng.integers(0, 1 << 60, size + size // 3, dtype=np.uint64)
        a, b = np.sort(own[:size]), np.sort(own[size // 3 :])
        s = sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 96)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.25


def test_exact_odd(odd, odd_rows, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for row in odd_rows:
        groups[norm(row[1])].append(row[0])
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), i == min((x for x in g if x is not None), default=None), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    for size in (96 << 20, 300):  # the second spills to files at several levels
        got = exact_dedup(odd, table_bytes=size, fanout=3).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup(none).count() == 0


def test_grace_recursion():
    rows = [(hashlib.sha256(str(i % 700).encode()).hexdigest(), str(i % 700), i, 1) for i in range(3000)]
    import pyarrow as pa

    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=ed._CLASS)
    out = pa.Table.from_batches(list(ed._grace(2000, 4)(iter([batch])))).to_pylist()
    assert len(out) == 700 and sum(r["group_size"] for r in out) == 3000 and sorted(r["keep_id"] for r in out) == list(range(700))


def cosine_expected(rows, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    n = defaultdict(int)
    for p in links:
        for x in p:
            n[x] += 1
    return {i: (n[i], c) for i, c in closed([i for i, _ in rows], links).items()}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 12] + rng.normal(size=16) * 0.22]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    frame = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<float>, id string, links int, vec string").repartition(3)
    got = embedding_dedup(frame, block=64, dims=4)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == cosine_expected(rows)
    assert embedding_dedup(frame.limit(0)).count() == 0
    # a session that deals out more parts than asked for
    kind = type(frame)
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *cols: deal(self, 40, *cols))
    assert bundles([3, 3, 3, 10, 1], 6) == [0, 0, 1, 2, 3] and bundles([], 6) == []
    again = embedding_dedup(frame.select("vec_id", frame.embedding.cast("array<double>").alias("embedding")), block=200)
    assert {r.vec_id: (r.n_links, r.component_id) for r in again.collect()} == cosine_expected(rows)


def test_embeddings_without_id(spark):
    """Vectors without id are compared like all others: every number of links is that of plain loops over all rows."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(5, 6))
    rows = [(None if i % 3 else i % 30, [float(np.float32(x)) for x in centers[i % 5] + rng.normal(size=6) * 0.25]) for i in range(90)]
    rows += [(None, rows[0][1]), (None, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, None)]
    plain = cosine_expected(list(enumerate(v for _, v in rows)))
    groups = defaultdict(list)
    for i, (_, c) in plain.items():
        groups[c].append(i)
    low = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16, dims=2).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == sorted(str((i, plain[k][0], low[k], i == low[k])) for k, (i, _) in enumerate(rows))


def test_interval_pairs():
    rng = np.random.default_rng(4)
    lo = np.sort(rng.uniform(0, 10, (60, 2)), axis=0)
    hi = lo + rng.uniform(0, 0.5, (60, 2))
    gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
    want = {(i, j) for i, j in np.argwhere((gap**2).sum(axis=2) <= 0.25).tolist() if i <= j}
    assert set(interval_pairs(lo, hi, 0.5)) == want and interval_pairs(lo[:0], hi[:0], 0.5) == []


def test_pair_belongs_to_the_first_band_that_its_buckets_share():
    """An earlier band whose coordinates agree in their low 16 bits alone is not shared."""
    import pyarrow as pa

    from factloom.llm.near_dedup import ROWS, _needed

    sketch = np.arange(24 * ROWS, dtype=np.uint16).tobytes()
    own = [list(range(24)), [-1, -2, -3, *range(3, 24)]]  # bands 0 to 2 differ in upper bits
    for bi, want in ((0, 0), (3, 2), (4, 0)):
        group = pa.table({"band": [own[0][bi]] * 2, "bi": [bi] * 2, "g1": [0] * 2, "g2": [0] * 2, "id": [1, 2], "component": [1, 2], "block": [0, 0], "sketch": [sketch] * 2, "bands": own})
        assert _needed(24, 80, 100)(group).num_rows == want
