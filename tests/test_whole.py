"""Queries over whole tables and whole texts that have no SQL, by brute force."""

import re
import unicodedata

from factloom.plans import queries as core
from factloom.plans import queries_more  # noqa: F401


def squeeze(t):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")


def test_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word = lambda c: c in "_ \t\n\x0b\f\r" or unicodedata.category(c)[0] in "LN"
    surface = {i: squeeze(t.casefold()) for i, t in texts.items()}
    name = {i: squeeze("".join(c if word(c) else " " for c in t.casefold())) for i, t in texts.items()}
    assert max(map(len, surface.values())) > 60
    assert {r.key: r.value for r in core.QUERIES["x01_normalize_surface"](spark, sf).collect()} == surface
    assert {r.key: r.value for r in core.QUERIES["x02_normalize_name"](spark, sf).collect()} == name


def test_case_folding(spark):
    """As Python folds, for every letter up to U+2FFF and the ligatures, but for scripts whose case the JVM and Python date differently."""
    from pyspark.sql import functions as F

    from factloom.functions.scalars import casefold

    letters = [chr(i) for i in [*range(0x20, 0x3000), *range(0xFB00, 0xFB07)] if unicodedata.category(chr(i))[0] == "L" and not 0x13A0 <= i <= 0x13FF]
    got = spark.createDataFrame([(f"a{c}b",) for c in letters], "s string").select("s", casefold(F.col("s")).alias("f")).collect()
    off = [r.s for r in got if r.f != r.s.casefold()]
    assert len(off) <= 3, off


def test_long_urls_stay_whole(spark, tmp_path):
    rest = "a.org/" + "x" * 3000
    spark.createDataFrame([(1, f"https://{rest}"), (2, f"http://{rest}"), (3, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.key: r.value for r in core.QUERIES["x07_prefix"](spark, str(tmp_path)).collect()} == {1: rest, 2: f"http://{rest}", 3: None}


def test_shared_identifiers_of_all_lines(spark, sf):
    orders = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        orders.setdefault(r.l_orderkey, set()).add(r.l_suppkey)
    want = {(a, b) for x in orders.values() for a in x for b in x if a < b}
    got = [tuple(r) for r in core.QUERIES["j22_shared_identifiers"](spark, sf).select("left_id", "right_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_shared_identifiers_on_any_line(spark, tmp_path):
    lines = [(1, 1, 10), (1, 2, 20), (1, 7, 30), (2, 3, 40), (2, 4, 10), (2, 5, 10), (3, 1, 50)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = core.QUERIES["j22_shared_identifiers"](spark, str(tmp_path)).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [(10, 20), (10, 30), (10, 40), (20, 30)]


def test_layer_rule_of_all_suppliers(spark, tmp_path):
    n = 403
    spark.range(n).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {(f"m{i}", f"m{i * 7 % n}", "layer") for i in range(n) if i * 7 % n < i and i * 7 % n % 5 > i % 5}
    got = [tuple(r) for r in core.QUERIES["k02_layer_rule"](spark, str(tmp_path)).select("module", "target", "problem").collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(int(m[1:]) for m, _, _ in got) > 350


def test_traversal_follows_a_page_and_tells_of_more(spark, tmp_path):
    from factloom.operators.traverse import hop_paths

    lines = [(i, 1, 1, i) for i in range(100, 207)] + [(i, 2, 2, i) for i in range(300, 320)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = core.QUERIES["q04_traverse_two_hops"](spark, str(tmp_path)).collect()
    assert sum(r.start == "s1" for r in got) == 100 and sum(r.start == "s2" for r in got) == 20
    assert all(r.truncated == (r.start == "s1") for r in got)
    edges = spark.createDataFrame([(1, "a", "b", 1), (2, "b", "c", 1), (3, "b", "d", 2)], "edge_id long, source string, target string, rank long")
    starts = spark.createDataFrame([("a",)], "start string")
    for n, want in ((1, [(1, True), (2, True)]), (2, [(1, False), (2, False), (2, False)]), (None, [(1, False), (2, False), (2, False)])):
        assert sorted((r.hops, r.truncated) for r in hop_paths(edges, starts, 2, per_node=n).collect()) == want
