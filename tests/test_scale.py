"""Linkage whose pairs grow with the square of a block: equal to brute force on odd rows, and no operator of the plan makes the pairs."""

import random

import pytest

from factloom.operators import identity
from factloom.plans.queries import _closeness as closeness


def most_rows(df):
    """Runs it; the most rows that an operator of its plan put out."""
    df.collect()
    most = 0

    def walk(p):
        nonlocal most
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined():
            most = max(most, rows.get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return most


def test_resolve_with_shared_ids_and_names(spark):
    r = random.Random(4)
    external = [(e, "reg", str(e % 7)) for e in range(10)] + [(3, "reg", "3"), (4, "reg", None), (None, "reg", "6")]
    types = [(e, "A" if e < 8 else "B") for e in range(10)] + [(2, "B")]
    records = [("reg", f"r{e}", e) for e in range(4)]
    names = [(e, f"ship {e}") for e in range(10)]
    queries = [(r.randrange(60), "reg", f"r{r.randrange(9)}", r.choice([None, *map(str, range(9))]), r.choice([None, "nobody", "ship 2", "ship 5"]), r.choice("AB")) for _ in range(90)]
    kinds, want = {}, []
    for e, t in types:
        kinds.setdefault(e, set()).add(t)
    for q in queries:
        mine = [x for x in queries if x[0] == q[0]]
        found = {e for x in mine for e, s, i in external if e is not None and i is not None and (s, i) == (x[1], x[3]) and x[5] in kinds[e]}
        known, near = next((e for _, n, e in records if n == q[2]), None), any((x[4] or "").startswith("ship") for x in mine)
        clash = len(found) > 1 or known is not None and found and found != {known}
        one = known if known is not None else min(found, default=None)
        want.append((q[0], "CONFLICT" if clash else "MATCH" if one is not None else "REVIEW" if near else "NEW", None if clash else one))
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    sides = frame(records, "source string, record_id string, entity_id long"), frame(external, "entity_id long, source string, external_id string"), frame(names, "entity_id long, surface string"), frame(types, "entity_id long, entity_type string")
    got = identity.resolve(frame(queries, "query_id long, source string, record_id string, external_id string, name string, entity_type string"), *sides).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {w[1] for w in want} == {"CONFLICT", "MATCH", "REVIEW", "NEW"}


def test_resolve_meets_owners_once(spark):
    n = 2000
    owners = spark.range(n).selectExpr("id as entity_id", "'reg' as source", "'1' as external_id", "'one name' as surface", "'A' as entity_type", "'x' as record_id")
    queries = spark.range(n).selectExpr("id as query_id", "'reg' as source", "'r' as record_id", "'1' as external_id", "'one name' as name", "'A' as entity_type")
    got = identity.resolve(queries, owners.select("source", "record_id", "entity_id"), owners.select("entity_id", "source", "external_id"), owners.select("entity_id", "surface"), owners.select("entity_id", "entity_type"))
    assert most_rows(got) <= 3 * n
    assert {tuple(r)[1:] for r in got.collect()} == {("CONFLICT", None)}


def test_blocked_totals(spark):
    """Keys with several rows, null keys and values, repeated rows; one, two and three rules."""
    r = random.Random(6)
    some = lambda n: r.choice([None, *range(n)])
    rules = [("a", "x"), ("b", "y"), ("c", "z")]
    for keys, n in ((40, 60), (10_000, 60), (3, 30)):
        left, right = ([(r.choice([None, *range(keys)]), some(5), some(9), some(4)) for _ in range(n)] for _ in "lr")
        frames = spark.createDataFrame(left * 2, "row_key long, a int, b int, c int"), spark.createDataFrame(right, "row_key long, x int, y int, z int")
        for m in (1, 2, 3):
            want = {(p[0], q[0]) for p in left for q in right if any(p[i] is not None and p[i] == q[i] for i in range(1, m + 1))}
            assert {tuple(x) for x in identity.blocked_pairs(*frames, rules[:m]).collect()} == want
            assert tuple(identity.blocked_totals(*frames, rules[:m]).first()) == (len(want), *(sum(p[i] or 0 for p in want) for i in (0, 1)))
    assert tuple(identity.blocked_totals(frames[0].where("false"), frames[1], rules).first()) == (0, None, None)


def test_blocks_are_counted_not_paired(spark, tmp_path):
    from factloom.plans import queries

    n = 2000
    for t, c in (("customer", "c"), ("supplier", "s")):
        key = f"{c}_custkey" if c == "c" else f"{c}_suppkey"
        spark.range(n).selectExpr(f"id as {key}", f"1 as {c}_nationkey", f"concat('{t.title()}#', lpad(id % 500, 9, '0')) as {c}_name").write.parquet(f"{tmp_path}/{t}.parquet")
    got = queries.QUERIES["j15_blocked_pairs"](spark, str(tmp_path))
    assert most_rows(got) <= 3 * n
    assert tuple(got.first()) == (n * n, *(n * n * (n - 1) // 2,) * 2)


def odd_sides(spark, seed, lefts, rights):
    """Balances with ties, wide runs of equal scores, repeated keys, null, NaN and infinite numbers, null blocks."""
    r = random.Random(seed)
    number = lambda: r.choice([None, float("nan"), float("inf"), float("-inf"), 1e9, -1e300, 0.0, -0.0, 2.4, round(r.gauss(0, 9), 2), r.random(), *[round(r.uniform(-1000, 9999), 2)] * 9])
    side = lambda n, keys, c: spark.createDataFrame([(r.randrange(keys), r.choice([None, 1, 1, 1, 2, 3 if c == "left" else 4]), number()) for _ in range(n)], f"{c}_key long, block int, at double")
    return side(lefts, lefts, "left"), side(rights, rights, "right")


def all_pairs(left, right, digits):
    from pyspark.sql import functions as F

    return left.join(right.withColumnRenamed("at", "right_at"), "block").select("left_key", "right_key", F.round(closeness(F.abs(F.col("at") - F.col("right_at"))), digits).alias("score"))


def test_nearest_equals_ranking_all_pairs(spark, monkeypatch):
    from factloom.operators import nearest

    monkeypatch.setattr(nearest, "LEFT_OF_TASK", 40)
    for seed, lefts, rights, k, digits in ((1, 150, 400, 3, 6), (2, 150, 1500, 2, 6), (3, 100, 700, 1, 2), (4, 60, 5, 4, 6)):
        left, right = odd_sides(spark, seed, lefts, rights)
        want = sorted(map(str, map(tuple, identity.ranked_top(all_pairs(left, right, digits), k).collect())))
        got = nearest.nearest_top(left, right, k, closeness, digits)
        assert got.columns == ["left_key", "right_key", "score", "rank"]
        assert sorted(map(str, map(tuple, got.collect()))) == want


@pytest.mark.parametrize("name", ["w02_top_k", "a17_linkage_metrics", "i11_best_threshold"])
def test_a_large_block_makes_few_rows(spark, tmp_path, name):
    from factloom.plans import queries

    n = 2000
    spark.range(n).selectExpr("id as c_custkey", "1 as c_nationkey", "id * 37 % 8009 / 1.0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id as s_suppkey", "1 as s_nationkey", "id * 53 % 8009 / 1.0D as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    assert most_rows(queries.QUERIES[name](spark, str(tmp_path))) <= 10 * n


def test_linkage_scores_count_repeated_truth_once(spark):
    frame = lambda rows: spark.createDataFrame(rows, "left_key long, right_key long")
    given, truth = frame([(1, 1), (1, 2), (2, 1), (3, None), (3, 5)]), frame([(1, 2), (1, 2), (3, 5), (3, None)])
    assert tuple(identity.linkage_scores(given, truth).first()) == (0.4, 0.5, 0.444444)
    assert tuple(identity.linkage_scores(given.where("false"), truth).first()) == (0.0, 0.0, 0.0)


def test_score_counts_equal_all_pairs(spark, monkeypatch):
    """Also where scores are at a half (2.40 apart: 0.9765625), are too many for places, or fill several blocks."""
    from pyspark.sql import functions as F

    from factloom.operators import nearest

    monkeypatch.setattr(nearest, "PAIRS_OF_TASK", 20_000)
    for seed, digits, at_once, in_cache in ((5, 6, 1_000_000, 16_384), (6, 6, 500, 64), (7, 2, 500, 64), (8, 9, 1_000_000, 16_384)):
        monkeypatch.setattr(nearest, "AT_ONCE", at_once)
        monkeypatch.setattr(nearest, "IN_CACHE", in_cache)
        left, right = odd_sides(spark, seed, 200, 300)
        want = all_pairs(left, right, digits).groupBy("score").agg(F.count("*").alias("n"))
        got = nearest.score_counts(left, right, closeness, digits)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_threshold_of_counts_on_odd_balances(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.plans import queries

    left, right = odd_sides(spark, 9, 200, 100)
    left.selectExpr("left_key as c_custkey", "block as c_nationkey", "at as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    right.selectExpr("right_key as s_suppkey", "block as s_nationkey", "at as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = all_pairs(left, right, 6)
    want = identity.best_threshold(pairs, pairs.groupBy("left_key").agg(F.min("right_key").alias("right_key"))).first()
    assert tuple(queries.QUERIES["i11_best_threshold"](spark, str(tmp_path)).first()) == tuple(want)
