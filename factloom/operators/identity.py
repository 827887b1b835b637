"""Identity resolution as set operations: typed lookup, token-blocked candidates, policies, merges, linkage scores and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_name, overlap_coefficient, tokens

# Fixed values of the resolver.
FUZZY_THRESHOLD = 0.5
REVIEW_BUDGET = 5


def alias_tokens(names: DataFrame) -> DataFrame:
    """entity_id, alias (normalised), token: the blocking index."""
    alias = names.select("entity_id", normalize_name(F.col("surface")).alias("alias")).distinct()
    return alias.select("entity_id", "alias", F.explode(F.array_distinct(tokens(F.col("alias")))).alias("token"))


def token_candidates(queries: DataFrame, names: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """query_id, entity_id, score: best overlap of a query's tokens with an owner's aliases, at least the threshold.

    queries: query_id, name. Equal names are answered once, and equal aliases compared once, however many queries and owners
    have them. Lossless blocking, for a threshold above 0: of the smaller set's n tokens at least ceil(threshold * n) are shared, so
    one of its n - ceil(threshold * n) + 1 rarest is. Only these are looked up among all tokens of the larger set, so a
    token that nearly all names hold meets few others.
    """
    q = queries.select("query_id", normalize_name(F.col("name")).alias("query"))
    distinct = q.select("query").distinct()
    alias = names.select("entity_id", normalize_name(F.col("surface")).alias("alias")).distinct()
    forms = alias.select("alias").distinct()
    left = distinct.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    right = forms.select("alias", F.explode(F.array_distinct(tokens(F.col("alias")))).alias("token"))
    seen = right.groupBy("token").agg(F.count("*").alias("n"))
    left, right = _rare_first(left, "query", seen, threshold), _rare_first(right, "alias", seen, threshold)
    a = left.where("query_leads").join(right, "token").where("query_size <= alias_size")
    b = left.join(right.where("alias_leads"), "token").where("alias_size < query_size")
    pairs = a.select("query", "alias").union(b.select("query", "alias")).distinct()
    score = overlap_coefficient(tokens(F.col("query")), tokens(F.col("alias")))
    good = pairs.withColumn("score", score).where(F.col("score") >= threshold)
    best = good.join(alias, "alias").groupBy("query", "entity_id").agg(F.max("score").alias("score"))
    return q.join(best, "query").select("query_id", "entity_id", "score")


def _rare_first(sets: DataFrame, key: str, seen: DataFrame, threshold: float) -> DataFrame:
    """key, token, the set's size, and whether the token is among the rarest of which one must be shared. seen: token, n."""
    ranked = sets.join(seen, "token", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ts"))
    size = F.size("ts")
    ranked = ranked.withColumn("size", size).withColumn("lead", size - F.ceil(size * threshold - 1e-9) + 1)
    return ranked.select(key, F.col("size").alias(f"{key}_size"), "lead", F.posexplode("ts").alias("pos", "t")).select(key, "t.token", f"{key}_size", (F.col("pos") < F.col("lead")).alias(f"{key}_leads"))


def typed_lookup(queries: DataFrame, external: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """query_id, outcome (match, ambiguous, none), entity_id: by external id first, by alias if that finds nothing.

    queries: query_id, source, external_id, name, entity_type; external: entity_id, source, external_id; names: entity_id, surface;
    types: entity_id, entity_type.
    """
    owned = external.join(types, "entity_id")
    key = ["source", "external_id", "entity_type"]
    by_id = queries.join(owned, key).groupBy("query_id").agg(F.count_distinct("entity_id").alias("n1"), F.min("entity_id").alias("e1"))
    alias = names.join(types, "entity_id").select("entity_id", "entity_type", normalize_name(F.col("surface")).alias("alias")).distinct()
    by_name = queries.select("query_id", "entity_type", normalize_name(F.col("name")).alias("alias")).join(alias, ["alias", "entity_type"]).groupBy("query_id").agg(F.count_distinct("entity_id").alias("n2"), F.min("entity_id").alias("e2"))
    both = queries.select("query_id").join(by_id, "query_id", "left").join(by_name, "query_id", "left")
    n, e = F.coalesce("n1", "n2", F.lit(0)), F.when(F.col("n1").isNotNull(), F.col("e1")).otherwise(F.col("e2"))
    return both.select("query_id", F.when(n == 1, "match").when(n > 1, "ambiguous").otherwise("none").alias("outcome"), F.when(n == 1, e).alias("entity_id"))


def resolve(queries: DataFrame, records: DataFrame, external: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """query_id, decision (MATCH, CONFLICT, REVIEW, NEW), entity_id: record known before, then authoritative id, then candidates, else new.

    queries: query_id, source, record_id, external_id, name, entity_type. records: source, record_id, entity_id.
    The owners of an id are one row, of the least and the greatest, which differ if it has several; a name is looked up once. So no
    row of a query meets every owner of an id or a name that many share.
    """
    known = queries.join(records.select("source", "record_id", F.col("entity_id").alias("by_record")), ["source", "record_id"], "left").select("query_id", "by_record")
    key = ["source", "external_id", "entity_type"]
    owners = external.join(types, "entity_id").groupBy(*key).agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    ids = queries.join(owners, key).groupBy("query_id").agg(F.min("lo").alias("by_id"), F.max("hi").alias("hi"))
    found = token_candidates(queries.select(F.col("name").alias("query_id"), "name").distinct(), names).select(F.col("query_id").alias("name")).distinct()
    near = queries.select("query_id", "name").join(found, "name").select("query_id", F.lit(True).alias("near")).distinct()
    all_ = known.join(ids, "query_id", "left").join(near, "query_id", "left")
    clash = (F.col("by_record") != F.col("by_id")) | (F.col("by_id") != F.col("hi"))
    decision = F.when(clash, "CONFLICT").when(F.coalesce("by_record", "by_id").isNotNull(), "MATCH").when(F.col("near"), "REVIEW").otherwise("NEW")
    return all_.select("query_id", decision.alias("decision"), F.when(decision == "MATCH", F.coalesce("by_record", "by_id")).alias("entity_id"))


def merge_preview(merges: DataFrame, names: DataFrame, external: DataFrame) -> DataFrame:
    """survivor, duplicate, moved_aliases, moved_ids: what each merge would move."""
    count = lambda df, c: df.groupBy(F.col("entity_id").alias("duplicate")).agg(F.count("*").alias(c))
    out = merges.select("survivor", "duplicate").join(count(names, "moved_aliases"), "duplicate", "left").join(count(external, "moved_ids"), "duplicate", "left")
    return out.select("survivor", "duplicate", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("moved_aliases", "moved_ids")))


def split_outcome(splits: DataFrame, moved: DataFrame, owners: DataFrame, redirect: DataFrame) -> DataFrame:
    """survivor, duplicate, binding, outcome (restored, retained): what undoing each merge gives back to the duplicate.

    splits: survivor, duplicate; moved: duplicate, binding, as the merge recorded them (names, or source and id in one text);
    owners: entity_id, binding now; redirect: merges in force. A binding that the survivor still owns is restored; one that it lost
    is retained where it is. Splits of what is not merged into that survivor have no rows; `unsound_splits` names them.
    """
    sound = splits.select("survivor", "duplicate").join(redirect.select("survivor", "duplicate"), ["survivor", "duplicate"], "left_semi")
    held = owners.select(F.col("entity_id").alias("survivor"), "binding", F.lit(True).alias("held")).distinct()
    out = sound.join(moved.select("duplicate", "binding").distinct(), "duplicate").join(held, ["survivor", "binding"], "left")
    return out.select("survivor", "duplicate", "binding", F.when(F.col("held"), "restored").otherwise("retained").alias("outcome"))


def unsound_splits(splits: DataFrame, redirect: DataFrame) -> DataFrame:
    """survivor, duplicate of splits whose duplicate is not merged into that survivor."""
    return splits.select("survivor", "duplicate").join(redirect.select("survivor", "duplicate"), ["survivor", "duplicate"], "left_anti")


def owners_after_splits(owners: DataFrame, outcome: DataFrame) -> DataFrame:
    """entity_id, binding after the splits: restored bindings pass from the survivor to the duplicate."""
    moved = outcome.where("outcome = 'restored'")
    gone = moved.select(F.col("survivor").alias("entity_id"), "binding").distinct()
    return owners.select("entity_id", "binding").join(gone, ["entity_id", "binding"], "left_anti").union(moved.select(F.col("duplicate").alias("entity_id"), "binding")).distinct()


def entity_lookup(entities: DataFrame, ids: list[str], redirect: DataFrame) -> DataFrame:
    """The entities with one of the ids that were not merged away. redirect: duplicate, survivor."""
    return entities.where(F.col("entity_id").isin(ids)).join(redirect.select(F.col("duplicate").alias("entity_id")), "entity_id", "left_anti")


def merge_members(redirect: DataFrame) -> DataFrame:
    """entity_id, component: every entity of a merge with the survivor that its chain ends at. redirect: duplicate, survivor, followed to the end."""
    survivors = redirect.select(F.col("survivor").alias("entity_id"), F.col("survivor").alias("component")).distinct()
    return redirect.select(F.col("duplicate").alias("entity_id"), F.col("survivor").alias("component")).union(survivors)


def forbidden_merges(merges: DataFrame, cannot_link: DataFrame, members: DataFrame) -> DataFrame:
    """Merges whose two components hold a pair that must not be linked. members: entity_id, component; cannot_link: left_id, right_id."""
    m = members.select(F.col("entity_id").alias("e"), F.col("component").alias("c"))
    comp = lambda df, col, name: df.join(m, F.col(col) == F.col("e"), "left").withColumn(name, F.coalesce("c", col)).drop("e", "c")
    blocked = comp(comp(cannot_link, "left_id", "x"), "right_id", "y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    wanted = comp(comp(merges.select("survivor", "duplicate"), "survivor", "s"), "duplicate", "d").withColumn("x", F.least("s", "d")).withColumn("y", F.greatest("s", "d"))
    return wanted.join(blocked, ["x", "y"], "left_semi").select("survivor", "duplicate")


# -- linkage


def blocked_pairs(left: DataFrame, right: DataFrame, rules: list[tuple[str, str]], key: str = "row_key") -> DataFrame:
    """left_key, right_key of all pairs that agree on any rule (a left column and a right column); nulls never agree."""
    out = None
    for a, b in rules:
        one = left.select(F.col(key).alias("left_key"), F.col(a).alias("v")).join(right.select(F.col(key).alias("right_key"), F.col(b).alias("v")), "v").select("left_key", "right_key")
        out = one if out is None else out.union(one)
    return out.distinct()


def blocked_totals(left: DataFrame, right: DataFrame, rules: list[tuple[str, str]], key: str = "row_key") -> DataFrame:
    """One row of what `blocked_pairs` holds: pairs, left_sum, right_sum (of the keys; null without pairs). The pairs are not made.

    Each rule, and each set of rules that agree together, is two tables of counts by value, and the union of the rules is their
    inclusion and exclusion; there are 2 ** n - 1 such sets, so n is bounded by 8. A key with several different rows may agree by
    any of them, so the pairs of those keys are made; keys with one row need none.
    """
    if len(rules) > 8:
        raise ValueError("at most 8 rules are counted at once")
    vs = [f"v{i}" for i in range(len(rules))]
    sides = []
    for rows, side in ((left, 0), (right, 1)):
        rows = rows.select(F.col(key).alias("k"), *(F.col(rule[side]).alias(v) for rule, v in zip(rules, vs, strict=True))).distinct()
        keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.first(F.struct(*vs)).alias("row"))
        several = keys.where("n > 1").select(F.col("k").alias("k2"))
        sides.append((rows, keys.where("n = 1").select("k", "row.*"), rows.join(several, F.col("k").eqNullSafe(F.col("k2")), "left_semi")))
    (_, left_one, left_several), (right_all, right_one, right_several) = sides
    both = [(v, v) for v in vs]
    made = blocked_pairs(left_several, right_all, both, "k").union(blocked_pairs(left_one, right_several, both, "k"))
    out = made.agg(F.count("*").alias("pairs"), F.sum("left_key").alias("left_sum"), F.sum("right_key").alias("right_sum"))
    for chosen in range(1, 2 ** len(rules)):
        agree = [v for i, v in enumerate(vs) if chosen >> i & 1]
        sign = F.lit(1 if len(agree) % 2 else -1)
        counted = [one.groupBy(*agree).agg(F.count("*").alias(f"{c}n"), F.sum("k").alias(f"{c}s")) for one, c in ((left_one, "l"), (right_one, "r"))]
        sums = (F.sum(F.col(a) * F.col(b)) * sign for a, b in (("ln", "rn"), ("ls", "rn"), ("rs", "ln")))
        out = out.union(counted[0].join(counted[1], agree).agg(*sums))
    return out.agg(F.sum("pairs").alias("pairs"), F.sum("left_sum").alias("left_sum"), F.sum("right_sum").alias("right_sum"))


def match_weight(levels: list[tuple[Column, float, float]]) -> Column:
    """Fellegi-Sunter: log2(m/u) summed over comparisons; (agreement, m, u). A null comparison counts nothing."""
    out = F.lit(0.0)
    for agree, m, u in levels:
        out = out + F.when(agree, F.log2(F.lit(m / u))).when(~agree, F.log2(F.lit((1 - m) / (1 - u)))).otherwise(0.0)
    return out


def match_probability(weight: Column, prior: float) -> Column:
    odds = F.pow(F.lit(2.0), weight) * (prior / (1 - prior))
    return odds / (1 + odds)


def agreement_rates(pairs: DataFrame, comparisons: list[str]) -> dict[str, float]:
    """u of each comparison: the share of pairs that agree by chance, over pairs drawn without blocking. Nulls count nothing."""
    row = pairs.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in comparisons)).first()
    return {c: 0.0 if row[c] is None else row[c] for c in comparisons}


def fit_linkage(pairs: DataFrame, comparisons: list[str], u: dict[str, float] | None = None, prior: float = 0.1, rounds: int = 100, tolerance: float = 1e-6) -> tuple[float, dict[str, tuple[float, float]]]:
    """The prior and (m, u) of each comparison, fitted without labels by expectation maximisation.

    pairs: a boolean column a comparison, null where it says nothing. Pairs are first counted by pattern; there are 3 ** k at most, so
    k is bounded by 12, rounds run over the patterns alone, and the pairs are read once. u: rates that stay as given (see
    `agreement_rates`); else they are fitted too. m starts at 0.9, u at 0.1. Rates stay within 1e-6 of 0 and 1. No pairs raise.
    """
    if len(comparisons) > 12:
        raise ValueError("at most 12 comparisons are fitted at once")
    rows = [(tuple(r[c] for c in comparisons), r["pairs"]) for r in pairs.groupBy(*comparisons).agg(F.count("*").alias("pairs")).collect()]
    total = sum(n for _, n in rows)
    if not total:
        raise ValueError("there are no pairs to fit")
    inside = lambda x: min(1 - 1e-6, max(1e-6, x))
    k = range(len(comparisons))
    chance = [inside(u[c]) if u else 0.1 for c in comparisons]
    same = [0.9] * len(comparisons)
    for _ in range(rounds):
        weights = []
        for pattern, _n in rows:
            match, other = prior, 1 - prior
            for i in k:
                if pattern[i] is not None:
                    match *= same[i] if pattern[i] else 1 - same[i]
                    other *= chance[i] if pattern[i] else 1 - chance[i]
            weights.append(match / (match + other))
        before = (prior, *same, *chance)
        prior = inside(sum(w * n for w, (_, n) in zip(weights, rows, strict=True)) / total)

        def rate(i: int, of_match: bool) -> float:
            parts = [((w if of_match else 1 - w) * n, p[i]) for w, (p, n) in zip(weights, rows, strict=True) if p[i] is not None]
            mass = sum(x for x, _ in parts)
            return inside(sum(x for x, agrees in parts if agrees) / mass) if mass else 0.5

        same = [rate(i, True) for i in k]
        if not u:
            chance = [rate(i, False) for i in k]
        if max(abs(x - y) for x, y in zip(before, (prior, *same, *chance), strict=True)) < tolerance:
            break
    return prior, {c: (same[i], chance[i]) for i, c in enumerate(comparisons)}


def ranked_top(pairs: DataFrame, k: int = REVIEW_BUDGET, by: tuple[str, ...] = ("left_key",)) -> DataFrame:
    """Each left record's k best pairs, ties by right key. by: what is ranked apart. See `nearest.nearest_top` for scores of distances."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "right_key"))
    return pairs.withColumn("rank", nth).where(F.col("rank") <= k)


def linkage_scores(recommended: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall, f1 of pairs (left_key, right_key), rounded to 6 digits; 0 where nothing is to divide."""
    known = truth.select("left_key", "right_key").distinct().withColumn("known", F.lit(1))
    given = recommended.join(known, ["left_key", "right_key"], "left").agg(F.count("known").alias("hit"), F.count("*").alias("given"))
    both = given.crossJoin(truth.agg(F.count("*").alias("true")))  # one row each
    p, r = (F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col(c).cast("double")), F.lit(0.0)) for c in ("given", "true"))
    return both.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def best_threshold(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """threshold, f1 of the score at which keeping all pairs at or above it has the highest F1; ties: the higher threshold.

    Pairs are first summed up by score; see `best_of_counts`.
    """
    marked = scored.join(truth.withColumn("hit", F.lit(1)), ["left_key", "right_key"], "left").groupBy("score").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return best_of_counts(marked, truth)


def best_of_counts(marked: DataFrame, truth: DataFrame) -> DataFrame:
    """`best_threshold` of pairs that are counted: score, n, hits, one row a score.

    Scores are dealt to 256 ranges of about equal numbers; totals of the ranges above, and
    running totals within each range, make the running totals of all, so no task sees all scores.
    """
    bounds = marked.agg(F.percentile_approx("score", [i / 256 for i in range(1, 256)]).alias("bounds"))  # one row
    marked = marked.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda x: x <= F.col("score")))).drop("bounds")
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # over 256 rows at most
    totals = marked.groupBy("range").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    totals = totals.select("range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")))
    w = Window.partitionBy("range").orderBy(F.desc("score"))
    run = marked.join(F.broadcast(totals), "range").select("score", *((F.sum(c).over(w) + F.col(f"{c}_above")).alias(c) for c in ("n", "hits"))).crossJoin(truth.agg(F.count("*").alias("true")))
    return run.select(F.col("score").alias("threshold"), F.round(2 * F.col("hits") / (F.col("n") + F.col("true")), 6).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def unique_crosswalk(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, row_key, value where the key is unique on the left and has one value on the right."""
    once = left.groupBy(key).agg(F.count("*").alias("n"), F.min("row_key").alias("row_key")).where("n = 1").select(key, "row_key")
    one = right.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").select(key, value)
    return once.join(one, key)


def hard_negatives(rows: DataFrame, name: str, identifier: str, key: str = "row_key") -> DataFrame:
    """Unordered pairs of one name and different identifiers."""
    b = rows.select(F.col(key).alias("right_key"), F.col(name).alias("_n"), F.col(identifier).alias("_i"))
    pairs = rows.join(b, (F.col(name) == F.col("_n")) & (F.col(identifier) != F.col("_i")) & (F.col(key) < F.col("right_key")))
    return pairs.select(F.col(key).alias("left_key"), "right_key")


def seeded_sample(rows: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The k rows with the smallest seeded digests: the same at any partitioning."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)).limit(k)
