"""As-of, history, conflict, provenance and occupancy operators over assertions.

An assertion row has assertion_id, sequence, subject_id, predicate_iri, kind, object_value, valid_from, valid_until, status,
source_id, supersedes. Every operator is set-based: it answers for all subjects at once, and a point query is a filter on top,
which Catalyst pushes into the scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlaps, valid_at
from .closure import canonical


def instant(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")


def as_of(assertions: DataFrame, at, predicate: str | None = None, kind: str | None = None, redirect: DataFrame | None = None) -> DataFrame:
    """Asserted rows valid at the instant; subjects follow merges if redirects are given."""
    out = assertions.where((F.col("status") == "asserted") & valid_at(F.col("valid_from"), F.col("valid_until"), instant(at)))
    if predicate is not None:
        out = out.where(F.col("predicate_iri") == predicate)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out if redirect is None else canonical(out, "subject_id", redirect)


def as_of_join(probes: DataFrame, assertions: DataFrame, key: str = "subject_id", at: str = "at", width: str = "1 day") -> DataFrame:
    """Each probe (key, at) with the assertions of its subject valid at its time.

    A range join as an equi join on blocks of time (see `_dealt`), so a subject with a long history is spread over its blocks. An
    open end is cut off after the last probe, whose time is one aggregate of the probes.
    """
    bucket = _bucket(width)
    last = probes.agg(F.max(bucket(F.col(at))).alias("last"))
    live = assertions.where("status = 'asserted'").crossJoin(F.broadcast(last))  # one row
    end = F.least(F.coalesce(bucket(F.col("valid_until")), F.col("last")), F.col("last"))
    spread = _dealt(live, bucket(F.col("valid_from")), end).drop("last")
    placed = _placed(probes, bucket(F.col(at)), spread)
    return placed.join(spread, [key, "_level", "_block"]).where(valid_at(F.col("valid_from"), F.col("valid_until"), F.col(at))).drop("_level", "_block")


def _bucket(width: str):
    step = seconds_of(width)
    return lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / step)


def _dealt(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """rows once for each block of time that they are dealt to, with _level and _block; rows that end before they begin go.

    A block of level l is 2 ** l buckets. An interval of n buckets is dealt at the level whose blocks hold n, so it touches two
    blocks at most, however long it is, and fills a quarter of what it touches at least.
    """
    spans = rows.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    spans = spans.withColumn("_level", F.ceil(F.log2((F.col("_last") - F.col("_first") + 1).cast("double"))).cast("int"))
    return spans.withColumn("_block", F.explode(F.expr("sequence(shiftright(_first, _level), shiftright(_last, _level))"))).drop("_first", "_last")


def _placed(rows: DataFrame, bucket: Column, dealt: DataFrame) -> DataFrame:
    """rows once for each level that occurs in `dealt`, with the one block there that holds their bucket."""
    levels = dealt.agg(F.collect_set("_level").alias("_levels"))  # one row of a few dozen levels
    out = rows.withColumn("_bucket", bucket).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    return out.withColumn("_block", F.expr("shiftright(_bucket, _level)")).drop("_bucket", "_levels")


def seconds_of(width: str) -> int:
    """Seconds of "<n> day|hour|minute|second"."""
    n, unit = width.split()
    return int(n) * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit.rstrip("s")]


def resolve_location(valid: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """subject_id, status (none, unique, conflict), location (only if unique), n_values: no silent winner among conflicting places."""
    found = valid.groupBy("subject_id").agg(F.count_distinct("object_value").alias("n_values"), F.min("object_value").alias("low"))
    if subjects is not None:
        found = subjects.join(found, "subject_id", "left")
    n = F.coalesce("n_values", F.lit(0))
    status = F.when(n == 0, "none").when(n == 1, "unique").otherwise("conflict")
    return found.select("subject_id", status.alias("status"), F.when(n == 1, F.col("low")).alias("location"), n.cast("long").alias("n_values"))


def current_location(assertions: DataFrame, now) -> DataFrame:
    """subject_id, location: where subjects are now, by facts that have begun and not ended; those in conflict are left out."""
    return resolve_location(as_of(assertions, now)).where("status = 'unique'").select("subject_id", "location")


def location_values(valid: DataFrame) -> DataFrame:
    """subject_id, object_value, latest start, sorted distinct sources, sorted assertion ids, for every place that is claimed."""
    return valid.groupBy("subject_id", "object_value").agg(F.max("valid_from").alias("latest"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_list("assertion_id")), ",").alias("assertion_ids"))


def occupants(valid: DataFrame, place: int) -> DataFrame:
    """Subjects whose only valid place is this one."""
    return valid.groupBy("subject_id").agg(F.count_distinct("object_value").alias("n"), F.min("object_value").alias("low")).where((F.col("n") == 1) & (F.col("low") == place)).select("subject_id")


def occupancy(valid: DataFrame) -> DataFrame:
    """object_value, n: how many subjects are uniquely at each place."""
    return resolve_location(valid).where("status = 'unique'").groupBy(F.col("location").alias("object_value")).agg(F.count("*").alias("n"))


def contradictions(valid: DataFrame) -> DataFrame:
    """subject_id, predicate_iri, object_value, assertions, latest: every alternative where there are two or more."""
    alternatives = valid.groupBy("subject_id", "predicate_iri", "object_value").agg(F.count("*").alias("assertions"), F.max("valid_from").alias("latest"))
    n = F.count("*").over(Window.partitionBy("subject_id", "predicate_iri"))
    return alternatives.withColumn("alternatives", n).where("alternatives >= 2")


def overlapping_pairs(assertions: DataFrame, width: str = "1 day") -> DataFrame:
    """Unordered pairs of asserted rows of one subject and predicate that overlap and claim different objects.

    Of two rows that overlap, the later start lies within the earlier one. So the earlier row is dealt to blocks of time (see
    `_dealt`), its open end cut off after the last start, and the later one to the blocks of its start: rows meet only near in
    time, and each pair once. A subject with a long history is spread over its blocks.
    """
    bucket = _bucket(width)
    live = assertions.where("status = 'asserted'").select("assertion_id", "subject_id", "predicate_iri", "object_value", "valid_from", "valid_until")
    last = live.agg(F.max(bucket(F.col("valid_from"))).alias("last"))
    end = F.least(F.coalesce(bucket(F.col("valid_until")), F.col("last")), F.col("last"))
    early = _dealt(live.crossJoin(F.broadcast(last)), bucket(F.col("valid_from")), end).drop("last")  # one row
    late = _placed(live, bucket(F.col("valid_from")), early)
    late = late.select(*(F.col(c).alias(f"b_{c}") for c in live.columns), F.col("_level").alias("b_level"), F.col("_block").alias("b_block"))
    same = (F.col("subject_id") == F.col("b_subject_id")) & (F.col("predicate_iri") == F.col("b_predicate_iri")) & (F.col("_level") == F.col("b_level")) & (F.col("_block") == F.col("b_block")) & (F.col("object_value") != F.col("b_object_value"))
    order = (F.col("valid_from") < F.col("b_valid_from")) | ((F.col("valid_from") == F.col("b_valid_from")) & (F.col("assertion_id") < F.col("b_assertion_id")))
    pairs = early.join(late, same & order & overlaps(F.col("valid_from"), F.col("valid_until"), F.col("b_valid_from"), F.col("b_valid_until")))
    return pairs.select("subject_id", F.least("assertion_id", "b_assertion_id").alias("left_id"), F.greatest("assertion_id", "b_assertion_id").alias("right_id"))


def history(assertions: DataFrame, include_superseded: bool = False) -> DataFrame:
    return assertions if include_superseded else assertions.where("status <> 'superseded'")


def active_by_links(assertions: DataFrame) -> DataFrame:
    """Rows that no later row supersedes and that are not retracted: the second definition of active, by links and not by status."""
    gone = assertions.where("supersedes is not null").select(F.col("supersedes").alias("sequence")).distinct()
    return assertions.join(gone, "sequence", "left_anti").where("status <> 'retracted'")


def correction_status(assertions: DataFrame) -> DataFrame:
    """assertion_id, state (corrected, retracted, active), replacement: corrected wins over retracted."""
    later = assertions.where("supersedes is not null").groupBy(F.col("supersedes").alias("sequence")).agg(F.min("assertion_id").alias("replacement"))
    state = F.when(F.col("replacement").isNotNull(), "corrected").when(F.col("status") == "retracted", "retracted").otherwise("active")
    return assertions.join(later, "sequence", "left").select("assertion_id", state.alias("state"), "replacement")


def cross_source(assertions: DataFrame) -> DataFrame:
    """Subjects whose asserted rows come from more than one source."""
    return assertions.where("status = 'asserted'").groupBy("subject_id").agg(F.count_distinct("source_id").alias("sources")).where("sources > 1")


def tracks(observations: DataFrame) -> DataFrame:
    """A track's size, time span, sensors and positions."""
    return observations.groupBy("track_id").agg(F.count("*").alias("points"), F.min("at_time").alias("first_at"), F.max("at_time").alias("last_at"), F.count_distinct("sensor_id").alias("sensors"))


def link_references(references: DataFrame, names: DataFrame, owners: DataFrame, redirect: DataFrame | None = None) -> DataFrame:
    """reference_id, status (resolved, ambiguous, unresolved), owner (only if resolved).

    references: reference_id, surface (normalised), expected_type or null; names: entity_id, surface; owners: entity_id, entity_type.
    """
    held = names.join(owners.select("entity_id", "entity_type"), "entity_id")
    held = held if redirect is None else canonical(held, "entity_id", redirect)
    wanted = references.select("surface", "expected_type").distinct()
    match = (F.col("w.surface") == F.col("h.surface")) & (F.col("w.expected_type").isNull() | (F.col("w.expected_type") == F.col("h.entity_type")))
    hits = wanted.alias("w").join(held.alias("h"), match).groupBy("w.surface", "w.expected_type").agg(F.count_distinct("h.entity_id").alias("n"), F.min("h.entity_id").alias("owner"))
    hits = hits.select(F.col("surface").alias("s"), F.col("expected_type").alias("t"), "n", "owner")
    out = references.join(hits, (F.col("surface") == F.col("s")) & F.col("expected_type").eqNullSafe(F.col("t")), "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return out.select("reference_id", status.alias("status"), F.when(F.col("n") == 1, F.col("owner")).alias("owner"))
