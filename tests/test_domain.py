"""Fixtures with known answers: log, lake, projection, corrections, traversal, templates, sources, shapes, bounds."""

import os
import re
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions import paging, scalars as X
from factloom.operators import ask, closure, facts, identity, patterns, shapes, traverse
from factloom.sources import mappers, readers
from factloom.sources.lake import Lake, read_snapshot, write_snapshot
from factloom.sources.log import EVENT_SCHEMA, EventLog, LogConflict, gaps, upcast, with_columns
from factloom.streaming.projector import StreamingProjector, checkpoint_of, project


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())] if fields else [(1,)], list(fields) or ["x"]).select(column).first()[0]


# -- scalars


def test_scalars(spark):
    assert value(spark, X.normalize_surface(F.col("s")), s="  Vũng   TÀU-1 ") == "vũng tàu-1"
    assert value(spark, X.normalize_name(F.col("s")), s=" Vũng  TÀU-1, Ltd.") == "vũng tàu 1 ltd"
    assert value(spark, X.fold_text(F.col("s")), s="Vũng TÀU: a/b?") == "vung tau: a/b"
    assert value(spark, X.source_urn(F.col("s")), s="a b/c") == "urn:source:a%20b%2Fc" and value(spark, X.source_urn(F.col("s")), s="urn:x:y z") == "urn:x:y z"
    assert value(spark, X.valid_lei(F.col("s")), s="5493001KJTIIGC8Y1R12") and not value(spark, X.valid_lei(F.col("s")), s="5493001KJTIIGC8Y1R13") and not value(spark, X.valid_lei(F.col("s")), s="x")
    assert [value(spark, X.finite(F.col("s")), s=x) for x in ("1.5", "nan", "Infinity", "x", "")] == [1.5, None, None, None, None]
    assert [value(spark, X.canonical_decimal(F.col("s"), 90), s=x) for x in ("10.500", "-0.0", "91", "x", "7")] == ["10.5", "0", None, None, "7"]
    assert value(spark, X.point_iri(F.lit(-0.0), F.lit(105.25))) == "urn:geo:crs84:0.000000:105.250000"
    assert value(spark, X.damerau_levenshtein(F.col("a"), F.col("b")), a="martha", b="marhta") == 1
    assert [value(spark, X.nearest_rank(F.lit(n), 0.5)) for n in (1, 3, 5, 200)] == [1, 2, 2, 100]
    assert value(spark, X.span_matches(F.col("t"), F.lit(1), F.lit(3), F.lit("éc")), t="déck")
    assert value(spark, X.redact_secrets(F.col("s")), s='api_key="a b" x token: z') == "api_key=[redacted] x token: [redacted]"
    assert value(spark, X.overlap_coefficient(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("a"), F.lit("c")))) == 0.5


def test_bounds():
    assert paging.page_bounds() == (50, 0)
    for bad in ((0, 0), (101, 0), (True, 0), (10, 100_001), ("5", 0)):
        with pytest.raises(ValueError):
            paging.page_bounds(*bad)
    with pytest.raises(ValueError):
        paging.timeout_bound(9)
    with pytest.raises(ValueError):
        paging.aware(datetime(2026, 1, 1))


def test_page(spark):
    p = paging.page(spark.range(120), [F.col("id")], 50, 100)
    assert (len(p.items), p.total, p.has_more) == (20, 120, False) and paging.page(spark.range(120), [F.col("id")]).has_more


# -- log and lake

EVENTS = [(f"e{i}", "click" if i % 2 else "view", 6, datetime(2026, 3, 1 + i // 4, 1, i), f'{{"n": {i}}}') for i in range(6)]
COLUMNS = "event_id string, event_type string, schema_version int, occurred_at timestamp, payload string"


def test_log(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    first = log.commit(spark.createDataFrame(EVENTS[:3], COLUMNS), "k1", "f1")
    assert [r.sequence for r in first.orderBy("sequence").collect()] == [1, 2, 3]
    assert log.commit(spark.createDataFrame(EVENTS[3:], COLUMNS), "k1", "f1").count() == 3  # replayed, nothing added
    with pytest.raises(LogConflict):
        log.commit(spark.createDataFrame(EVENTS[3:], COLUMNS), "k1", "other")
    with pytest.raises(LogConflict):
        log.commit(spark.createDataFrame(EVENTS[2:], COLUMNS))
    log.commit(spark.createDataFrame(EVENTS[3:], COLUMNS))
    assert rows(log.read(4).select("event_id", "sequence")) == [("e4", 5), ("e5", 6)] and gaps(log.read()).count() == 0
    assert rows(gaps(log.read().where("sequence not in (1, 4)"))) == [(1, 2), (4, 5)]


def test_upcast(spark):
    old = [
        ("a", "LocationObserved", 1, datetime(2026, 1, 1), '{"source_id": "s1"}'),
        ("b", "DocumentRegistered", 5, datetime(2026, 1, 1), '{"source_ids": ["s1", "s2"], "text": "abc"}'),
        ("c", "AssertionMade", 6, datetime(2026, 1, 1), '{"predicate_iri": "urn:p", "evidence_quality": "direct"}'),
    ]
    got = {r.event_id: r for r in upcast(with_columns(spark.createDataFrame(old, COLUMNS), EVENT_SCHEMA)).collect()}
    assert (got["a"].upcast_type, got["a"].predicate_iri, got["a"].source_ids, got["a"].valid_at, got["a"].evidence_quality) == ("AssertionMade", "urn:kg:core#locatedAt", ["s1"], datetime(2026, 1, 1), "unknown")
    assert got["b"].content_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and got["b"].source_ids == ["s1", "s2"]
    assert (got["c"].evidence_quality, got["c"].schema_version, got["c"].valid_at) == ("direct", 6, None)
    with pytest.raises(PySparkException):
        upcast(with_columns(spark.createDataFrame([("d", "x", 7, None, "{}")], COLUMNS), EVENT_SCHEMA)).collect()


def lake_rows(spark):
    days = ["2026-03-01T00:00:0%dZ" % i for i in range(4)] + ["2026-03-02T00:00:0%dZ" % i for i in range(2)]
    return spark.createDataFrame([(f"e{i}", "view" if i % 2 else "click", 6, t, "{}", i + 1) for i, t in enumerate(days)], "event_id string, event_type string, schema_version int, occurred_at string, payload_json string, sequence bigint")


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"), max_rows=3)
    assert lake.sql("SELECT count(*) AS n FROM events").first().n == 0
    assert lake.append(lake_rows(spark)) == 6 and lake.append(lake_rows(spark)) == 0
    assert rows(lake.sql("SELECT event_date, count(*) AS n FROM events GROUP BY 1").select(F.col("event_date").cast("string"), "n")) == [("2026-03-01", 4), ("2026-03-02", 2)]
    plan = lake.sql("SELECT * FROM events WHERE event_date = DATE '2026-03-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert lake.verify().count() == 0
    files = lake.manifest().count()
    lake.compact()
    assert lake.read().count() == 6 and lake.manifest().count() <= files and lake.verify().count() == 0
    os.remove(re.sub("^file:/+", "/", lake.manifest().first().path))
    assert [r.problem for r in lake.verify().collect()] == ["missing"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "ref")
    write_snapshot(spark.createDataFrame([("Q1", ["a"])], "qid string, types array<string>"), root, "2026-01")
    write_snapshot(spark.createDataFrame([("Q2", ["b"])], "qid string, types array<string>"), root, "2026-02")
    assert read_snapshot(spark, root).first().qid == "Q2" and read_snapshot(spark, root, "2026-01").first().qid == "Q1"
    with pytest.raises(ValueError):
        write_snapshot(spark.createDataFrame([], "qid string"), root, "2026-03")


# -- projection

MADE = '{{"assertion_id": "{0}", "subject_id": "{1}", "predicate_iri": "urn:p", "object": {{"kind": "entity", "value": "{2}"}}, "valid_from": "2026-01-0{3}T00:00:00Z"{4}}}'
LOG = [
    ("EntityCreated", '{"entity_id": "a", "entity_type": "Platform", "name": "Alpha"}'),
    ("EntityCreated", '{"entity_id": "a", "entity_type": "Platform", "name": "Alias"}'),
    ("EntityCreated", '{"entity_id": "b", "entity_type": "Platform", "name": "Bravo"}'),
    ("AssertionMade", MADE.format("x1", "a", "l1", 1, "")),
    ("AssertionMade", MADE.format("x2", "a", "l2", 2, ', "supersedes": "x1"')),
    ("AssertionMade", MADE.format("x3", "b", "l3", 3, ', "supersedes": "x4"')),
    ("AssertionMade", MADE.format("x4", "b", "l4", 4, "")),
    ("AssertionSuperseded", '{"assertion_id": "x3", "reason": "wrong"}'),
    ("EntityMerged", '{"survivor_id": "a", "duplicate_id": "b"}'),
    ("EntityMerged", '{"survivor_id": "a", "duplicate_id": "c"}'),
    ("EntitySplit", '{"survivor_id": "a", "duplicate_id": "c"}'),
    ("TrackObserved", '{"track_id": "t", "entity_id": "a", "observation_ids": ["o1"]}'),
    ("TrackObserved", '{"track_id": "t", "entity_id": "a", "observation_ids": ["o1", "o2"]}'),
    ("Unheard", "{}"),
]


def log_frame(spark):
    return with_columns(spark.createDataFrame([(f"e{i}", t, 6, datetime(2026, 1, 1, 0, i), p, i + 1) for i, (t, p) in enumerate(LOG)], COLUMNS + ", sequence bigint"), EVENT_SCHEMA)


def check_tables(tables):
    assert rows(tables["entities"].select("entity_id", "name")) == [("a", "Alpha"), ("b", "Bravo")]
    # x3 names x4 before x4 is made, so x4 stays asserted
    assert rows(tables["assertions"].select("assertion_id", "subject_id", "status")) == [("x1", "a", "superseded"), ("x2", "a", "asserted"), ("x3", "a", "retracted"), ("x4", "a", "asserted")]
    assert rows(tables["redirects"]) == [("b", "a")]
    assert tables["tracks"].first().observation_ids == ["o1", "o2"]


def test_projection(spark):
    events = log_frame(spark)
    check_tables(project(events.union(events).orderBy(F.rand(1))))
    assert tuple(checkpoint_of(events.union(events)).first()) == (14, 13, 1)


def test_streaming_equals_batch(spark, tmp_path):
    events = log_frame(spark)
    source = str(tmp_path / "in")
    p = StreamingProjector(spark, source, str(tmp_path / "out"), EVENT_SCHEMA)
    events.where("sequence <= 6").write.parquet(source)
    p.run().awaitTermination()
    events.where("sequence > 4").write.mode("append").parquet(source)  # two events come twice
    p.run().awaitTermination()
    check_tables(p.tables())
    assert p._bronze().count() == 14


# -- facts, closures, traversal, identity


def test_closure_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert closure.closure(e).count() == 12 and rows(closure.cycle_nodes(e)) == [("a",), ("b",), ("c",)]
    with pytest.raises(ValueError):
        closure.closure(spark.range(20).selectExpr("id AS child", "id + 1 AS parent"), max_depth=5)
    with pytest.raises(ValueError):
        closure.redirects(spark.createDataFrame([("a", "b", 1), ("b", "a", 2)], "duplicate string, survivor string, sequence int"))


EDGES = [("a-b", "a", "b", 1), ("a-d", "a", "d", 2), ("b-c", "b", "c", 3), ("d-c", "d", "c", 4), ("c-a", "c", "a", 5), ("c-e", "c", "e", 6)]


def test_closure_from_one_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y")], "child string, parent string")
    pairs = lambda df: sorted((r.child, r.parent, r.depth) for r in df.collect())
    whole = pairs(closure.closure(e, reflexive=True))
    for side, at in (("child", 0), ("parent", 1)):
        assert pairs(closure.closure(e, reflexive=True, start=(side, "a"))) == [p for p in whole if p[at] == "a"]


def test_paths_of_no_step(spark):
    """p* holds for a node without such an edge; bound variables start the path."""
    g = spark.createDataFrame([("n1", "partOf", "r1"), ("o1", "at", "n1"), ("o2", "at", "r1"), ("o3", "at", "lone")], "s string, p string, o string")
    q = patterns.Query(["?loc partOf* ?region", "?org at ?loc"], {"org": "org", "region": "region"})
    want = {("o1", "n1"), ("o1", "r1"), ("o2", "r1"), ("o3", "lone")}
    assert {tuple(r) for r in patterns.run(g, q).collect()} == want
    for region in ("r1", "lone", "n1"):
        assert {tuple(r) for r in patterns.run(g, q, region=region).collect()} == {x for x in want if x[1] == region}
    fixed = patterns.Query(["?org at ?loc", "?loc partOf* r1"], {"org": "org"})
    assert sorted(r.org for r in patterns.run(g, fixed).collect()) == ["o1", "o2"]
    alone = patterns.Query(["?x partOf* ?y"], {"x": "x", "y": "y"})
    assert {tuple(r) for r in patterns.run(g, alone).collect()} == {(n, n) for n in ("n1", "r1", "o1", "o2", "o3", "lone")} | {("n1", "r1")}


def test_traversal_bounds(spark):
    edges = [(f"e{i:03}", "a", f"b{i}", 0) for i in range(30)] + [(f"f{i}-{j}", f"b{i}", f"c{i}-{j}", j) for i in range(30) for j in range(4)]
    frame, start = spark.createDataFrame(edges, "edge_id string, source string, target string, rank int"), spark.createDataFrame([("a",)], "start string")
    for max_edges, max_nodes, want, cut in ((2000, 500, 150, False), (50, 500, 50, True), (2000, 11, 70, True), (150, 31, 150, False)):
        got = traverse.hop_paths(frame, start, 2, max_edges=max_edges, max_nodes=max_nodes).collect()
        assert len(got) == want and all(r.truncated == cut for r in got)
    tied = spark.createDataFrame([("urn:a-very-long-common-prefix-b", "s", "x", 1), ("urn:a-very-long-common-prefix-a", "s", "x", 1), ("z", "x", "y", 1)], "edge_id string, source string, target string, rank int")
    two = [r for r in traverse.hop_paths(tied, spark.createDataFrame([("s",)], "start string"), 2).collect() if r.hops == 2]
    assert [r.edge_ids[0] for r in two] == ["urn:a-very-long-common-prefix-a"]


def test_lookup_and_components(spark):
    from factloom.operators import identity

    red = spark.createDataFrame([("b", "a"), ("c", "a")], "duplicate string, survivor string")
    ents = spark.createDataFrame([("a",), ("b",), ("d",)], "entity_id string")
    assert rows(identity.entity_lookup(ents, ["a", "b", "x"], red)) == [("a",)]
    assert rows(identity.merge_members(red)) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_traversal(spark):
    edges = spark.createDataFrame(EDGES, "edge_id string, source string, target string, rank int")
    start = spark.createDataFrame([("a",)], "start string")
    got = sorted((r.hops, tuple(r.nodes)) for r in traverse.hop_paths(edges, start, 3).collect())
    # c is expanded once, on its first path; both paths that reach it are returned
    assert got == [(1, ("a", "b")), (1, ("a", "d")), (2, ("a", "b", "c")), (2, ("a", "d", "c")), (3, ("a", "b", "c", "e"))]
    assert traverse.hop_paths(edges, start, 1, per_node=1).count() == 1
    with pytest.raises(ValueError):
        traverse.hop_paths(edges, start, 4)


def test_half_open_and_conflict(spark):
    a = spark.createDataFrame([("x1", "s", "p", "entity", 1, datetime(2026, 1, 1), datetime(2026, 1, 5), "asserted"), ("x2", "s", "p", "entity", 2, datetime(2026, 1, 5), None, "asserted"), ("x3", "s", "p", "entity", 3, datetime(2026, 1, 7), None, "asserted"), ("x4", "s", "p", "location", 4, datetime(2026, 1, 1), None, "retracted")], "assertion_id string, subject_id string, predicate_iri string, kind string, object_value int, valid_from timestamp_ntz, valid_until timestamp_ntz, status string")
    at = lambda t: sorted(r.assertion_id for r in facts.as_of(a, t, predicate="p", kind="entity").collect())
    assert at("2026-01-04 23:59:59") == ["x1"] and at("2026-01-05 00:00:00") == ["x2"] and at("2026-01-08") == ["x2", "x3"]
    assert rows(facts.overlapping_pairs(a)) == [("s", "x2", "x3")]
    assert facts.resolve_location(facts.as_of(a, "2026-01-08")).first().status == "conflict"


def test_identity_against_full_scan(spark):
    names = ["Coast Guard Region 4", "Coast  Guard", "Bộ Tư lệnh Cảnh sát biển", "Region 4 Command", "Maritime Headquarters", " guard ", "Coast-Guard, Region 7", "Region Region 7"]
    asked = ["coast guard", "Region 7", "cảnh sát biển", "HEADQUARTERS maritime office", "nothing here", "", "region"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, name string")
    n = spark.createDataFrame(list(enumerate(names)), "entity_id int, surface string")
    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.casefold())).split()
    want = []
    for i, a in enumerate(asked):
        for j, b in enumerate(names):
            x, y = set(norm(a)), norm(b)
            if x & set(y) and (s := len(x & set(y)) / min(len(x), len(y))) >= 0.5:
                want.append((i, j, s))
    assert rows(identity.token_candidates(q, n)) == sorted(want, key=str)


def test_references(spark):
    owners = spark.createDataFrame([("a", "Platform"), ("b", "Person"), ("c", "Platform")], "entity_id string, entity_type string")
    names = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("a", "two")], "entity_id string, surface string")
    refs = spark.createDataFrame([(1, "one", None), (2, "one", "Person"), (3, "two", None), (4, "three", None)], "reference_id int, surface string, expected_type string")
    assert rows(facts.link_references(refs, names, owners)) == [(1, "ambiguous", None), (2, "resolved", "b"), (3, "ambiguous", None), (4, "unresolved", None)]
    merged = spark.createDataFrame([("c", "a")], "duplicate string, survivor string")
    assert rows(facts.link_references(refs, names, owners, merged))[2] == (3, "resolved", "a")


def test_shapes(spark):
    declared = spark.createDataFrame([("urn:p", "A", "B", True), ("urn:q", "A", "B", False)], "predicate_iri string, domain string, range string, assertable boolean")
    a = spark.createDataFrame([("1", "urn:p", "A", "B"), ("2", "urn:q", "A", "B"), ("3", "urn:r", "A", "B"), ("4", "urn:p", "B", "B")], "assertion_id string, predicate_iri string, subject_type string, object_type string")
    assert [r.focus for r in shapes.unknown_predicates(a, declared).orderBy("focus").collect()] == ["2", "3", "4"]


# -- templates on a small graph with known answers

GRAPH = """ship core:name Patrol Vessel 03|ship core:alias PV-03|off core:name Officer 17|r7 core:name Region 7|r8 core:name Region 8|vt core:name Vung Tau|pq core:name Phu Quoc|dn core:name Da Nang
old core:describes ship|old core:hasObject vt|old core:validFrom 2026-08-01|old core:validUntil 2026-08-10|old core:hasSource ais
new core:describes ship|new core:hasObject pq|new core:validFrom 2026-08-01|new core:validUntil 2026-08-10|new core:hasSource report|new assertion:supersedes old
p2 core:describes ship|p2 core:hasObject vt|p2 core:validFrom 2026-08-10|p2 core:validUntil 2026-08-20|p2 core:hasSource ais
now core:describes ship|now core:hasObject dn|now core:validFrom 2026-08-20|now core:hasSource report|now core:hasSource radar
clash core:describes ship|clash core:hasObject pq|clash core:validFrom 2026-08-22|clash core:hasSource radar
gone core:describes ship|gone core:hasObject vt|gone core:validFrom 2026-09-01|gone core:hasSource ais|ev assertion:retracts gone
m1 core:describes off|m1 core:hasObject r7|m1 core:validFrom 2026-08-01|m1 core:validUntil 2026-08-15|m2 core:describes off|m2 core:hasObject r8|m2 core:validFrom 2026-08-15
ais core:name AIS feed|report core:name Operations report|radar core:name Surface radar
i1 identity:identifierScheme registry|i1 identity:identifierValue 42|i1 identity:identifies r7|i2 identity:identifierScheme directory|i2 identity:identifierValue 42|i2 identity:identifies r8
claim assertion:subjectReference ghost|ghost rdf:type identity:UnresolvedReference|ghost identity:referenceText Ghost Vessel
oa core:observes ship|oa core:atTime 2026-08-20T02|oa sensor:detectedBy s1|ob core:observes ship|ob core:atTime 2026-08-20T04|ob sensor:detectedBy s2|ob core:hasSource radar
ra track:resultOf oa|ra track:position vt|rb track:resultOf ob|rb track:position dn|ra track:measurement ma|ma track:measurementName speed|ma track:measurementValue 12.4|ma track:measurementUnit kn
s1 core:name AIS Receiver|s2 core:name Surface Radar|t track:hasTrackId TRK|t track:derivedFrom oa|t track:derivedFrom ob|t track:trackOf ship"""


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([tuple(x.split(" ", 2)) for line in GRAPH.split("\n") for x in line.split("|")], "s string, p string, o string").cache()


@pytest.mark.parametrize(
    ("name", "values", "bind", "want"),
    [
        ("q17_temporal_history", {}, {"entity": "ship"}, [("dn", "2026-08-20", None), ("pq", "2026-08-01", "2026-08-10"), ("pq", "2026-08-22", None), ("vt", "2026-08-10", "2026-08-20")]),
        ("q18_temporal_asof", {"at": "2026-08-10"}, {"entity": "ship"}, [("ship", "vt")]),
        ("q18_temporal_asof", {"at": "2026-08-05"}, {"entity": "ship"}, [("ship", "pq")]),
        ("q19_conflict_count", {"at": "2026-08-23"}, {"entity": "ship"}, [("ship", 2)]),
        ("q20_conflict_locations", {"at": "2026-08-23"}, {"entity": "ship"}, [("ship", "dn"), ("ship", "pq")]),
        ("q04_temporal_asof", {"at": "2026-08-05"}, {"entity": "ship"}, [("pq", "2026-08-01"), ("vt", "2026-08-01")]),
        ("q21_assertion_status", {}, {"a": "old"}, [("old", "corrected", "new")]),
        ("q21_assertion_status", {}, {"a": "gone"}, [("gone", "retracted", None)]),
        ("q21_assertion_status", {}, {"a": "now"}, [("now", "active", None)]),
        ("q22_provenance_sources", {}, {"a": "now"}, [("now", "Operations report"), ("now", "Surface radar")]),
        ("q24_source_fact_interval", {"start": "2026-08-01", "end": "2026-08-21"}, {"source": "ais"}, [("p2", "2026-08-10")]),
        ("q25_pending_identity", {}, {}, [("claim", "Ghost Vessel")]),
        ("q26_identifier_lookup", {}, {"scheme": "registry", "value": "42"}, [("Region 7",)]),
        ("q27_identifier_collisions", {}, {"value": "42"}, [("42", "directory", "registry")]),
        ("q29_measurement_value", {}, {"obs": "oa", "measure": "speed"}, [("oa", "12.4", "kn")]),
        ("q30_track_path", {}, {"track_id": "TRK"}, [("TRK", "2026-08-20T02", "Vung Tau"), ("TRK", "2026-08-20T04", "Da Nang")]),
        ("q31_sensor_provenance", {}, {"obs": "ob", "track_id": "none"}, [("Surface Radar",)]),
        ("q31_sensor_provenance", {}, {"obs": "none", "track_id": "TRK"}, [("AIS Receiver",), ("Surface Radar",)]),
        ("q33_observation_assertion_separation", {}, {"entity": "ship"}, [("2026-08-20T02", "Vung Tau"), ("2026-08-20T04", "Da Nang")]),
        ("q37_temporal_relationship", {}, {"entity": "off"}, [("r7", "2026-08-01", "2026-08-15"), ("r8", "2026-08-15", None)]),
    ],
)
def test_templates(graph, name, values, bind, want):
    assert rows(patterns.run(graph, patterns.template(name, **values), **bind)) == sorted(want, key=str)


def test_questions(graph):
    intents = [ask.Intent("q18_temporal_asof", ["where was", "ở đâu"], {"entity": "iri", "at": "instant"}), ask.Intent("q25_pending_identity", ["pending identities"]), ask.Intent("q36_track_provenance", ["where was"])]
    g = graph.union(graph.sparkSession.createDataFrame([("z", "core:describes", "urn:x:1"), ("z", "core:hasObject", "dn"), ("z", "core:validFrom", "2026-01-01")], "s string, p string, o string"))
    one = intents[:2]
    assert ask.ask(g, "Where was urn:x:1 on 2026-02-01?", one).rows[0].place == "dn"
    assert ask.ask(g, "urn:x:1 Ở ĐÂU 2025-12-31", one).rows == ()
    assert ask.ask(g, "Where was it?", one).missing == ("entity", "at")
    assert ask.ask(g, "Where was urn:x:1", intents).status == "ambiguous" and ask.ask(g, "Why?", intents).status == "unsupported"
    assert ask.ask(g, "anything", intents, select=lambda q, i: "q25_pending_identity").rows[0].reference_text == "Ghost Vessel"
    assert ask.ask(g, "pending identities", intents, select=lambda q, i: "DROP TABLE").status == "matched"


def test_fact_patterns(spark):
    text = "Patrol Boat 5 is stationed at Cam Ranh since 2026-08-01. Alpha Unit is part of Region 7 Command.\nĐội 3 đặt tại Đà Nẵng, nothing."
    got = ask.extract_facts(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.subject_name, r.object_kind, r.object_value, r.valid_from) for r in got) == [("Alpha Unit", "entity", "Region 7 Command", None), ("Patrol Boat 5", "location", "Cam Ranh", "2026-08-01T00:00:00Z"), ("Đội 3", "location", "Đà Nẵng", None)]
    assert all(text[r.span_start : r.span_end] == r.exact_text for r in got)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Cảnh sát biển Việt Nam đặt tại Đà Nẵng từ 2026-05-01. Vietnam Coast Guard is part of Bộ Quốc phòng Việt Nam. Bộ Quốc phòng Việt Nam có trụ sở tại Hà Nội.", [("Cảnh sát biển Việt Nam", "Đà Nẵng", "2026-05-01T00:00:00Z"), ("Bộ Quốc phòng Việt Nam", "Hà Nội", None), ("Vietnam Coast Guard", "Bộ Quốc phòng Việt Nam", None)]),
        ("Không có gì để trích xuất ở đây.", []),
        ("Ab part of Cd", []),  # subject of two letters
        ("Abc part of C", []),
        ("Abc PART  OF Cde, more", [("Abc", "Cde", None)]),
        ("Đơn vị X ĐẶT TẠI Huế", []),  # only English phrases in any case
        ("Unit 1 since 2026-01-02 is based at Hue", [("Unit 1 since 2026-01-02", "Hue", "2026-01-02T00:00:00Z")]),
        ("Unit 1 is based at Hue since 2026-01-02 with a band", [("Unit 1", "Hue since 2026-01-02 with a band", "2026-01-02T00:00:00Z")]),
        ("Unit 1 is based at Hue since 2026-01-02T03:04:05Z", [("Unit 1", "Hue", "2026-01-02T03:04:05Z")]),
        ("his part of it is part of all that", [("his", "it is part of all that", None)]),
        ("Xyz is part of " + "w" * 90, [("Xyz", "w" * 80, None)]),
        ("v" * 90 + " thuộc Vùng 1", [("v" * 80, "Vùng 1", None)]),
    ],
)
def test_facts_of(text, want):
    got = list(ask.facts_of(text))
    assert [(g[0], g[3], g[4]) for g in got] == want
    assert all(text[g[6] : g[7]] == g[8] for g in got)


def test_slots():
    assert ask.iris("Is <urn:a:1>, or (http://x.org/a?b) 'https://y' http:// there") == ["urn:a:1", "http://x.org/a?b)", "https://y"]
    assert ask.instants("on 2026-01-02, 2026-01-02T03:04, 2026-01-02 03:04:05.6Z or 2026-01-02T03:04+07:00 not 12026-01-02 nor 2026-01-023") == ["2026-01-02", "2026-01-02T03:04", "2026-01-02 03:04:05.6Z", "2026-01-02T03:04+07:00"]


# -- sources

BOX = mappers.Bounds("box", 0, 98, 25, 122)


def test_feed_and_mappers(spark):
    line = '{"mmsi": "567890123", "name": "A", "sensor_id": "s", "track_id": "T", "position_uri": "urn:l", "at_time": "2026-08-20T03:00:00Z"}'
    assert mappers.feed(spark.createDataFrame([(line,)], "value string")).first().at_time == datetime(2026, 8, 20, 3)
    for bad in (line.replace('"A"', '" "'), line.replace('"mmsi"', '"x"'), "no json"):
        with pytest.raises(PySparkException):
            mappers.feed(spark.createDataFrame([(bad,)], "value string")).collect()
    with pytest.raises(ValueError):
        mappers.Bounds("x", 10, 0, 5, 1)
    with pytest.raises(PySparkException):
        mappers.gdelt(spark.createDataFrame([("1\t20260101",)], "value string"), BOX).collect()
    osm = '{"elements": [{"type": "node", "id": 1, "lat": 10, "lon": 105, "tags": {"name": "Port"}}, {"type": "way", "id": 2, "center": {"lat": 11, "lon": 106}}, {"type": "area", "id": 3, "lat": 1, "lon": 100}, {"type": "node", "id": 4, "lat": 50, "lon": 5}]}'
    assert rows(mappers.overpass(spark.createDataFrame([(osm,)], "body string"), BOX)) == [("node/1", 10.0, 105.0, "Port"), ("way/2", 11.0, 106.0, None)]
    fish = '{"entries": [{"id": "f", "type": "fishing", "start": "2026-01-01T00:00:00Z", "end": "2026-01-02T00:00:00Z", "position": {"lat": 5, "lon": 110}, "vessel": {"name": "V"}}]}'
    assert mappers.fishing(spark.createDataFrame([(fish,)], "body string"), BOX).first().vessel == "V"
    alert = '{"features": [{"geometry": {"coordinates": [110, 5]}, "properties": {"eventtype": "TC", "eventid": "7", "episodeid": "2", "alertlevel": "Red", "name": "n"}}]}'
    assert mappers.gdacs(spark.createDataFrame([(alert,)], "body string"), BOX).first().record_id == "TC:7:2"
    wd = '{"id": "Q1", "labels": {"en": "Navy", "vi": " "}, "aliases": ["N", "N"], "classes": ["Q9", "Q5"], "lei": null}'
    assert tuple(mappers.wikidata(spark.createDataFrame([(wd,), (wd.replace("Q5", "Q6"),)], "body string"), {"Q5": "Organization"}).first()) == ("Q1", "Navy", ["N"], "Organization", None)
    legal = '{"lei": "5493001KJTIIGC8Y1R12", "legal_name": " A ", "country": "VN"}'
    assert rows(mappers.gleif(spark.createDataFrame([(legal,), (legal.replace("R12", "R13"),)], "body string"))) == [("5493001KJTIIGC8Y1R12", "A", "VN")]


def test_readers(spark, tmp_path):
    raw = spark.createDataFrame([('{"data": {"items": [{"a": 1}, {"a": 2}]}}',), ("broken",)], "body string")
    assert [(r.ordinal, r.record) for r in readers.json_records(raw, "$.data.items").collect()] == [(0, '{"a":1}'), (1, '{"a":2}')]
    csv = spark.createDataFrame([("a,b\n1,x\r\n2,y\n",)], "body string")
    assert rows(readers.csv_records(csv, "a int, b string").select("a", "b")) == [(1, "x"), (2, "y")]
    rss = spark.createDataFrame([("<rss><item><title><![CDATA[One]]></title><link>http://a</link><pubDate>d</pubDate></item><entry><title>Two</title><link href='http://b'/><updated>e</updated></entry></rss>",)], "body string")
    assert [(r.title, r.link, r.published) for r in readers.feed_records(rss).collect()] == [("One", "http://a", "d"), ("Two", "http://b", "e")]
    page = '<html lang="vi"><head><title>T</title><meta property="og:title" content="Open"><link rel="canonical" href="http://c"></head>'
    assert tuple(readers.html_metadata(spark.createDataFrame([(page,)], "html string")).first())[1:] == ("Open", None, "http://c", "vi")
    for n in ("x", "y"):
        (tmp_path / n).write_bytes(b"same")
    assert readers.archive(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        readers.source_contracts('{"schema_version": 1, "sources": [{"id": "a"}]}')


def test_paged_source(spark):
    class Pages(readers.PagedSource):
        @staticmethod
        def fetch(page):
            return [(f"r{page}-{i}", "{}") for i in range(2)]

    spark.dataSource.register(Pages)
    assert rows(spark.read.format("factloom_pages").option("pages", 3).load().select("page", "record_id"))[-1] == (2, "r2-1")


def test_long_and_open_intervals_meet_by_levels(spark):
    """As-of joins and overlaps against all pairs, with intervals from minutes to centuries, open ones, and times before 1970."""
    import random
    from datetime import datetime, timedelta

    r = random.Random(5)
    start = datetime(1960, 1, 1)
    data = []
    for i in range(150):
        a = start + timedelta(minutes=r.randrange(60 * 24 * 365 * 30))
        b = r.choice([None, a, a + timedelta(minutes=r.randrange(1, 2000)), a + timedelta(days=r.randrange(1, 40_000))])
        data.append((f"x{i:03}", i, f"s{i % 4}", "p", f"o{i % 3}", a, b, "asserted"))
    a = spark.createDataFrame(data, "assertion_id string, sequence long, subject_id string, predicate_iri string, object_value string, valid_from timestamp_ntz, valid_until timestamp_ntz, status string")
    probes = [(f"s{i % 4}", start + timedelta(minutes=r.randrange(60 * 24 * 365 * 40)), i) for i in range(100)] + [("s1", None, 100)]
    p = spark.createDataFrame(probes, "subject_id string, at timestamp_ntz, n long")
    holds = lambda d, t: t is not None and d[5] <= t and (d[6] is None or t < d[6])
    want = sorted((n, d[0]) for s, t, n in probes for d in data if d[2] == s and holds(d, t))
    assert sorted(map(tuple, facts.as_of_join(p, a).select("n", "assertion_id").collect())) == want
    live = [d for d in data if d[6] is None or d[5] < d[6]]
    meet = lambda x, y: (y[6] is None or x[5] < y[6]) and (x[6] is None or y[5] < x[6])
    want = sorted((x[2], x[0], y[0]) for x in live for y in live if x[0] < y[0] and x[2] == y[2] and x[4] != y[4] and meet(x, y))
    got = sorted(map(tuple, facts.overlapping_pairs(a.where("valid_until is null or valid_from < valid_until")).collect()))
    assert got == want and len(got) > 100


def test_thresholds_by_ranges(spark):
    import random

    r = random.Random(2)
    data = [(i, i, round(r.random(), 3)) for i in range(3000)]
    truth = {i for i, _, s in data if r.random() < s}
    best = max((round(2 * sum(1 for i, _, x in data if x >= t and i in truth) / (sum(1 for d in data if d[2] >= t) + len(truth)), 6), t) for t in {d[2] for d in data})
    got = identity.best_threshold(spark.createDataFrame(data, "left_key long, right_key long, score double"), spark.createDataFrame([(i, i) for i in truth], "left_key long, right_key long")).first()
    assert (got["f1"], got["threshold"]) == best


def test_linkage_is_fitted_without_labels(spark):
    import random

    r = random.Random(3)
    data = []
    for _ in range(20_000):
        match = r.random() < 0.2
        data.append(tuple(None if r.random() < 0.05 else r.random() < (m if match else u) for m, u in ((0.95, 0.05), (0.9, 0.2), (0.8, 0.1))))
    pairs = spark.createDataFrame(data, "a boolean, b boolean, c boolean")
    prior, rates = identity.fit_linkage(pairs, ["a", "b", "c"])
    assert abs(prior - 0.2) < 0.02
    for c, (m, u) in zip("abc", ((0.95, 0.05), (0.9, 0.2), (0.8, 0.1)), strict=True):
        assert abs(rates[c][0] - m) < 0.03 and abs(rates[c][1] - u) < 0.03
    prior, rates = identity.fit_linkage(pairs, ["a", "b", "c"], identity.agreement_rates(pairs, ["a", "b", "c"]))
    assert 0 < prior < 1
    with pytest.raises(ValueError):
        identity.fit_linkage(pairs.where("false"), ["a"])


def test_splits(spark):
    merged = spark.createDataFrame([("d", "s"), ("e", "s")], "duplicate string, survivor string")
    moved = spark.createDataFrame([("d", "n1"), ("d", "n1"), ("d", "n2"), ("e", "n3")], "duplicate string, binding string")
    owners = spark.createDataFrame([("s", "n1"), ("z", "n2"), ("s", "n3"), ("z", "n1")], "entity_id string, binding string")
    wanted = spark.createDataFrame([("s", "d"), ("s", "q")], "survivor string, duplicate string")
    out = identity.split_outcome(wanted, moved, owners, merged)
    assert rows(out) == [("s", "d", "n1", "restored"), ("s", "d", "n2", "retained")]
    assert rows(identity.unsound_splits(wanted, merged)) == [("s", "q")]
    assert rows(identity.owners_after_splits(owners, out)) == [("d", "n1"), ("s", "n3"), ("z", "n1"), ("z", "n2")]


def test_connector(spark, tmp_path):
    from factloom.sources.connector import CheckpointStore, Page, RawArchive, fingerprint, run_page

    archive, store, seen = RawArchive(spark, f"{tmp_path}/raw"), CheckpointStore(spark, f"{tmp_path}/checkpoints"), []
    pages = {None: ([("a", "x"), ("b", "x")], "2"), "2": ([("c", None)], None)}

    def fetch(cursor):
        data, after = pages[cursor]
        return Page(spark.createDataFrame(data, "record_id string, body string"), after, after is None)

    def run(config, fetch=fetch, handle=lambda df: seen.extend(r.record_id for r in df.collect())):
        return run_page("src", fetch, lambda df: df, handle, archive, store, config)

    one = fingerprint({"q": 1}, "r", "1")
    first = run(one)
    assert (first.cursor, first.complete, first.raw_records) == ("2", False, 2)

    def broken(df):
        raise OSError

    with pytest.raises(OSError):
        run(one, handle=broken)
    assert store.load("src") == first  # the page is read again
    with pytest.raises(ValueError, match="changed"):
        run(fingerprint({"q": 2}, "r", "1"))
    with pytest.raises(ValueError, match="empty"):
        run(one, fetch=lambda c: Page(spark.createDataFrame([], "record_id string, body string"), None, True))
    with pytest.raises(ValueError, match="go on"):
        run(one, fetch=lambda c: Page(fetch(c).records, "2", False))
    last = run(one)
    assert (last.complete, last.raw_records, last.mapped_records) == (True, 3, 3) and run(one) is None
    assert sorted(seen) == ["a", "b", "c"] and archive.bodies().count() == 2 and archive.manifest().count() == 3 and archive.altered().isEmpty()
    with pytest.raises(ValueError):
        fingerprint({}, "r", " ")


def test_encyclopedia_claims(spark):
    from factloom.sources.mappers import encyclopedia, subsidiary_claims

    texts = [
        "Foo is a wholly owned subsidiary of the Bar Group, formed in 1990. It is an indirect subsidiary of Baz",
        "Nothing here.\n\nFoo is a subsidiary of Bar.",
        "Đại Việt is a state-owned subsidiary of Công ty Á since 2001. Foo is a subsidiary of Bar that was sold.",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(c.subject, c.object, texts[r.i][c.start : c.end]) for c in r.c or ()] for r in df.select("i", subsidiary_claims(F.col("t"), F.lit("Title")).alias("c")).collect()}
    assert got == {
        0: [("Foo", "Bar Group", "Foo is a wholly owned subsidiary of the Bar Group, formed in 1990"), ("Title", "Baz", "It is an indirect subsidiary of Baz")],
        1: [],
        2: [("Đại Việt", "Công ty Á", "Đại Việt is a state-owned subsidiary of Công ty Á since 2001"), ("Foo", "Bar", "Foo is a subsidiary of Bar that was sold")],
        3: [],
        4: [],
    }
    with pytest.raises(Exception, match="lacks"):
        encyclopedia(spark.createDataFrame([("1", "u", '{"query": {"pages": [{"title": "x", "missing": true}]}}')], "record_id string, source_uri string, body string")).collect()


def test_triples_that_are_none_are_refused(spark, tmp_path):
    from factloom.sources.rdf import read_ntriples

    (tmp_path / "a.nt").write_text('# c\n\n<a> <b> "x \\" . y"@en .\n_:n <b> <c> <g> .\n<a> <b> "1"^^<t> . # c\n')
    assert rows(read_ntriples(spark, str(tmp_path / "a.nt"))) == [("<a>", "<b>", '"1"^^<t>'), ("<a>", "<b>", '"x \\" . y"@en'), ("_:n", "<b>", "<c>")]
    (tmp_path / "b.nt").write_text("<a> <b> .\n")
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(tmp_path / "b.nt")).collect()
