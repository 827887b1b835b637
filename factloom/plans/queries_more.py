"""Further registered queries: projection of a log, gates, consolidation, governance, the remaining scalars and mappers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paging, scalars as X
from ..operators import facts, gates, identity, shapes
from ..operators.closure import shared_dir
from ..sources import mappers, rdf
from ..sources.connector import CheckpointStore, Page, RawArchive, Snapshots, fingerprint, run_page
from ..sources.lake import Lake, read_snapshot, write_snapshot
from ..sources.log import EVENT_SCHEMA, EventLog, with_columns
from ..streaming.projector import StreamingProjector, checkpoint_of, once, project, unknown_retractions
from . import testmap as M
from .queries import _LAT, _LON, SCS, _coords, register

# -- the projection of an event log made from the table of events


def event_log(s, d):
    """Every event makes an assertion; an error is retracted right after; a signup supersedes the user's last assertion."""
    a = M.assertions(s, d)
    sid = F.concat(F.lit("urn:assert:"), F.col("supersedes").cast("string"))
    at = F.col("valid_from").cast("timestamp")
    made = F.to_json(F.struct("assertion_id", F.col("subject_id").cast("string").alias("subject_id"), "predicate_iri", F.struct("kind", F.col("object_value").cast("string").alias("value")).alias("object"), F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_from"), sid.alias("supersedes")))
    one = a.select(F.concat(F.lit("m"), F.col("sequence").cast("string")).alias("event_id"), F.lit("AssertionMade").alias("event_type"), at.alias("occurred_at"), made.alias("payload"), (F.col("sequence") * 2).alias("sequence"))
    two = a.where("source_id = 'error'").select(F.concat(F.lit("r"), F.col("sequence").cast("string")), F.lit("AssertionSuperseded"), at, F.to_json(F.struct("assertion_id", F.lit("error").alias("reason"))), F.col("sequence") * 2 + 1)
    return one.union(two)


_STATE = "CASE WHEN lead(event_type) OVER w = 'signup' THEN 'superseded' WHEN event_type = 'error' THEN 'retracted' ELSE 'asserted' END"


@register("t01_projection", f"SELECT 'urn:assert:' || event_id AS assertion_id, user_id::VARCHAR AS subject_id, json_extract_string(props, '$.k') AS object_value, CASE WHEN st = 'superseded' AND nxt < event_id THEN 'x' ELSE st END AS status FROM (SELECT *, {_STATE} AS st, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def _t01(s, d):
    return project(event_log(s, d))["assertions"].select("assertion_id", "subject_id", "object_value", "status")


@register("t02_idempotent_replay", "SELECT count(*) AS n, count(*) FILTER (kind = 'r') AS retractions FROM (SELECT 'm' AS kind FROM events UNION ALL SELECT 'r' FROM events WHERE event_type = 'error')")
def _t02(s, d):
    log = event_log(s, d)
    return once(log.union(log)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "AssertionSuperseded").alias("retractions"))


@register("t03_checkpoint", "SELECT (SELECT max(event_id * 2 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) FROM events) AS last_sequence, count(*) + count(*) FILTER (event_type = 'error') AS applied, CAST(0 AS BIGINT) AS unknown FROM events")
def _t03(s, d):
    return checkpoint_of(event_log(s, d))


# -- log, lake and kept tables: written to the shared folder, and read back


def _place(s, name):
    return f"{shared_dir(s)}/factloom/{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _log_rows(s, d):
    e = M.load(s, d, "events")
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("source_id")))
    kind = F.when(F.col("event_type") == "signup", "LocationObserved").otherwise("AssertionMade")
    return e.select(F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(4).alias("schema_version"), F.col("ts").cast("timestamp").alias("occurred_at"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("valid_at"))


@register("s03_log_append", "SELECT event_id, row_number() OVER (ORDER BY half, ts, CAST(event_id AS VARCHAR)) AS sequence FROM (SELECT event_id, ts, event_id % 2 AS half FROM events)")
def _s03(s, d):
    log, e = EventLog(s, _place(s, "log"), 50_000), _log_rows(s, d)
    log.commit(e.where("schema_version = 2"), "even", "f")
    log.commit(e.where("schema_version = 2"), "even", "f")  # a replay adds nothing
    log.commit(e.where("schema_version = 4"))
    return log.read().select(F.col("event_id").cast("long").alias("event_id"), "sequence")


@register("s01_log_scan", "SELECT event_id, 6 AS schema_version, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'AssertionMade' WHEN event_type = 'signup' THEN 'LocationObserved' ELSE 'AssertionMade' END AS upcast_type, CASE WHEN event_id % 2 = 0 THEN event_type END AS source FROM events")
def _s01(s, d):
    log = EventLog(s, _place(s, "log"))
    log.commit(_log_rows(s, d))
    return log.scan().select(F.col("event_id").cast("long").alias("event_id"), "schema_version", "upcast_type", F.get("source_ids", F.lit(0)).alias("source"))


def _lake_rows(s, d):
    return _log_rows(s, d).select("event_id", "event_type", F.col("schema_version").cast("tinyint").alias("schema_version"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.col("payload").alias("payload_json"), F.col("event_id").cast("long").alias("sequence"))


def _lake(s, d):
    lake, rows = Lake(s, _place(s, "lake")), _lake_rows(s, d)
    lake.append(rows.where("sequence % 3 = 0"))
    lake.append(rows.where("sequence % 3 <> 1"))  # a third of the rows is known already
    return lake


@register("s08_lake_write", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 3 <> 1")
def _s08(s, d):
    return _lake(s, d).read().select(F.col("event_id").cast("long").alias("event_id"), F.col("event_date").cast("string").alias("day"))


@register("s10_compaction", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(1 AS BIGINT) AS files, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY 1")
def _s10(s, d):
    lake = _lake(s, d)
    lake.compact()
    if not lake.verify().isEmpty() or lake.compact():
        raise RuntimeError("the lake does not agree with its manifest")
    day = F.substring("min_occurred_at", 1, 10)
    return lake.manifest().groupBy(day.alias("day")).agg(F.count("*").alias("files"), F.sum("rows").alias("n"))


@register("s13_lake_sql", "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'signup' THEN 'LocationObserved' ELSE 'AssertionMade' END AS event_type, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY 1, 2")
def _s13(s, d):
    return _lake(s, d).sql("SELECT CAST(event_date AS STRING) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")


@register("s14_snapshot", "SELECT n_nationkey, n_name FROM nation")
def _s14(s, d):
    place, n = _place(s, "snapshots"), M.load(s, d, "nation").select("n_nationkey", "n_name")
    write_snapshot(n.limit(3), place, "2026-01-01")
    write_snapshot(n, place, "2026-02-01")
    return read_snapshot(s, place)


@register("t05_gold_tables", f"SELECT 'urn:assert:' || event_id AS assertion_id, user_id::VARCHAR AS subject_id, json_extract_string(props, '$.k') AS object_value, CASE WHEN st = 'superseded' AND nxt < event_id THEN 'x' ELSE st END AS status FROM (SELECT *, {_STATE} AS st, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def _t05(s, d):
    """The kept tables after two micro-batches, of which the second repeats some events and changes rows of the first."""
    place, log = _place(s, "stream"), with_columns(event_log(s, d), EVENT_SCHEMA)
    p = StreamingProjector(s, f"{place}/in", f"{place}/out", EVENT_SCHEMA)
    log.where("sequence % 7 < 4").write.parquet(f"{place}/in")
    p.run().awaitTermination()
    log.where("sequence % 7 >= 3").write.mode("append").parquet(f"{place}/in")
    p.run().awaitTermination()
    return p.tables()["assertions"].select("assertion_id", "subject_id", "object_value", "status")


@register("t10_unknown_retractions", "SELECT 'r' || event_id AS event_id FROM events WHERE event_type = 'error' AND event_id % 5 = 0")
def _t10(s, d):
    log = event_log(s, d).where("event_type <> 'AssertionMade' or sequence % 10 <> 0")  # of every fifth assertion the making is lost
    return unknown_retractions(log).select("event_id")


# -- gates, consolidation, governance


@register("g01_entity_gate", "SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'type' WHEN c_acctbal < 0 THEN 'name' WHEN c_nationkey = 3 THEN 'id' END AS reject_reason FROM customer")
def _g01(s, d):
    c = M.load(s, d, "customer")
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Person").otherwise("Alien")
    rows = c.select("c_custkey", kind.alias("entity_type"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") == 3, "no iri").otherwise("urn:x").alias("entity_id"))
    return gates.gate_entities(rows).select("c_custkey", "reject_reason")


@register("g02_assertion_gate", "SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN score NOT BETWEEN 0 AND 50 THEN 'score' WHEN source_id = 'view' THEN 'quality' WHEN valid_until IS NOT NULL AND valid_until <= valid_from THEN 'interval' WHEN source_id = 'click' THEN 'source' END AS reject_reason FROM assertions) GROUP BY 1", "assertions")
def _g02(s, d):
    a = M.assertions(s, d).withColumn("model_score", F.col("score") / 50).withColumn("evidence_quality", F.when(F.col("source_id") == "view", "secondary").otherwise("direct"))
    return gates.gate_assertions(a.withColumn("source_ids", F.when(F.col("source_id") == "click", F.array().cast("array<string>")).otherwise(F.array("source_id")))).groupBy("reject_reason").agg(F.count("*").alias("n"))


@register("s31_consolidation", "SELECT event_id, log, coalesce(CASE WHEN entity_id % 10 = 3 THEN entity_id - 1 END, entity_id) AS entity_id FROM (SELECT e.*, row_number() OVER (PARTITION BY e.event_id ORDER BY log_first, e.log, sequence) AS r FROM (SELECT event_type AS log, event_id % 500 AS event_id, ts AS occurred_at, event_id AS sequence, user_id AS entity_id FROM events) e JOIN (SELECT event_type AS log, min(ts) AS log_first FROM events GROUP BY 1) f USING (log)) WHERE r = 1")
def _s31(s, d):
    e = M.load(s, d, "events").select(F.col("event_type").alias("log"), (F.col("event_id") % 500).alias("event_id"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("sequence"), F.col("user_id").alias("entity_id"))
    ids = M.load(s, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 1).alias("new_id"))
    users = M.load(s, d, "events").select(F.col("user_id").alias("old_id")).distinct().where("old_id % 10 = 3").select("old_id", (F.col("old_id") - 1).alias("new_id"))
    return gates.consolidate(e, ids.union(users).distinct()).select("event_id", "log", "entity_id")


@register("k02_layer_rule", "WITH n AS (SELECT count(*) AS n FROM supplier), u AS (SELECT s_suppkey AS k, s_suppkey * 7 % n AS t FROM supplier, n) SELECT 'm' || k AS module, 'm' || t AS target, 'layer' AS problem FROM u WHERE t < k AND t % 5 > k % 5 AND t IN (SELECT s_suppkey FROM supplier)")
def _k02(s, d):
    m = M.load(s, d, "supplier")
    n = m.agg(F.count("*").alias("n"))
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    target = F.col("s_suppkey") * 7 % F.col("n")
    uses = m.crossJoin(F.broadcast(n)).where(target < F.col("s_suppkey")).select(name(F.col("s_suppkey")).alias("module"), name(target).alias("target"))  # one row
    return gates.dag_violations(uses, m.select(name(F.col("s_suppkey")).alias("module"), (F.col("s_suppkey") % 5).alias("layer")))


@register("k03_blast_radius", "+reach(child, parent) AS (SELECT child, parent FROM subordinate UNION SELECT r.child, p.parent FROM reach r JOIN subordinate p ON r.parent = p.child) SELECT parent AS term, child AS user FROM reach WHERE parent IN (2, 5)", "subordinate", True)
def _k03(s, d):
    uses = M.subordinate(s, d).select(F.col("child").alias("module"), F.col("parent").alias("target"))
    return gates.affected(s.createDataFrame([(2,), (5,)], "term long"), uses)


@register("i08_missing_bindings", "SELECT min(c_custkey) AS entity_id, c_mktsegment AS source, (c_custkey % 700)::VARCHAR AS external_id FROM customer WHERE c_custkey % 700 % 9 <> 0 GROUP BY 2, 3 HAVING count(DISTINCT c_custkey) = 1")
def _i08(s, d):
    c = M.load(s, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 700).cast("string").alias("external_id"))
    return gates.missing_bindings(c, c.where("cast(external_id AS int) % 9 = 0"))


@register("i09_review_queue", "SELECT left_key, right_key, n_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY sha256('q:' || left_key || ':' || right_key)) AS r FROM (SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key, a.s_nationkey AS n_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)) WHERE r <= 2")
def _i09(s, d):
    a = M.load(s, d, "supplier").select(F.col("s_suppkey").alias("left_key"), F.col("s_nationkey").alias("n_nationkey"))
    pairs = a.join(a.withColumnRenamed("left_key", "right_key"), "n_nationkey").where("left_key < right_key")
    return gates.review_queue(pairs, ["n_nationkey"], "q", 2).select("left_key", "right_key", "n_nationkey")


@register("i10_match_probability", "SELECT p_partkey, round((pow(2, p_size / 10.0) * (0.1 / 0.9)) / (1 + pow(2, p_size / 10.0) * (0.1 / 0.9)), 6) AS probability FROM part")
def _i10(s, d):
    return M.load(s, d, "part").select("p_partkey", F.round(identity.match_probability(F.col("p_size") / 10.0, 0.1), 6).alias("probability"))


# -- remaining scalars, sources, paging


@register("x24_decimal_axis", "SELECT c_custkey, CASE WHEN abs(c_acctbal) <= 90 THEN CASE WHEN c_acctbal = 0 THEN '0' ELSE rtrim(rtrim(CAST(CAST(c_acctbal AS DECIMAL(18,6)) AS VARCHAR), '0'), '.') END END AS axis FROM customer")
def _x24(s, d):
    return M.load(s, d, "customer").select("c_custkey", X.canonical_decimal(F.col("c_acctbal").cast("decimal(18,6)").cast("string"), 90).alias("axis"))


@register("x26_rates", "SELECT l_returnflag, round(least(0.7, sum((l_discount > 0.05)::INT)::DOUBLE / count(*)), 4) AS rate FROM lineitem GROUP BY 1")
def _x26(s, d):
    return M.load(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.least(F.lit(0.7), F.count_if(F.col("l_discount") > 0.05) / F.count("*")), 4).alias("rate"))


@register("x30_ids_by_namespace", "SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ';' ORDER BY c_mktsegment) AS ids FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def _x30(s, d):
    n = M.load(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    m = n.groupBy("c_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n")))).alias("m"))  # few segments
    return m.select("c_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("ids"))


@register("x32_path_walk", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def _x32(s, d):
    body = F.to_json(F.struct(F.struct(F.struct(F.get_json_object("props", "$.k").cast("int").alias("c")).alias("b")).alias("a")))
    return M.load(s, d, "events").select("event_id", F.variant_get(F.parse_json(body), "$.a.b.c", "string").alias("value"))


@register("a03_count_by_type", "SELECT entity_type, count(*) AS n FROM entities GROUP BY 1", "entities")
def _a03(s, d):
    return M.entities(s, d).groupBy("entity_type").agg(F.count("*").alias("n"))


@register("a04_distinct_places", "SELECT subject_id, count(DISTINCT object_value) AS places FROM assertions GROUP BY 1", "assertions")
def _a04(s, d):
    return M.assertions(s, d).groupBy("subject_id").agg(F.count_distinct("object_value").alias("places"))


@register("o01_history_page", "SELECT assertion_id, valid_from FROM assertions WHERE subject_id = 3 ORDER BY valid_from DESC, assertion_id DESC LIMIT 20 OFFSET 10", "assertions")
def _o01(s, d):
    return paging.ordered_page(M.assertions(s, d).where("subject_id = 3").select("assertion_id", "valid_from"), [F.desc("valid_from"), F.desc("assertion_id")], 20, 10)


@register("u01_sensor_union", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey = 5 UNION SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7")
def _u01(s, d):
    o = M.load(s, d, "lineitem")
    return o.where("l_orderkey = 5").select("l_suppkey").union(o.where("l_linenumber = 7").select("l_suppkey")).distinct()


@register("u05_unregistered", "SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _u05(s, d):
    name = lambda t, c: M.load(s, d, t).select(F.concat(F.lit("f"), F.col(c).cast("string")).alias("path"))
    return name("orders", "o_orderkey").join(name("lineitem", "l_orderkey"), "path", "left_anti")


@register("s26_geometry_join", "SELECT 'loc-' || c_custkey AS location_iri, 'POINT(' || (c_custkey % 180) || ' ' || (c_custkey % 80) || '.5)' AS wkt FROM customer WHERE c_custkey % 2 = 0")
def _s26(s, d):
    k = F.col("c_custkey")
    iri = F.concat(F.lit("loc-"), k.cast("string")).alias("location_iri")
    pts = M.load(s, d, "customer").select(iri, (k % 180).cast("string").alias("longitude"), F.concat((k % 80).cast("string"), F.lit(".50")).alias("latitude"))
    return rdf.geometry(pts, M.load(s, d, "customer").where("c_custkey % 2 = 0").select(iri))


def _body(e, item):
    return F.to_json(F.struct(F.array(item).alias(e)))


@register("m05_overpass", f"SELECT 'node/' || event_id AS record_id, {_LAT}::DOUBLE AS latitude, {_LON}::DOUBLE AS longitude, event_type AS name FROM events WHERE {_LAT} BETWEEN 0 AND 25 AND {_LON} BETWEEN 98 AND 122 AND event_type <> 'view'")
def _m05(s, d):
    lat, lon = _coords()
    item = F.struct(F.when(F.col("event_type") == "view", "area").otherwise("node").alias("type"), F.col("event_id").alias("id"), lat.alias("lat"), lon.alias("lon"), F.create_map(F.lit("name"), "event_type").alias("tags"))
    return mappers.overpass(M.load(s, d, "events").select(_body("elements", item).alias("body")), SCS)


@register("m08_fishing", f"SELECT 'f' || event_id AS record_id, event_type, {_LAT}::DOUBLE AS latitude, {_LON}::DOUBLE AS longitude FROM events WHERE {_LAT} BETWEEN 0 AND 25 AND {_LON} BETWEEN 98 AND 122")
def _m08(s, d):
    lat, lon = _coords()
    item = F.struct(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("type"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("position"))
    return mappers.fishing(M.load(s, d, "events").select(_body("entries", item).alias("body")), SCS).select("record_id", "event_type", "latitude", "longitude")


@register("m09_gdacs", f"SELECT event_type || ':' || event_id || ':1' AS record_id, {_LAT}::DOUBLE AS latitude, {_LON}::DOUBLE AS longitude FROM events WHERE {_LAT} BETWEEN 0 AND 25 AND {_LON} BETWEEN 98 AND 122 AND event_type <> 'error'")
def _m09(s, d):
    lat, lon = _coords()
    item = F.struct(F.struct(F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("eventtype"), F.col("event_id").cast("string").alias("eventid"), F.lit("1").alias("episodeid")).alias("properties"))
    return mappers.gdacs(M.load(s, d, "events").select(_body("features", item).alias("body")), SCS).select("record_id", "latitude", "longitude")


@register("m10_wikidata", "SELECT 'Q' || p_partkey AS record_id, CASE WHEN p_size > 20 THEN p_brand ELSE p_name END AS name, CASE WHEN p_type = 'ECONOMY' THEN 'Platform' ELSE 'Facility' END AS entity_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')")
def _m10(s, d):
    labels = F.create_map(F.lit("vi"), F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise(" "), F.lit("en"), F.col("p_name"))
    body = F.to_json(F.struct(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("id"), labels.alias("labels"), F.array("p_brand").alias("aliases"), F.array("p_brand", "p_type").alias("classes")))
    return mappers.wikidata(M.load(s, d, "part").select(body.alias("body")), {"ECONOMY": "Platform", "STANDARD": "Facility"}).select("record_id", "name", "entity_type")


@register("m11_gleif", "SELECT record_id, name FROM (SELECT lpad(c_custkey::VARCHAR, 18, '0') || lpad((c_custkey % 100)::VARCHAR, 2, '0') AS record_id, c_name AS name FROM customer) WHERE CAST(record_id AS HUGEINT) % 97 = 1")
def _m11(s, d):
    k = F.col("c_custkey").cast("string")
    lei = F.concat(F.lpad(k, 18, "0"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    body = F.to_json(F.struct(lei.alias("lei"), F.concat(F.lit(" "), "c_name").alias("legal_name")))
    return mappers.gleif(M.load(s, d, "customer").select(body.alias("body"))).select("record_id", "name")


@register("t07_late_facts", "SELECT subject_id, arg_max(assertion_id, struct_pack(a := valid_from, b := sequence)) AS assertion_id FROM assertions WHERE status = 'asserted' GROUP BY 1", "assertions")
def _t07(s, d):
    late_first = M.assertions(s, d).orderBy(F.desc("sequence"))
    return facts.history(late_first, True).where("status = 'asserted'").groupBy("subject_id").agg(F.max_by("assertion_id", F.struct("valid_from", "sequence")).alias("assertion_id"))


# -- connectors, published snapshots, splits, linkage, references, shapes of names


@register("s17_connector_pages", "SELECT 'd' || doc_id AS record_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def _s17(s, d):
    """Documents come in three pages, of which the second fails once after it was handed over; every record ends in the log once."""
    place, docs = _place(s, "connector"), M.load(s, d, "documents").where("text is not null")
    archive, store, log = RawArchive(s, f"{place}/raw"), CheckpointStore(s, f"{place}/checkpoints"), EventLog(s, f"{place}/log")
    config = fingerprint({"table": "documents"}, "text", "1")

    def fetch(cursor):
        n = int(cursor or 0)
        rows = docs.where(F.col("doc_id") % 3 == n).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), F.col("text").alias("body"))
        return Page(rows, str(n + 1) if n < 2 else None, n == 2)

    def mapper(rows):
        payload = F.to_json(F.struct("record_id", F.length("body").alias("n")))
        at = F.lit("2024-01-01").cast("timestamp")
        return rows.select(F.col("record_id").alias("event_id"), F.lit("DocumentRegistered").alias("event_type"), F.lit(6).alias("schema_version"), at.alias("occurred_at"), payload.alias("payload"), at.alias("valid_at"))

    failed = []

    def handle(events):
        known = log.read().select("event_id")
        log.commit(events.join(known, "event_id", "left_anti"))
        if store.load("documents") is not None and not failed:
            failed.append(True)
            raise OSError("the connection broke")

    while True:
        try:
            if run_page("documents", fetch, mapper, handle, archive, store, config) is None:
                break
        except OSError:
            continue
    if not archive.altered().isEmpty():
        raise RuntimeError("the archive holds an altered body")
    return log.read().select(F.get_json_object("payload", "$.record_id").alias("record_id"), F.get_json_object("payload", "$.n").cast("long").alias("n"))


@register("s16_raw_archive", "SELECT sha256(coalesce(text, '')) AS digest, min(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1")
def _s16(s, d):
    archive, docs = RawArchive(s, _place(s, "archive")), M.load(s, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("body"))
    archive.store("a", docs.where("cast(record_id as bigint) % 2 = 0"))
    archive.store("b", docs)
    return archive.bodies().select("digest", "bytes")


@register("s27_published_snapshot", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def _s27(s, d):
    """The second state is published, and a third, during whose writing the log changes, is not."""
    kept, n = Snapshots(s, _place(s, "published")), M.load(s, d, "nation")
    for name, most in (("a", 1), ("b", 3)):
        kept.publish(name, {"nations": n.where(F.col("n_regionkey") < most).select("n_nationkey", "n_name")}, lambda name=name: name)
    states = iter("cd")
    try:
        kept.publish("c", {"nations": n.select("n_nationkey", "n_name")}, lambda: next(states))
    except RuntimeError:
        pass
    return kept.read("nations", "b")


@register("i05_split_outcome", "SELECT survivor, duplicate, c_name AS binding, CASE WHEN duplicate % 30 = 3 THEN 'retained' ELSE 'restored' END AS outcome FROM merges JOIN customer ON c_custkey = duplicate WHERE duplicate % 10 = 3", "merges")
def _i05(s, d):
    m = M.merges(s, d)
    moved = M.load(s, d, "customer").select(F.col("c_custkey").alias("duplicate"), F.col("c_name").alias("binding"))
    owners = m.join(moved, "duplicate").where("duplicate % 30 <> 3").select(F.col("survivor").alias("entity_id"), "binding")
    wrong = m.where("duplicate % 10 = 3").select((F.col("survivor") - 1).alias("survivor"), "duplicate")  # not merged there: no rows
    return identity.split_outcome(m.where("duplicate % 10 = 3").select("survivor", "duplicate").union(wrong), moved, owners, m)


@register("i07_owners_after_splits", "SELECT CASE WHEN duplicate % 10 = 3 THEN duplicate ELSE survivor END AS entity_id, c_name AS binding FROM merges JOIN customer ON c_custkey = duplicate", "merges")
def _i07(s, d):
    m = M.merges(s, d)
    moved = M.load(s, d, "customer").select(F.col("c_custkey").alias("duplicate"), F.col("c_name").alias("binding"))
    owners = m.join(moved, "duplicate").select(F.col("survivor").alias("entity_id"), "binding")
    return identity.owners_after_splits(owners, identity.split_outcome(m.where("duplicate % 10 = 3"), moved, owners, m))


@register("i10_agreement_rates", "SELECT round(avg((c_nationkey = s_nationkey)::INT), 6) AS nation, round(avg((round(c_acctbal / 1000) = round(s_acctbal / 1000))::INT), 6) AS balance FROM customer, supplier")
def _i10u(s, d):
    c, p = M.load(s, d, "customer"), M.load(s, d, "supplier")
    # agreement of all pairs, from counts of values
    def chance(a, b):
        left, right = (df.groupBy(col.alias("v")).agg(F.count("*").alias(n)) for df, col, n in ((c, a, "x"), (p, b, "y")))
        return left.join(right, "v").agg(F.sum(F.col("x") * F.col("y")).alias("same"))

    total = c.agg(F.count("*").alias("x")).crossJoin(p.agg(F.count("*").alias("y"))).select((F.col("x") * F.col("y")).alias("all"))  # one row each
    parts = [chance(F.col("c_nationkey"), F.col("s_nationkey")).withColumnRenamed("same", "nation"), chance(F.round(F.col("c_acctbal") / 1000), F.round(F.col("s_acctbal") / 1000)).withColumnRenamed("same", "balance")]
    return parts[0].crossJoin(parts[1]).crossJoin(total).select(*(F.round(F.col(x) / F.col("all"), 6).alias(x) for x in ("nation", "balance")))


@register("o06_first_per_source", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 7")
def _o06(s, d):
    return mappers.first_n(M.load(s, d, "events"), "event_type", ["ts", "event_id"], 7).select("event_type", "event_id")


@register("w09_latest_record", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _w09(s, d):
    e = M.load(s, d, "events").select("user_id", "event_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return mappers.latest_by(e, ["user_id"], "day", "event_id").select("user_id", "event_id", "event_type")


@register("m12_encyclopedia", "SELECT 'enwiki:' || p_partkey AS record_id, p_partkey % 4 = 0 AS bare, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'Part ' || p_partkey ELSE p_name END AS subject, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS object, CASE WHEN p_partkey % 4 <> 0 THEN 8 END AS start, CASE WHEN p_partkey % 4 <> 0 THEN 8 + length(CASE WHEN p_partkey % 4 = 1 THEN 'It' ELSE p_name END) + length(' is a wholly owned subsidiary of the ') + length(p_brand) + length(' since 1999') END AS \"end\" FROM part")
def _m12(s, d):
    p, k = M.load(s, d, "part"), F.col("p_partkey")
    subject = F.when(k % 4 == 1, "It").otherwise(F.col("p_name"))
    text = F.concat(F.lit("Lead-in. "), subject, F.lit(" is a wholly owned subsidiary of the "), F.col("p_brand"), F.lit(" since 1999. More.\n\nX is a subsidiary of Y."))
    page = F.struct(F.concat(F.lit("Part "), k.cast("string")).alias("title"), k.alias("pageid"), text.alias("extract"), F.array(F.struct(F.lit(5).alias("revid"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"))).alias("revisions"), F.struct(F.when(k % 4 != 0, "Q42").alias("wikibase_item")).alias("pageprops"))
    raw = p.select(k.cast("string").alias("record_id"), F.lit("urn:x").alias("source_uri"), F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query"))).alias("body"))
    rows = mappers.encyclopedia(raw).select("record_id", F.col("item").isNull().alias("bare"), F.explode_outer("claims").alias("c"))
    return rows.select("record_id", "bare", "c.subject", "c.object", (F.col("c.start") - 1).alias("start"), (F.col("c.end") - 1).alias("end"))


@register("s25_export_context", "SELECT DISTINCT json_extract_string(props, '$.k') AS iri FROM events")
def _s25(s, d):
    known = rdf.context(event_log(s, d))
    rows = event_log(s, d).where("event_type = 'AssertionMade'").select(F.get_json_object("payload", "$.object.value").alias("iri"))
    return rdf.in_context(rows, "iri", known, "location").distinct()


@register("s30_triples", "SELECT '<urn:assert:' || event_id || '>' AS s, '\"' || status || '\"' AS o FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'retracted' WHEN lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'signup' THEN 'superseded' ELSE 'asserted' END AS status FROM events)")
def _s30(s, d):
    """Quads are written as lines, and read back."""
    place = _place(s, "quads")
    rdf.lines(rdf.quads(M.assertions(s, d))).write.text(place)
    return rdf.read_ntriples(s, place).where("p = '<urn:kg:core#status>'").select("s", "o")


@register("sh_named_thing", "SELECT 'c' || c_custkey AS focus, 'name' AS \"constraint\", '0' AS detail FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 2 = 0")
def _shn(s, d):
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")
    c = M.load(s, d, "customer")
    types = c.select(key, F.when(F.col("c_custkey") % 2 == 0, "Person").otherwise("Event").alias("type"))
    below = s.createDataFrame([("Person", "Agent"), ("Agent", "Agent"), ("Event", "Event")], "child string, parent string")
    return shapes.named_things(types, c.where("c_custkey % 9 <> 0").select(key, F.col("c_name").alias("name")), below)


@register("sh_identifier", "SELECT 'i' || s_suppkey AS focus, CASE WHEN s_suppkey % 4 = 1 THEN 'scheme' WHEN s_suppkey % 4 = 2 THEN 'value' ELSE 'class' END AS \"constraint\", CASE WHEN s_suppkey % 4 = 1 THEN '0' WHEN s_suppkey % 4 = 2 THEN '2' ELSE 'nobody' END AS detail FROM supplier WHERE s_suppkey % 4 <> 0")
def _shi(s, d):
    k = F.col("s_suppkey") % 4
    n = M.load(s, d, "supplier").select(F.concat(F.lit("i"), F.col("s_suppkey").cast("string")).alias("node"), "s_suppkey", "s_name")
    value = lambda p, v: F.struct(F.lit(p).alias("property"), v.alias("value"))
    all_ = F.array(value("identifies", F.when(k == 3, "nobody").otherwise(F.col("s_name"))), F.when(k != 1, value("scheme", F.lit("lei"))), value("value", F.lit("a")), F.when(k == 2, value("value", F.lit("b"))))
    values = n.select("node", F.explode(F.array_compact(all_)).alias("v")).select("node", "v.*")
    return shapes.identifiers(n.select("node"), values, n.select(F.col("s_name").alias("entity_id")))


@register("sh_unresolved", "SELECT o_orderkey::VARCHAR AS focus, 'reference_text' AS \"constraint\", n::VARCHAR AS detail FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE n <> 1")
def _shu(s, d):
    return shapes.unresolved_references(M.load(s, d, "orders").select(F.col("o_orderkey").alias("reference_id")), M.load(s, d, "lineitem").select(F.col("l_orderkey").alias("reference_id"), F.lit("x").alias("text")))


@register("sh_datatype", "SELECT event_id::VARCHAR AS focus, 'datatype' AS \"constraint\", CASE WHEN event_id % 3 = 1 THEN '2024-13-01T00:00:00Z' ELSE 'soon' END AS detail FROM events WHERE event_id % 3 <> 0")
def _shd(s, d):
    k = F.col("event_id") % 3
    stamp = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, "2024-13-01T00:00:00Z").otherwise("soon")
    return shapes.value_type(M.load(s, d, "events").select("event_id", stamp.alias("stamp")), "event_id", "stamp", "dateTime")


@register("sh_node_kind_or", "SELECT p_partkey::VARCHAR AS focus, 'nodeKind' AS \"constraint\", '\"' || p_brand || '\"' AS detail FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey::VARCHAR, 'or', NULL FROM part WHERE NOT (p_size > 10 OR p_retailprice > 1200)")
def _shk(s, d):
    p = M.load(s, d, "part")
    term = F.when(F.col("p_size") > 25, F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).otherwise(F.concat(F.lit("<urn:"), F.col("p_partkey").cast("string"), F.lit(">")))
    kinds = shapes.node_kind(p.withColumn("term", term), "p_partkey", "term", "IRI")
    return kinds.union(shapes.any_of(p, "p_partkey", [F.col("p_size") > 10, F.col("p_retailprice") > 1200]))
