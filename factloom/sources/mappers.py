"""Raw source bodies to normalised rows: JSON and delimited snapshots parsed by schema, then filtered by column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, in_box, point_iri

POSITION = ["record_id", "external_id", "entity_name", "observed_at", "valid_until", "latitude", "longitude", "location_iri"]


@dataclass(frozen=True)
class Bounds:
    """A closed rectangle of interest."""

    name: str
    south: float
    west: float
    north: float
    east: float

    def __post_init__(self):
        if not self.name.strip() or not -90 <= self.south < self.north <= 90 or not -180 <= self.west < self.east <= 180:
            raise ValueError("bounds need a name and ordered edges within the globe")

    def holds(self, lat: Column, lon: Column) -> Column:
        return in_box(lat, lon, self.south, self.west, self.north, self.east)


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")


def first_n(df: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each source in the given order; what a task cannot need is left out before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def latest_by(df: DataFrame, keys: list[str], seen: str, tie: str) -> DataFrame:
    """Of each key the row seen last; of several the one with the greatest tie. Rows never seen come before all others."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(seen).alias("seen"), F.col(tie).alias("tie"))).alias("_r"))
    return best.select(*keys, "_r.*").select(df.columns)


def _seconds(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp")


def _position(df: DataFrame, record: Column, prefix: str) -> DataFrame:
    """df: external_id, position_time (seconds), latitude, longitude."""
    return df.select(
        record.alias("record_id"), "external_id", F.concat(F.lit(prefix), F.col("external_id")).alias("entity_name"),
        _seconds(F.col("position_time")).alias("observed_at"), _seconds(F.col("position_time") + 1).alias("valid_until"),
        "latitude", "longitude", point_iri(F.col("latitude"), F.col("longitude")).alias("location_iri"),
    )


def opensky(raw: DataFrame, bounds: Bounds, max_age: int = 3600) -> DataFrame:
    """raw: record_id, body. State vectors of 17 items or more: address, call sign, country, position time, contact, lon, lat, ..."""
    doc = raw.select("record_id", F.from_json("body", "time bigint, states array<array<string>>").alias("d"))
    s = doc.select("record_id", "d.time", F.posexplode("d.states").alias("ordinal", "s")).where(F.size("s") >= 17)
    s = s.select("record_id", "time", "ordinal", F.lower(F.trim(F.get("s", F.lit(0)))).alias("external_id"), F.get("s", F.lit(3)).try_cast("bigint").alias("position_time"), finite(F.get("s", F.lit(5))).alias("longitude"), finite(F.get("s", F.lit(6))).alias("latitude"))
    age = F.col("time") - F.col("position_time")
    good = s.where(F.col("external_id").rlike("^[0-9a-f]{6}$") & bounds.holds(F.col("latitude"), F.col("longitude")) & age.between(0, max_age))
    return _position(good, F.concat_ws(":", F.regexp_replace("record_id", "^states:", ""), "external_id"), "Aircraft ")


def adsb(raw: DataFrame, bounds: Bounds, max_age: int = 3600) -> DataFrame:
    """raw: record_id, body with `now` in milliseconds and `ac`; of each address the first row counts."""
    doc = raw.select("record_id", F.from_json("body", "now bigint, ac array<struct<hex:string,lat:string,lon:string,seen_pos:double>>").alias("d"))
    s = doc.select("record_id", "d.now", F.posexplode("d.ac").alias("ordinal", "a"))
    s = s.select("record_id", "ordinal", F.lower(F.trim("a.hex")).alias("external_id"), finite(F.col("a.lat")).alias("latitude"), finite(F.col("a.lon")).alias("longitude"), F.col("a.seen_pos").alias("age"), (F.floor(F.col("now") / 1000 - F.col("a.seen_pos"))).cast("bigint").alias("position_time"))
    good = s.where(F.col("external_id").rlike("^[0-9a-f]{6}$") & bounds.holds(F.col("latitude"), F.col("longitude")) & F.col("age").between(0, max_age))
    return _position(first_by(good, ["record_id", "external_id"], "ordinal"), F.concat_ws(":", "record_id", "external_id"), "Aircraft ")


def gdelt(lines: DataFrame, bounds: Bounds) -> DataFrame:
    """lines: value with 61 tab-separated fields; a wrong width, id or day raises, a place outside the bounds drops the row."""
    f = F.split("value", "\t", -1)
    at = lambda i: F.get(f, F.lit(i))
    width = F.when(F.size(f) != 61, F.raise_error(F.lit("an event row does not have 61 fields")).cast("boolean")).otherwise(F.lit(True))
    sound = F.when(~(at(0).rlike(r"^\d+$") & at(1).rlike(r"^\d{8}$")), F.raise_error(F.lit("an event row has a wrong id or day")).cast("boolean")).otherwise(F.lit(True))
    lat, lon = finite(at(56)), finite(at(57))
    return lines.where(width).where(sound).where(bounds.holds(lat, lon)).select(
        at(0).alias("record_id"), F.to_date(at(1), "yyyyMMdd").alias("event_day"), at(6).alias("actor1"), at(16).alias("actor2"), at(26).alias("event_code"), at(28).alias("event_root_code"),
        F.nullif(at(29), F.lit("")).cast("int").alias("quad_class"), finite(at(30)).alias("goldstein_scale"), at(52).alias("action_location"), lat.alias("latitude"), lon.alias("longitude"), at(60).alias("source_url"),
    )


def aisstream(lines: DataFrame, bounds: Bounds) -> DataFrame:
    """lines: value, one JSON message each; valid position reports of nine-digit identities within the bounds."""
    m = lines.select(F.from_json("value", "MessageType string, MetaData struct<MMSI:string,Latitude:double,Longitude:double,time_utc:string>, Message struct<PositionReport:struct<Valid:boolean,Sog:double,Cog:double>>").alias("m")).select("m.*")
    good = m.where((F.col("MessageType") == "PositionReport") & F.col("Message.PositionReport.Valid") & F.col("MetaData.MMSI").rlike("^[0-9]{9}$") & bounds.holds(F.col("MetaData.Latitude"), F.col("MetaData.Longitude")))
    return good.select(F.col("MetaData.MMSI").alias("external_id"), F.col("MetaData.Latitude").alias("latitude"), F.col("MetaData.Longitude").alias("longitude"), F.col("Message.PositionReport.Sog").alias("speed"), F.col("MetaData.time_utc").alias("observed_at"))


def _features(raw: DataFrame, properties: str) -> DataFrame:
    schema = f"features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    return raw.select(F.explode(F.from_json("body", schema)["features"]).alias("f")).select("f.id", F.get("f.geometry.coordinates", F.lit(0)).alias("longitude"), F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"), F.get("f.geometry.coordinates", F.lit(2)).alias("depth"), "f.properties")


def usgs(raw: DataFrame, bounds: Bounds) -> DataFrame:
    """GeoJSON earthquakes: lon, lat and possibly depth; times in milliseconds."""
    e = _features(raw, "mag:double,place:string,time:bigint")
    return e.where(F.col("id").isNotNull() & bounds.holds(F.col("latitude"), F.col("longitude"))).select(F.col("id").alias("record_id"), "latitude", "longitude", "depth", F.col("properties.mag").alias("magnitude"), F.col("properties.place").alias("place"), F.timestamp_millis("properties.time").alias("observed_at"))


def gdacs(raw: DataFrame, bounds: Bounds) -> DataFrame:
    """GeoJSON disaster alerts, keyed type:id:episode."""
    e = _features(raw, "eventtype:string,eventid:string,episodeid:string,alertlevel:string,name:string")
    p = lambda n: F.col(f"properties.{n}")
    key = F.concat_ws(":", p("eventtype"), p("eventid"), p("episodeid"))
    return e.where(p("eventtype").isNotNull() & p("eventid").isNotNull() & p("episodeid").isNotNull() & bounds.holds(F.col("latitude"), F.col("longitude"))).select(key.alias("record_id"), "latitude", "longitude", p("alertlevel").alias("alert_level"), p("name").alias("name"))


def firms(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """CSV hotspots (latitude, longitude, acq_date, acq_time, satellite as text); the id is a digest of the row."""
    lat, lon = finite(F.col("latitude")), finite(F.col("longitude"))
    seen = F.to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), "yyyy-MM-dd HHmm")
    return rows.where(bounds.holds(lat, lon)).select(F.sha2(F.concat_ws("|", "latitude", "longitude", "acq_date", "acq_time", "satellite"), 256).alias("record_id"), lat.alias("latitude"), lon.alias("longitude"), "satellite", seen.alias("observed_at"))


def fishing(raw: DataFrame, bounds: Bounds) -> DataFrame:
    """Fishing events: id, type, start, end, position."""
    e = raw.select(F.explode(F.from_json("body", "entries array<struct<id:string,type:string,start:string,end:string,position:struct<lat:double,lon:double>,vessel:struct<id:string,name:string>>>")["entries"]).alias("e")).select("e.*")
    return e.where(F.col("id").isNotNull() & bounds.holds(F.col("position.lat"), F.col("position.lon"))).select(F.col("id").alias("record_id"), F.col("type").alias("event_type"), F.to_timestamp("start").alias("valid_from"), F.to_timestamp("end").alias("valid_until"), F.col("position.lat").alias("latitude"), F.col("position.lon").alias("longitude"), F.col("vessel.name").alias("vessel"))


def overpass(raw: DataFrame, bounds: Bounds) -> DataFrame:
    """Map elements: nodes by their point, ways and relations by their centre."""
    e = raw.select(F.explode(F.from_json("body", "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>")["elements"]).alias("e")).select("e.*")
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    return e.where(F.col("type").isin("node", "way", "relation") & bounds.holds(lat, lon)).select(F.concat_ws("/", "type", "id").alias("record_id"), lat.alias("latitude"), lon.alias("longitude"), F.element_at("tags", F.lit("name")).alias("name"))


def crosswalk(bindings: DataFrame) -> DataFrame:
    """source, external_id, outcome (bind, conflict), entity_id: an identifier claimed for several entities is never bound."""
    g = bindings.groupBy("source", "external_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("e"))
    return g.select("source", "external_id", F.when(F.col("n") == 1, "bind").otherwise("conflict").alias("outcome"), F.when(F.col("n") == 1, F.col("e")).alias("entity_id"))


def wikidata(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """raw: body of entities with labels, aliases, classes and identifier claims; label in vi, else en; the first known class decides."""
    from ..functions.scalars import first_filled, first_mapped

    d = raw.select(F.from_json("body", "id string, labels map<string,string>, aliases array<string>, classes array<string>, lei string").alias("d")).select("d.*")
    label = first_filled(F.element_at("labels", F.lit("vi")), F.element_at("labels", F.lit("en")))
    out = d.select(F.col("id").alias("record_id"), label.alias("name"), F.array_distinct("aliases").alias("aliases"), first_mapped(F.col("classes"), types).alias("entity_type"), "lei")
    return out.where(F.col("record_id").rlike(r"^Q\d+$") & F.col("name").isNotNull() & F.col("entity_type").isNotNull())


def gleif(raw: DataFrame) -> DataFrame:
    """Legal entities with a sound identifier."""
    from ..functions.scalars import valid_lei

    d = raw.select(F.from_json("body", "lei string, legal_name string, country string").alias("d")).select("d.*")
    return d.where(valid_lei(F.col("lei")) & (F.trim("legal_name") != "")).select(F.col("lei").alias("record_id"), F.trim("legal_name").alias("name"), "country")


def feed(lines: DataFrame) -> DataFrame:
    """Tracking feed, one JSON object a line; a missing field or blank name raises."""
    schema = "mmsi string, name string, sensor_id string, track_id string, position_uri string, location_uri string, at_time string"
    d = lines.select(F.from_json("value", schema).alias("d")).select("d.*")
    need = [F.col(c) for c in ("mmsi", "name", "sensor_id", "track_id", "at_time")] + [F.coalesce("position_uri", "location_uri")]
    bad = F.lit(False)
    for c in need:
        bad = bad | F.coalesce(F.trim(c) == "", F.lit(True))
    ok = F.when(bad, F.raise_error(F.lit("a feed line lacks a field")).cast("boolean")).otherwise(F.lit(True))
    return d.where(ok).select("mmsi", "name", "sensor_id", "track_id", F.coalesce("position_uri", "location_uri").alias("position_uri"), F.to_timestamp("at_time").alias("at_time"))


#: What an explicit claim looks like, and what refers to the page itself.
SUBSIDIARY = r"([^.!?\n]{1,100}?)\s+is\s+(?:a|an)\s+(?:[\w-]+\s+){0,4}subsidiary of\s+([^.;,\n]{2,80}?)(?=\s+(?:that\s+was|formed\s+in|since\s+\d{4})\b|[.,;\n]|$)"
PRONOUNS = ("it", "this company", "the company")


def encyclopedia(raw: DataFrame) -> DataFrame:
    """raw: record_id, source_uri, body: answers with one page and its last revision. A row a page: its document and `claims`.

    record_id, source_uri, title, text, content_hash, revision_id, revision_at, item (the page's entity id or null), claims. A body without
    page, revision or text, or with a malformed item, raises. See `subsidiary_claims` for the claims; without an item there are none.
    """
    schema = "query struct<pages:array<struct<title:string,pageid:bigint,missing:boolean,extract:string,revisions:array<struct<revid:bigint,timestamp:string>>,pageprops:struct<wikibase_item:string>>>>"
    p = raw.select("source_uri", F.get(F.from_json("body", schema)["query"]["pages"], F.lit(0)).alias("p")).select("source_uri", "p.*", F.get("p.revisions", F.lit(0)).alias("r"))
    item = F.col("pageprops.wikibase_item")
    at = F.try_to_timestamp(F.col("r.timestamp"))
    sound = ~F.coalesce("missing", F.lit(False)) & F.col("title").isNotNull() & F.col("pageid").isNotNull() & F.col("r.revid").isNotNull() & at.isNotNull() & (F.trim("extract") != "") & (item.isNull() | item.rlike("^Q[1-9][0-9]*$"))
    checked = p.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.lit("a page lacks its text, revision or ids")).cast("boolean")))
    out = checked.select(F.concat(F.lit("enwiki:"), "pageid").alias("record_id"), "source_uri", "title", F.col("extract").alias("text"), F.sha2("extract", 256).alias("content_hash"), F.col("r.revid").cast("string").alias("revision_id"), at.alias("revision_at"), item.alias("item"))
    return out.withColumn("claims", F.when(F.col("item").isNotNull(), subsidiary_claims(F.col("text"), F.col("title"))).otherwise(F.array().cast("array<struct<subject:string,object:string,start:int,end:int>>")))


def subsidiary_claims(text: Column, title: Column) -> Column:
    """array of (subject, object, start, end): "X is a ... subsidiary of Y" in the first paragraph; end is exclusive, in characters.

    A claim's span ends with its sentence. "It" and the like stand for the title. Y ends at a clause that says since when, or at a mark.
    """
    pattern, blank = "(?iU)" + SUBSIDIARY, F.lit(r"(?U)^\s+|\s+$")
    paragraph = F.substring_index(text, "\n\n", 1)
    locate = lambda what, at: F.call_function("locate", what, paragraph, at)
    # matches do not overlap, so each begins where its text is found first after the one before
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<m:string,at:int>>").alias("found"))

    def place(acc: Column, m: Column) -> Column:
        at = locate(m, acc["next"])
        return F.struct((at + F.length(m)).alias("next"), F.concat(acc["found"], F.array(F.struct(m.alias("m"), (at - 1).alias("at")))).alias("found"))

    def claim(x: Column) -> Column:
        part = lambda i: F.regexp_replace(F.regexp_extract(x["m"], pattern, i), blank, F.lit(""))
        after = x["at"] + F.length(x["m"])
        dot = locate(F.lit("."), after + 1)
        span = F.substring(paragraph, x["at"] + 1, F.when(dot > 0, dot - 1).otherwise(after) - x["at"])
        start = x["at"] + F.length(span) - F.length(F.regexp_replace(span, F.lit(r"(?U)^\s+"), F.lit("")))
        subject = F.when(F.lower(part(1)).isin(*PRONOUNS), title).otherwise(part(1))
        return F.struct(subject.alias("subject"), F.regexp_replace(part(2), F.lit(r"(?iU)^(?:the|a|an)\s+"), F.lit("")).alias("object"), start.alias("start"), (start + F.length(F.regexp_replace(span, blank, F.lit("")))).alias("end"))

    placed = F.aggregate(F.regexp_extract_all(paragraph, F.lit(pattern), F.lit(0)), zero, place, lambda acc: acc["found"])
    return F.filter(F.transform(placed, claim), lambda c: (c["subject"] != "") & (c["object"] != ""))
