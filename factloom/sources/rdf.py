"""Export of assertions as N-Quads lines, and geometry triples from a point table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"


def iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def literal(c: Column, datatype: str | None = None) -> Column:
    """Quoted, with backslash, quote and line ends escaped."""
    text = c.cast("string")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'), F.lit(f"^^<{XSD}{datatype}>" if datatype else ""))


def quads(assertions: DataFrame, graph: str = "urn:graph:assertions") -> DataFrame:
    """s, p, o, g: one row a statement about an assertion; absent values give none."""
    core = lambda n: F.lit(f"<urn:kg:core#{n}>")
    stamp = lambda c: literal(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "dateTime")
    parts = [
        (F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"), F.lit("<urn:kg:assertion#Assertion>")),
        (core("subject"), iri(F.concat(F.lit("urn:world:entity:"), F.col("subject_id").cast("string")))),
        (core("predicate"), iri(F.col("predicate_iri"))),
        (core("object"), iri(F.concat(F.lit("urn:world:location:"), F.col("object_value").cast("string")))),
        (core("validFrom"), stamp(F.col("valid_from"))),
        (core("validUntil"), stamp(F.col("valid_until"))),
        (core("status"), literal(F.col("status"))),
        (core("hasSource"), iri(F.concat(F.lit("urn:source:"), F.col("source_id")))),
    ]
    rows = F.explode(F.array(*(F.struct(p.alias("p"), o.alias("o")) for p, o in parts))).alias("q")
    return assertions.select(iri(F.col("assertion_id")).alias("s"), rows).select("s", "q.p", "q.o", F.lit(f"<{graph}>").alias("g")).where("o is not null")


def lines(q: DataFrame) -> DataFrame:
    return q.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))


def geometry(points: DataFrame, locations: DataFrame) -> DataFrame:
    """location_iri, wkt of points (location_iri, longitude, latitude as text) whose location exists, is given once and is within range."""
    from ..functions.scalars import canonical_decimal

    once = points.groupBy("location_iri").agg(F.count("*").alias("n"), F.first("longitude").alias("longitude"), F.first("latitude").alias("latitude")).where("n = 1")
    lon, lat = canonical_decimal(F.col("longitude"), 180), canonical_decimal(F.col("latitude"), 90)
    return once.join(locations, "location_iri", "left_semi").select("location_iri", F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")")).alias("wkt")).where("wkt is not null")


def context(events: DataFrame) -> DataFrame:
    """kind (document, observation, location), iri: what other events may name, once each. events: event_type, payload."""
    get = lambda path: F.get_json_object("payload", path)
    kind = F.col("event_type")
    place = F.coalesce(get("$.position_uri"), get("$.location_uri"))
    sources = (
        ("document", kind == "DocumentRegistered", get("$.document_id")),
        ("observation", kind == "ObservationRecorded", get("$.observation_id")),
        ("location", kind == "ObservationRecorded", place),
        ("location", (kind == "AssertionMade") & (get("$.object.kind") == "location"), get("$.object.value")),
        ("location", (kind == "EntityCreated") & (get("$.entity_type") == "Location"), get("$.entity_id")),
    )
    rows = F.explode(F.array(*(F.when(holds, F.struct(F.lit(k).alias("kind"), iri_.alias("iri"))) for k, holds, iri_ in sources))).alias("r")
    return events.select(rows).select("r.*").where("iri <> ''").distinct()


def in_context(rows: DataFrame, column: str, known: DataFrame, kind: str) -> DataFrame:
    """Rows whose column names something of the kind that the log holds. known: kind, iri (see `context`)."""
    return rows.join(known.where(F.col("kind") == kind).select(F.col("iri").alias(column)), column, "left_semi").select(rows.columns)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of N-Triples and N-Quads files, terms as they are written; comments and blank lines give none, any other line raises.

    Lines are independent, so files are split among tasks whatever their size.
    """
    term = r'<[^>\s]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>\s]*>|@[A-Za-z0-9-]+)?'
    line = rf"^\s*(<[^>\s]*>|_:\S+)\s+(<[^>\s]*>)\s+({term})\s*(?:<[^>\s]*>|_:\S+)?\s*\.\s*(?:#.*)?$"
    text = spark.read.text(path).where(r"NOT value RLIKE '^\\s*(#.*)?$'")
    checked = text.where(F.when(F.col("value").rlike(line), True).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), "value")).cast("boolean")))
    return checked.select(*(F.regexp_extract("value", line, i + 1).alias(c) for i, c in enumerate("spo"))).distinct()
