"""Append-only event log on Parquet: sequencing, idempotent commits, incremental scans, schema upcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.closure import cut

CURRENT_VERSION = 6
EVENT_SCHEMA = "event_id string, event_type string, schema_version int, occurred_at timestamp, payload string, valid_at timestamp, sequence bigint, idempotency_key string, request_fingerprint string, operation_event_count int"


class LogConflict(ValueError):
    pass


class EventLog:
    """One writer at a time; files are added, never changed. max_records bounds the rows of a file (segment rotation)."""

    def __init__(self, spark: SparkSession, path: str, max_records: int = 500_000):
        self.spark, self.path, self.max_records = spark, path, max_records

    def read(self, after: int | None = None) -> DataFrame:
        """All events in no particular order; `after` skips files by their sequence statistics."""
        try:
            df = self.spark.read.schema(EVENT_SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return df if after is None else df.where(F.col("sequence") > after)

    def find(self, key: str, fingerprint: str) -> DataFrame:
        """The events of an earlier commit with this key; a different fingerprint is a conflict."""
        found = self.read().where(F.col("idempotency_key") == key)
        other = found.where(~F.col("request_fingerprint").eqNullSafe(F.lit(fingerprint))).limit(1).collect()
        if other:
            raise LogConflict(f"idempotency key {key} was used for another request")
        return found

    def commit(self, events: DataFrame, key: str | None = None, fingerprint: str | None = None) -> DataFrame:
        """Appends all events or none: stamps sequences in the order of occurred_at and event_id, rejects known or repeated ids, replays a known key.

        The batch may be of any size: it is sorted by ranges, each range numbers its own rows, and only the number of rows a range meets the driver.
        """
        if key is not None:
            earlier = self.find(key, fingerprint)
            if not earlier.isEmpty():
                return earlier
        fresh = with_columns(events, EVENT_SCHEMA).repartitionByRange("occurred_at", "event_id").withColumn("part", F.spark_partition_id())
        fresh = cut(fresh)  # the parts must not be dealt anew
        if not fresh.groupBy("event_id").count().where("count > 1").isEmpty() or not fresh.join(self.read(), "event_id", "left_semi").isEmpty():
            raise LogConflict("an event id is already in the log or repeated")
        last = self.read().agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
        sizes = sorted((r["part"], r["n"]) for r in fresh.groupBy("part").agg(F.count("*").alias("n")).collect())
        n, offsets = 0, []
        for part, size in sizes:
            offsets.append((part, last + n))
            n += size
        before = F.broadcast(self.spark.createDataFrame(offsets, "part int, before long"))  # one row a partition
        nth = F.row_number().over(Window.partitionBy("part").orderBy("occurred_at", "event_id"))
        stamped = fresh.join(before, "part").withColumn("sequence", (nth + F.col("before")).cast("bigint")).drop("part", "before")
        stamped = stamped.withColumns({"idempotency_key": F.lit(key).cast("string"), "request_fingerprint": F.lit(fingerprint).cast("string"), "operation_event_count": F.lit(n).cast("int")})
        stamped.write.mode("append").option("maxRecordsPerFile", self.max_records).parquet(self.path)
        return self.read(last).where(F.col("sequence") <= last + n)

    def scan(self) -> DataFrame:
        """All events at the current version; a log with a break in its sequence, or with newer rows, raises."""
        events = self.read()
        broken = gaps(events).limit(1).collect()
        if broken:
            raise LogConflict(f"the log lacks sequences from {broken[0]['first_missing']} to {broken[0]['next'] - 1}")
        return upcast(events)


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly these columns; those it lacks are null."""
    have = set(df.columns)
    pairs = [c.strip().split(" ", 1) for c in schema.split(",")]
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in pairs))


def gaps(events: DataFrame) -> DataFrame:
    """first_missing, next: breaks in the sequence. Only the ends of blocks of a million meet in one window."""
    block = F.floor((F.col("sequence") - 1) / 1_000_000)
    inner = events.select("sequence", F.lag("sequence").over(Window.partitionBy(block).orderBy("sequence")).alias("before"))
    within = inner.where("before is not null and sequence > before + 1").select((F.col("before") + 1).alias("first_missing"), F.col("sequence").alias("next"))
    ends = events.groupBy(block.alias("b")).agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    prev = ends.select("lo", F.lag("hi").over(Window.orderBy("b")).alias("before"))
    between = prev.where("lo > coalesce(before, 0) + 1").select((F.coalesce("before", F.lit(0)) + 1).cast("bigint").alias("first_missing"), F.col("lo").alias("next"))
    return within.union(between)


def _get(path: str) -> Column:
    return F.get_json_object("payload", path)


def upcast(events: DataFrame) -> DataFrame:
    """Every row at the current version, with the fields of all versions as columns; newer rows raise.

    Older location events become assertions, absent source lists become lists of the one source, names gain their normal form,
    documents gain a content digest. Each step applies to rows of lower versions only.
    """
    v = F.col("schema_version")
    checked = events.withColumn("schema_version", F.when(v > CURRENT_VERSION, F.raise_error(F.concat(F.lit("unsupported schema version "), v.cast("string"))).cast("int")).otherwise(v))
    old = lambda k: F.col("schema_version") < k
    located = F.col("event_type") == "LocationObserved"
    sources = F.from_json(_get("$.source_ids"), "array<string>")
    out = checked.withColumns(
        {
            "upcast_type": F.when(old(4) & located, "AssertionMade").otherwise(F.col("event_type")),
            "predicate_iri": F.when(old(4) & located, "urn:kg:core#locatedAt").otherwise(_get("$.predicate_iri")),
            "valid_at": F.when(old(2), F.coalesce("valid_at", "occurred_at")).otherwise(F.col("valid_at")),
            "source_ids": F.when(old(3), F.coalesce(sources, F.array(_get("$.source_id")))).otherwise(sources),
            "evidence_quality": F.when(old(5), F.coalesce(_get("$.evidence_quality"), F.lit("unknown"))).otherwise(_get("$.evidence_quality")),
            "content_hash": F.when(old(6) & (F.col("event_type") == "DocumentRegistered"), F.coalesce(_get("$.content_hash"), F.sha2(F.coalesce(_get("$.text"), _get("$.uri")), 256))).otherwise(_get("$.content_hash")),
        }
    )
    return out.withColumn("schema_version", F.lit(CURRENT_VERSION))
