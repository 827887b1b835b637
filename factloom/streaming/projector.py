"""The projection of an event log to current tables, as pure functions of the log, and the same kept up to date by micro-batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import canonical, redirects

TYPES = ("EntityCreated", "AssertionMade", "AssertionSuperseded", "EntityMerged", "EntitySplit", "TrackObserved")


def _get(path: str):
    return F.get_json_object("payload", path)


def once(events: DataFrame) -> DataFrame:
    """Of events with one id the first in sequence counts; rows without sequence come before all others."""
    return events.groupBy("event_id").agg(F.min_by(F.struct(*events.columns), F.coalesce("sequence", F.lit(-1))).alias("e")).select("e.*")


def project_entities(events: DataFrame) -> DataFrame:
    """entity_id, entity_type, name (the first given wins), first_event_time, last_event_time."""
    e = events.where("event_type = 'EntityCreated'").select(_get("$.entity_id").alias("entity_id"), _get("$.entity_type").alias("entity_type"), _get("$.name").alias("name"), "occurred_at", F.coalesce("sequence", F.lit(-1)).alias("sequence"))
    return e.groupBy("entity_id").agg(F.min_by("entity_type", "sequence").alias("entity_type"), F.min_by("name", "sequence").alias("name"), F.min("occurred_at").alias("first_event_time"), F.max("occurred_at").alias("last_event_time"))


def project_assertions(events: DataFrame) -> DataFrame:
    """The latest state of each assertion: whichever of making again, superseding by a later assertion, and retracting came last."""
    made = events.where("event_type = 'AssertionMade'").select(
        _get("$.assertion_id").alias("assertion_id"), _get("$.subject_id").alias("subject_id"), _get("$.predicate_iri").alias("predicate_iri"), _get("$.object.kind").alias("kind"), _get("$.object.value").alias("object_value"),
        F.to_timestamp(_get("$.valid_from")).alias("valid_from"), F.to_timestamp(_get("$.valid_until")).alias("valid_until"), _get("$.supersedes").alias("supersedes"), "sequence",
    )
    state = lambda df, i, s: df.select(F.col(i).alias("assertion_id"), F.lit(s).alias("status"), "sequence")
    gone = events.where("event_type = 'AssertionSuperseded'").select(_get("$.assertion_id").alias("assertion_id"), F.lit("retracted").alias("status"), "sequence")
    later = state(made.where("supersedes is not null"), "supersedes", "superseded")
    # a link to an assertion that is not made yet has no effect: only states after the first making count
    first = made.groupBy("assertion_id").agg(F.min("sequence").alias("born"))
    states = state(made, "assertion_id", "asserted").union(later).union(gone).join(first, "assertion_id").where("sequence >= born")
    last = states.groupBy("assertion_id").agg(F.max_by("status", "sequence").alias("status"))
    row = made.groupBy("assertion_id").agg(F.max_by(F.struct(*made.columns), "sequence").alias("r")).select("r.*")
    return row.join(last, "assertion_id")


def project_redirects(events: DataFrame) -> DataFrame:
    pick = lambda t: events.where(F.col("event_type") == t).select(_get("$.duplicate_id").alias("duplicate"), _get("$.survivor_id").alias("survivor"), "sequence")
    return redirects(pick("EntityMerged"), pick("EntitySplit"))


def project_tracks(events: DataFrame) -> DataFrame:
    """The last version of each track."""
    t = events.where("event_type = 'TrackObserved'").select(_get("$.track_id").alias("track_id"), _get("$.entity_id").alias("entity_id"), F.from_json(_get("$.observation_ids"), "array<string>").alias("observation_ids"), "sequence")
    return t.groupBy("track_id").agg(F.max_by(F.struct("entity_id", "observation_ids"), "sequence").alias("t")).select("track_id", "t.*")


def unknown_retractions(events: DataFrame) -> DataFrame:
    """event_id, assertion_id of retractions of what was never made."""
    gone = events.where("event_type = 'AssertionSuperseded'").select("event_id", _get("$.assertion_id").alias("assertion_id"))
    return gone.join(events.where("event_type = 'AssertionMade'").select(_get("$.assertion_id").alias("assertion_id")), "assertion_id", "left_anti").select("event_id", "assertion_id")


def project(events: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """All current tables. Arrival order does not matter: the sequence does. strict: a retraction of what was never made raises."""
    e = once(events)
    if strict:
        bad = unknown_retractions(e).limit(1).collect()
        if bad:
            raise ValueError(f"event {bad[0]['event_id']} retracts the unknown assertion {bad[0]['assertion_id']}")
    r = project_redirects(e)
    return {"entities": project_entities(e), "assertions": canonical(project_assertions(e), "subject_id", r), "redirects": r, "tracks": project_tracks(e)}


#: gold table -> its key, its projection, and the events that bear on it as (type, path of the key in the payload)
GOLD = {
    "entities": ("entity_id", project_entities, (("EntityCreated", "$.entity_id"),)),
    "assertions": ("assertion_id", project_assertions, (("AssertionMade", "$.assertion_id"), ("AssertionMade", "$.supersedes"), ("AssertionSuperseded", "$.assertion_id"))),
    "tracks": ("track_id", project_tracks, (("TrackObserved", "$.track_id"),)),
}


def touched(events: DataFrame, table: str) -> DataFrame:
    """event_id, key: which rows of a gold table each event bears on."""
    _, _, sources = GOLD[table]
    parts = [events.where(F.col("event_type") == t).select("event_id", _get(path).alias("key")) for t, path in sources]
    return reduce(DataFrame.union, parts).where("key is not null").distinct()


def checkpoint_of(events: DataFrame) -> DataFrame:
    """last_sequence, applied, unknown: how far a projection is, and how many events have no effect on it."""
    known = F.col("event_type").isin(*TYPES)
    return once(events).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last_sequence"), F.count_if(known).alias("applied"), F.count_if(~known).alias("unknown"))


class StreamingProjector:
    """Keeps bronze events deduplicated, and gold tables as versions: each micro-batch adds the rows that it changed.

    A version is a folder v=<epoch> of each gold table; it counts once the marker of its epoch exists, which is written last,
    so readers see all tables of a micro-batch or none. Of a key the newest version's row is current. A
    batch that is repeated after a failure replaces its own folders.
    """

    def __init__(self, spark: SparkSession, source: str, target: str, schema: str):
        self.spark, self.source, self.target, self.schema = spark, source.rstrip("/"), target.rstrip("/"), schema

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.target).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _bronze(self) -> DataFrame:
        """Versions of one batch are one folder: a batch that is repeated after a failure overwrites its own folder."""
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.target}/bronze")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def published(self) -> list[int]:
        """Epochs whose gold rows count."""
        fs, path = self._fs()
        place = path(f"{self.target}/published")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(place)) if fs.exists(place) else []

    def _apply(self, batch: DataFrame, epoch: int) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.target}/published/{epoch}"), False)
        known = self._bronze().where(F.input_file_name().rlike(f"/epoch={epoch}/") == F.lit(False)).select("event_id")
        place = f"{self.target}/bronze/epoch={epoch}"
        once(batch).join(known, "event_id", "left_anti").select(batch.columns).write.mode("overwrite").parquet(place)
        fresh, events = self.spark.read.schema(self.schema).parquet(place), self._bronze()
        for table, (key, projection, _) in GOLD.items():
            keys = touched(fresh, table).select("key").distinct()
            # all events that bear on a key that the batch touched; what they say of other keys is not whole
            own = events.join(touched(events, table).join(keys, "key", "left_semi").select("event_id").distinct(), "event_id", "left_semi")
            rows = projection(own).join(keys.withColumnRenamed("key", key), key, "left_semi")
            rows.write.mode("overwrite").parquet(f"{self.target}/gold/{table}/v={epoch}")
        fs.create(path(f"{self.target}/published/{epoch}"), True).close()

    def run(self, **trigger):
        """Reads what is new, by default once; trigger(processingTime=...) follows."""
        events = self.spark.readStream.schema(self.schema).parquet(self.source)
        writer = events.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.target}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def gold(self, table: str) -> DataFrame:
        """The current rows of a gold table, read from its versions alone."""
        key, projection, _ = GOLD[table]
        layout = projection(self.spark.createDataFrame([], self.schema)).schema
        epochs = self.published()
        if not epochs:
            return self.spark.createDataFrame([], layout)
        names = layout.fieldNames()
        rows = self.spark.read.option("basePath", f"{self.target}/gold/{table}").schema(layout.add("v", "long")).parquet(*(f"{self.target}/gold/{table}/v={v}" for v in epochs))
        return rows.groupBy(key).agg(F.max_by(F.struct(*(n for n in names if n != key)), "v").alias("r")).select(key, "r.*").select(names)

    def tables(self) -> dict[str, DataFrame]:
        """Gold tables; merges are few, and are followed when read."""
        r = project_redirects(self._bronze())
        return {"entities": self.gold("entities"), "assertions": canonical(self.gold("assertions"), "subject_id", r), "redirects": r, "tracks": self.gold("tracks")}
