"""Paged connectors run into a log: archive, map, hand over, then move the checkpoint; and snapshots published by a pointer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checkpoint:
    """How far a source is. cursor: where the next page begins, None at the start and once it is complete."""

    source_id: str
    cursor: str | None
    complete: bool
    fingerprint: str
    last_digest: str
    raw_records: int
    mapped_records: int


@dataclass(frozen=True)
class Page:
    """records: record_id, body. A page that is not the last names the cursor of the next one."""

    records: DataFrame
    next_cursor: str | None
    complete: bool


class Versions:
    """Small JSON documents kept as versions in a shared folder. A version counts once it stands under its final name, so a reader sees a whole one or none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str) -> list[int]:
        fs, path = self._fs()
        place = path(f"{self.root}/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v-"))

    def load(self, name: str) -> dict | None:
        """The newest version; None if there is none. A document that is not JSON raises."""
        n = self._numbers(name)
        if not n:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}/v-{n[-1]}", wholetext=True).first()[0])

    def save(self, name: str, document: dict) -> int:
        """Writes the next version beside the others and renames it. Of two writers at once one raises."""
        fs, path = self._fs()
        n = (self._numbers(name) or [0])[-1] + 1
        final, draft = path(f"{self.root}/{name}/v-{n}"), path(f"{self.root}/{name}/.draft-{n}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {n} of {name} was written by someone else")
        return n


class CheckpointStore:
    """One checkpoint a source."""

    def __init__(self, spark: SparkSession, root: str):
        self.versions = Versions(spark, root)

    def load(self, source_id: str) -> Checkpoint | None:
        got = self.versions.load(source_id)
        if got is None:
            return None
        if got.get("source_id") != source_id:
            raise ValueError(f"the checkpoint of {source_id} is another source's")
        return Checkpoint(**got)

    def save(self, checkpoint: Checkpoint) -> None:
        if checkpoint.raw_records < 0 or checkpoint.mapped_records < 0:
            raise ValueError("counts of records are not negative")
        self.versions.save(checkpoint.source_id, asdict(checkpoint))


def fingerprint(request: dict, record_schema: str, mapping_version: str) -> str:
    """A digest of what must not change while a source is read."""
    if not mapping_version.strip():
        raise ValueError("a mapping needs a version")
    return hashlib.sha256(json.dumps([request, record_schema, mapping_version], sort_keys=True).encode()).hexdigest()


class RawArchive:
    """Bodies by content: one row a digest, however often and by however many sources a body was fetched; and who fetched it."""

    SCHEMA = "digest string, body string, bytes bigint"
    MANIFEST = "source_id string, record_id string, digest string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def bodies(self) -> DataFrame:
        """A digest that two writers added at once is read once."""
        return self._read("bodies", self.SCHEMA).dropDuplicates(["digest"])

    def manifest(self) -> DataFrame:
        return self._read("manifest", self.MANIFEST).distinct()

    def store(self, source_id: str, records: DataFrame) -> DataFrame:
        """Adds the bodies that are new; records with their digest. A body is its UTF-8 text; null counts as empty."""
        body = F.coalesce("body", F.lit(""))
        rows = records.withColumn("digest", F.sha2(body, 256))
        new = rows.select("digest", body.alias("body"), F.octet_length(body).cast("bigint").alias("bytes")).dropDuplicates(["digest"])
        new.join(self._read("bodies", self.SCHEMA).select("digest"), "digest", "left_anti").write.mode("append").option("compression", "zstd").parquet(f"{self.root}/bodies")
        rows.select(F.lit(source_id).alias("source_id"), "record_id", "digest").write.mode("append").parquet(f"{self.root}/manifest")
        return rows

    def altered(self) -> DataFrame:
        """digest of bodies that are not what their digest says."""
        return self._read("bodies", self.SCHEMA).where(F.sha2("body", 256) != F.col("digest")).select("digest")


def run_page(
    source_id: str,
    fetch: Callable[[str | None], Page],
    mapper: Callable[[DataFrame], DataFrame],
    handle: Callable[[DataFrame], None],
    archive: RawArchive,
    checkpoints: CheckpointStore,
    config: str,
) -> Checkpoint | None:
    """Reads the next page; None if the source is complete. config: the source's `fingerprint`.

    handle gets the mapped rows and returns once they are kept, in a way that a repeated page adds nothing (EventLog.commit
    does). The checkpoint moves after it alone, so a page that fails is read again. A changed fingerprint, an empty page, and a
    cursor that does not move are refused before anything is archived.
    """
    before = checkpoints.load(source_id)
    if before is not None and before.fingerprint != config:
        raise ValueError(f"the request, schema or mapping of {source_id} changed since its checkpoint; read it under a new id")
    if before is not None and before.complete:
        return None
    cursor = before.cursor if before else None
    page = fetch(cursor)
    if page.complete != (page.next_cursor is None) or (not page.complete and page.next_cursor == cursor):
        raise ValueError(f"the page of {source_id} at {cursor!r} does not say how to go on")
    if page.records.isEmpty():
        raise ValueError(f"the page of {source_id} at {cursor!r} is empty")
    kept = archive.store(source_id, page.records)
    mapped = mapper(kept)
    handle(mapped)
    raw = kept.agg(F.count("*").alias("n"), F.max_by("digest", F.struct("record_id", "digest")).alias("last")).first()
    after = Checkpoint(source_id, page.next_cursor, page.complete, config, raw["last"], raw["n"] + (before.raw_records if before else 0), mapped.count() + (before.mapped_records if before else 0))
    checkpoints.save(after)
    return after


class Snapshots:
    """Tables built anew from a log and published together: readers follow the pointer to the last whole set."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = Versions(spark, f"{self.root}/pointer")

    def current(self) -> dict | None:
        """name, fingerprint and tables of the published set."""
        return self.pointer.load("current")

    def publish(self, name: str, tables: dict[str, DataFrame], state: Callable[[], str]) -> bool:
        """Writes the tables and moves the pointer; False if the published set is of the same state already.

        state: a fingerprint of the log. If it changes while tables are written, the set is not published and an error raised.
        """
        before = state()
        now = self.current()
        if now is not None and now["fingerprint"] == before:
            return False
        for table, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/{table}")
        if state() != before:
            raise RuntimeError("the log changed while the snapshot was written")
        self.pointer.save("current", {"name": name, "fingerprint": before, "tables": sorted(tables)})
        return True

    def read(self, table: str, expected: str | None = None) -> DataFrame | None:
        """The published table; None if nothing is published, it is of another state than expected, or it lacks the table: then replay."""
        now = self.current()
        if now is None or table not in now["tables"] or (expected is not None and now["fingerprint"] != expected):
            return None
        return self.spark.read.parquet(f"{self.root}/{now['name']}/{table}")
