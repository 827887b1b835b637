"""Analytical lake: Parquet by day, an authoritative manifest, compaction, verification, and SQL over the view `events`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, rows bigint, bytes bigint, min_occurred_at string, max_occurred_at string, written_at timestamp"
LAKE = "event_id string, event_type string, schema_version tinyint, occurred_at string, payload_json string, valid_at string, sequence bigint, idempotency_key string"


class Lake:
    """Readers see only files that the newest manifest names; a manifest is a folder m-<version>, complete once it has _SUCCESS."""

    def __init__(self, spark: SparkSession, root: str, max_rows: int = 500_000):
        self.spark, self.root, self.max_rows = spark, root.rstrip("/"), max_rows

    # -- manifest

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root)) if s.isDirectory()]
        return sorted(int(n[2:]) for n in names if n.startswith("m-") and fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def manifest(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/m-{v[-1]}") if v else self.spark.createDataFrame([], MANIFEST)

    def _publish(self, entries: DataFrame) -> None:
        """The new manifest becomes visible at once, when its _SUCCESS appears."""
        entries.write.parquet(f"{self.root}/m-{(self._versions() or [0])[-1] + 1}")

    def _described(self, batch: str) -> DataFrame:
        files = self.spark.read.option("basePath", batch).parquet(batch).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), "occurred_at")
        return files.groupBy("path").agg(F.count("*").alias("rows"), F.first("bytes").alias("bytes"), F.min("occurred_at").alias("min_occurred_at"), F.max("occurred_at").alias("max_occurred_at")).select("path", "rows", "bytes", "min_occurred_at", "max_occurred_at", F.current_timestamp().alias("written_at"))

    # -- data

    def read(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """Registered files only, of the days asked for: the manifest is pruned by its times before paths reach the driver, one a file."""
        entries = self.manifest()
        if first_day is not None:
            entries = entries.where(F.substring("max_occurred_at", 1, 10) >= first_day)
        if last_day is not None:
            entries = entries.where(F.substring("min_occurred_at", 1, 10) <= last_day)
        df = self._files([r.path for r in entries.select("path").collect()])
        day = F.col("event_date").cast("string")
        return df.where((day >= first_day if first_day else F.lit(True)) & (day <= last_day if last_day else F.lit(True)))

    def _files(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], LAKE + ", event_date date")
        return self.spark.read.schema(LAKE + ", event_date date").option("basePath", f"{self.root}/data").parquet(*paths)

    def _write(self, df: DataFrame) -> str:
        batch = f"{self.root}/data/batch={uuid.uuid4().hex}"
        days = df.withColumn("event_date", F.to_date(F.substring("occurred_at", 1, 10)))
        # rebalance: a day's rows come together, but a day that is too large is split
        days = days.hint("rebalance", "event_date")
        days.write.partitionBy("event_date").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "7").option("maxRecordsPerFile", self.max_rows).parquet(batch)
        return batch

    def append(self, events: DataFrame) -> int:
        """Adds events whose id is not in the lake; of repeated ids the first in sequence stays. Returns the number added."""
        from .log import with_columns

        fresh = with_columns(events, LAKE)
        first = fresh.groupBy("event_id").agg(F.min_by(F.struct(*fresh.columns), F.coalesce("sequence", F.lit(0))).alias("e")).select("e.*")
        new = first.join(self.read().select("event_id"), "event_id", "left_anti").select(fresh.columns)
        batch = self._write(new)
        fs, path = self._fs()
        if not any(s.isDirectory() for s in fs.listStatus(path(batch))):
            return 0
        entries = self._described(batch)
        self._publish(self.manifest().union(entries))
        return entries.agg(F.sum("rows")).first()[0]

    def compact(self) -> list[str]:
        """Rewrites the days that have more files than max_rows needs, and no others; publishes, then deletes what they were. Returns the days."""
        day = F.substring("min_occurred_at", 1, 10)  # a file holds rows of one day
        crowded = self.manifest().withColumn("day", day)
        many = crowded.groupBy("day").agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).where(F.col("files") > F.ceil(F.col("rows") / self.max_rows))
        old = crowded.join(many.select("day"), "day").select("day", "path", "rows").collect()
        if not old:
            return []
        paths = [r.path for r in old]
        entries = self._described(self._write(self._files(paths).drop("event_date", "batch")))
        if entries.agg(F.sum("rows")).first()[0] != sum(r.rows for r in old):
            raise RuntimeError("compaction changed the number of rows; the old files stay")
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._publish(self.manifest().join(gone, "path", "left_anti").union(entries))
        fs, path = self._fs()
        for folder in sorted({p.rsplit("/", 1)[0] for p in paths}):  # a batch's day goes as a whole
            fs.delete(path(folder), True)
        return sorted({r.day for r in old})

    def verify(self) -> DataFrame:
        """path, problem (missing, unregistered, size, rows): files against the manifest; none if all agree."""
        fs, path = self._fs()
        data = f"{self.root}/data"
        seen = self.spark.createDataFrame([], "path string, bytes bigint")
        if fs.exists(path(data)):
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(data).select("path", F.col("length").alias("bytes"))
            seen = listed
        counted = self.spark.createDataFrame([], "path string, counted bigint")
        if not seen.isEmpty():
            counted = self.spark.read.option("recursiveFileLookup", "true").schema("event_id string").parquet(data).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("counted"))
        flat = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        m = flat(self.manifest().select("path", "rows", F.col("bytes").alias("stated")))
        j = m.join(flat(seen).join(flat(counted), "path", "left"), "path", "full_outer")
        problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("stated").isNull(), "unregistered").when(F.col("bytes") != F.col("stated"), "size").when(F.coalesce("counted", F.lit(0)) != F.col("rows"), "rows")
        return j.select("path", problem.alias("problem")).where("problem is not null")

    def sql(self, text: str) -> DataFrame:
        """Any Spark SQL over the view `events`, in a session of its own so that names do not leak; an empty lake has an empty view."""
        session = self.spark.newSession()
        Lake(session, self.root).read().createOrReplaceTempView("events")
        return session.sql(text)


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """A versioned reference snapshot; an empty one is refused."""
    if df.isEmpty():
        raise ValueError("an empty snapshot is refused")
    df.write.option("compression", "zstd").parquet(f"{root}/snapshot={version}")


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The named snapshot, else the newest by name."""
    df = spark.read.option("basePath", root).parquet(root).withColumn("snapshot", F.col("snapshot").cast("string"))
    version = version or df.agg(F.max("snapshot")).first()[0]
    return df.where(F.col("snapshot") == version).drop("snapshot")
