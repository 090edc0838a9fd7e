"""A decision ledger fed by arriving files: hash buckets, of which a batch rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import latest

_BUCKETS = "bucket int, version long"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


class Ledger:
    """The latest state of each key under ``folder``.

    ``data/v=N/bucket=B``: rows of one bucket as of batch N. ``current/vN``: a small table that names, for each
    bucket, the batch that wrote it last; it is written after the data, and the highest complete one is current, so a
    reader sees a batch whole or not at all. ``buckets`` is fixed when a ledger begins; a bucket should fit a task.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        place, files = _files(self.spark, f"{self.folder}/current")
        if not files.exists(place):
            return []
        names = [x.getPath() for x in files.listStatus(place)]
        return sorted(int(p.getName()[1:]) for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def placed(self, version: int) -> dict[int, int]:
        """Of each bucket the batch that wrote it, as of a version: a row for each bucket."""
        rows = self.spark.read.schema(_BUCKETS).parquet(f"{self.folder}/current/v{version}").collect()
        return {r.bucket: r.version for r in rows}

    def read(self, schema, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of a version (the current one), of all buckets or some."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else None
        where = self.placed(version) if version is not None else {}
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(where.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, version: int) -> None:
        """Take up a batch: only the buckets of its keys are read and written.

        A batch that has been taken up before changes nothing; one that was cut short is written again.
        """
        before = [v for v in self.versions() if v < version]
        if version in self.versions():
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most one row for each bucket
        rows = batch
        if before:
            rows = batch.unionByName(self.read(batch.schema, before[-1], touched))
        new = latest(rows, self.key, *(F.desc(c) for c in self.order)).withColumn("bucket", bucket)
        # a file for each bucket
        new.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v={version}")
        batch.unpersist()
        where = (self.placed(before[-1]) if before else {}) | dict.fromkeys(touched, version)
        self.spark.createDataFrame(sorted(where.items()), _BUCKETS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/current/v{version}")
        self._clean()

    def _clean(self, keep: int = 2) -> None:
        """Delete what none of the last versions names; readers of the version before may still be at work."""
        known = self.versions()
        used = {(v, b) for x in known[-keep:] for b, v in self.placed(x).items()}
        for version in known[:-keep]:
            place, files = _files(self.spark, f"{self.folder}/current/v{version}")
            files.delete(place, True)
        place, files = _files(self.spark, f"{self.folder}/data")
        for part in files.listStatus(place):
            version = int(part.getPath().getName().partition("=")[2])
            left = 0
            for x in files.listStatus(part.getPath()):
                name = x.getPath().getName()
                if name.startswith("bucket="):
                    if version <= known[-1] and (version, int(name.partition("=")[2])) not in used:
                        files.delete(x.getPath(), True)
                    else:
                        left += 1
            if not left and version <= known[-1]:
                files.delete(part.getPath(), True)


def follow_decisions(spark: SparkSession, folder: str, schema: str, key: str, order: list[str], out: str, checkpoint: str, buckets: int = 64):
    """Upsert each arriving batch into the ledger under ``out``; a restart takes up where the checkpoint ends."""
    ledger = Ledger(spark, out, key, order, buckets)
    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(ledger.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_progress(events: DataFrame, time: str, decision: str, delay: str = "1 day") -> DataFrame:
    """Decisions by day; works on a stream (with its watermark) and on a table alike."""
    source = events.withWatermark(time, delay) if events.isStreaming else events
    counted = source.groupBy(F.window(time, "1 day").alias("w"), F.col(decision).alias("decision")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "decision", "n")
