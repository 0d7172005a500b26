"""Change capture as Structured Streaming: the manifest of versions is the sink's own table, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.store import latest, upsert


class SnapshotTable:
    """Versions of a table as folders, and a pointer file's worth of state in their names: v=<batch>."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        found = [x.getPath() for x in fs.listStatus(folder)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={known[-1]}") if known else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def keep_latest(stream: DataFrame, into: SnapshotTable, key: str, version: list[str], checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch to the newest snapshot before it: the last row of a key by version wins, also against older state."""

    def batch(rows: DataFrame, number: int) -> None:
        new = latest(rows, key, version)
        old = into.read(before=number)
        newest = latest(old.unionByName(new.select(*old.columns)), key, version)
        into.write(newest, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window_start, kind, n, total of events by time, with events later than the watermark left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def apply_changes(old: DataFrame, changes: DataFrame, key: list[str], deleted: str = "deleted") -> DataFrame:
    """A change set with deletions: changed rows replace old ones, rows marked deleted go."""
    return upsert(old, changes.drop(deleted), key).join(changes.filter(deleted), key, "left_anti").select(*old.columns)
