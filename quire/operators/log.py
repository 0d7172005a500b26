"""Versions of a table, and writers that don't lose each other's changes.

A version is a folder of changed rows and a marker in the log, which only one writer can
make.  A writer starts from a version; where others have committed since then it's told
which of its rows they changed too, as rows, and commits on top of theirs if there are none.
Every SNAPSHOT-th version also holds the whole table, so that reading takes that
and few changes.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = 16


@dataclass(frozen=True)
class Outcome:
    """version: the one that was committed, or None; conflicts: the keys, with what others committed (theirs_...) and what this writer wanted (mine_...); a null struct is a deletion."""

    version: int | None
    conflicts: DataFrame | None = None


class TableLog:
    """A table of (key columns, value columns) in a folder that all writers share."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        self.spark, self.key, self._files = spark, key, at.getFileSystem(context._jsc.hadoopConfiguration())
        self.folder = self._files.makeQualified(at).toString().rstrip("/")
        self._seen: dict[int, str] = {}

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _claim(self, version: int, label: str) -> bool:
        """Makes the marker of a version, if nobody has."""
        name = f"log/{version:010d}"
        if self.folder.startswith("file:"):  # Hadoop's local files are looked up and then made, which isn't one step
            local = re.sub(r"\Afile:/*", "/", self.folder) + "/" + name
            os.makedirs(os.path.dirname(local), exist_ok=True)
            whole = f"{local}.{uuid.uuid4().hex}"
            with open(whole, "w", encoding="utf-8") as f:
                f.write(label)
            try:
                os.link(whole, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(whole)
            return True
        try:
            out = self._files.create(self._path(name), False)
        except Exception as e:  # noqa: BLE001  Java's exceptions have no common Python class
            if self._files.exists(self._path(name)):
                return False
            raise e
        out.write(bytearray(label.encode()))
        out.close()
        return True

    def _labels(self) -> dict[int, str]:
        """The data folder of each version.  Markers never change, so each is read once."""
        if self._files.exists(self._path("log")):
            for status in self._files.listStatus(self._path("log")):
                name = status.getPath().getName()
                if re.fullmatch(r"[0-9]{10}", name) and int(name) not in self._seen:
                    stream = self._files.open(status.getPath())
                    self._seen[int(name)] = bytes(stream.readAllBytes()).decode()
                    stream.close()
        return dict(self._seen)

    def head(self) -> int:
        """The last version; -1 of an empty log."""
        return max(self._labels(), default=-1)

    def start(self, rows: DataFrame) -> int:
        """Commits the first version; raises a ValueError if there is one."""
        label = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{label}/whole")
        if not self._claim(0, label):
            raise ValueError(f"{self.folder} has versions")
        return 0

    def _changes(self, labels: dict[int, str], after: int, upto: int) -> DataFrame | None:
        """Keys that were changed in versions after the first and up to the last given one, with their last row."""
        parts = [self.spark.read.parquet(f"{self.folder}/data/{labels[v]}/changes").withColumn("_version", F.lit(v)) for v in range(after + 1, upto + 1)]
        if not parts:
            return None
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        return every.groupBy(*self.key).agg(F.max_by("row", "_version").alias("row"))

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the last one by default."""
        labels = self._labels()
        version = max(labels, default=-1) if version is None else version
        if version not in labels:
            raise ValueError(f"{self.folder} has no version {version}")
        base = version - version % SNAPSHOT
        while base and not self._files.exists(self._path(f"data/{labels[base]}/whole/_SUCCESS")):
            base -= SNAPSHOT  # its writer ended between the commit and the whole table
        whole = self.spark.read.parquet(f"{self.folder}/data/{labels[base]}/whole")
        changes = self._changes(labels, base, version)
        if changes is None:
            return whole
        rest = whole.join(changes.select(*self.key), self.key, "left_anti")
        return rest.unionByName(changes.filter("row IS NOT NULL").select(*self.key, "row.*").select(*whole.columns))

    def commit(self, base: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Outcome:
        """Commits rows and deleted keys that a writer made from version base, each key at most once.

        Keys that others have changed since base to something else are conflicts, and
        then nothing is committed; equal changes are none.
        """
        whole = self.read(0).schema
        values = [f for f in whole.fieldNames() if f not in self.key]
        row = F.struct(*values).alias("row")
        parts = [] if upserts is None else [upserts.select(*self.key, row)]
        if deletes is not None:
            parts.append(deletes.select(*self.key).withColumn("row", F.lit(None).cast(self.read(0).select(row).schema["row"].dataType)))
        if not parts:
            raise ValueError("nothing to commit")
        label = uuid.uuid4().hex
        path = f"{self.folder}/data/{label}/changes"
        (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).write.parquet(path)
        mine = self.spark.read.parquet(path)
        if mine.groupBy(*self.key).count().filter("count > 1").limit(1).count():
            raise ValueError("a key is changed twice")
        while True:
            labels = self._labels()
            head = max(labels)
            theirs = self._changes(labels, base, head)
            if theirs is not None:
                both = theirs.withColumnRenamed("row", "theirs").join(mine.withColumnRenamed("row", "mine"), self.key).filter("NOT theirs <=> mine")
                if both.limit(1).count():
                    return Outcome(None, both)
            if self._claim(head + 1, label):
                if (head + 1) % SNAPSHOT == 0:
                    self._snapshot(head + 1, label)
                return Outcome(head + 1)
            base = max(base, head)  # until there nothing of this writer's was changed

    def _snapshot(self, version: int, label: str) -> None:
        labels = self._labels()
        base = self.read(version - 1)
        changes = self._changes(labels, version - 1, version)
        rest = base.join(changes.select(*self.key), self.key, "left_anti")
        rest.unionByName(changes.filter("row IS NOT NULL").select(*self.key, "row.*").select(*base.columns)).write.mode("overwrite").parquet(f"{self.folder}/data/{label}/whole")
