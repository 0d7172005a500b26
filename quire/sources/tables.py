"""A registry of tables: export and import as sorted CSV, unchanged ones skipped, imports validated before anything is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.bib import csv_table, write_csv


@dataclass
class Table:
    name: str
    schema: str
    order: list[str]
    #: A condition that every row must meet, and tables to be made anew when this one changes.
    valid: Callable[[], Column] | None = None
    cascades: list[str] = field(default_factory=list)


class InvalidImport(ValueError):
    pass


class Registry:
    """Tables by name, with the times of their last change and last export."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.changed, self.written = spark, {}, {}, {}
        self.rows: dict[str, DataFrame] = {}

    def add(self, table: Table, rows: DataFrame) -> None:
        self.tables[table.name], self.rows[table.name], self.changed[table.name] = table, rows, max(self.changed.values(), default=0) + 1

    def replace(self, name: str, rows: DataFrame) -> list[str]:
        """Sets a table's rows; returns the names of the tables that depend on it, directly or not, in the registry's order."""
        self.rows[name], self.changed[name] = rows, max(self.changed.values(), default=0) + 1
        todo, found = [name], set()
        while todo:
            for x in self.tables[todo.pop()].cascades:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return [x for x in self.tables if x in found]

    def export(self, path: str, names: list[str] | None = None) -> list[str]:
        """Writes what has changed since its last export; returns the names."""
        due = [n for n in names or self.tables if self.changed[n] > self.written.get(n, 0)]
        for n in due:
            write_csv(self.rows[n], f"{path}/{n}", self.tables[n].order)
            self.written[n] = self.changed[n]
        return due

    def load(self, path: str, names: list[str] | None = None) -> list[str]:
        """Phase one reads and validates every table and raises on the first invalid row; phase two replaces them all."""
        read = {}
        for n in names or list(self.tables):
            t = self.tables[n]
            rows = csv_table(self.spark, f"{path}/{n}", t.schema)
            bad = F.col("_corrupt_record").isNotNull()
            if t.valid is not None:
                bad = bad | ~F.coalesce(t.valid(), F.lit(False))
            first = rows.withColumn("_bad", bad).filter("_bad").limit(1).collect()
            if first:
                raise InvalidImport(f"{n}: {first[0].asDict()}")
            read[n] = rows.drop("_corrupt_record")
        affected: set[str] = set()
        for n, rows in read.items():
            affected.update(self.replace(n, rows))
        return [n for n in self.tables if n in affected]


def metadata_json(rows: DataFrame) -> DataFrame:
    """value: one JSON object {entry: {property: value}} a line, of (entry_key, property, value)."""
    per = rows.groupBy("entry_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("m"))
    return per.select(F.to_json(F.create_map("entry_key", "m")).alias("value"))


def read_metadata(lines: DataFrame) -> DataFrame:
    found = lines.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("entry_key", "m"))
    return found.select("entry_key", F.explode("m").alias("property", "value"))


def stale(rows: DataFrame, fetched: str, now: Column, months: int = 1) -> DataFrame:
    """Rows fetched more than so many months ago or never, the oldest first within each partition."""
    due = rows.filter(F.col(fetched).isNull() | (F.add_months(F.col(fetched).cast("date"), months) < now.cast("date")))
    return due.sortWithinPartitions(F.col(fetched).asc_nulls_first())


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """key (the file's name without ending), bytes and md5 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+\z", 1).alias("key"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def duplicate_files(hashes: DataFrame, crossref: DataFrame) -> DataFrame:
    """md5, keys, related of files with equal contents; related if all but one are children (entry_key, parent) of the other."""
    per = hashes.join(crossref.select(F.col("entry_key").alias("key"), "parent"), "key", "left").groupBy("md5").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.collect_set("parent").alias("parents"))
    several = per.filter(F.size("keys") > 1)
    return several.select("md5", "keys", ((F.size("parents") == 1) & F.array_contains("keys", F.get("parents", F.lit(0)))).alias("related"))
