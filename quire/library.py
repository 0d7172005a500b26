"""The commands of a library as methods.

A Library is an immutable set of tables; what edits returns a new Library, and nothing
runs until a table is read or saved.  Where a person would have to decide, results
carry needs_review instead of asking.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import normalise as fn
from quire.functions import render
from quire.operators import contributors, entry_checks, graph, keys, resolve, store, upkeep
from quire.operators import relational as rel
from quire.plans import rules
from quire.sources import bib

SCHEMAS = {
    "entries": "entry_key string, field string, value string",
    "groups": "group_name string, entry_key string",
    "aliases": "alias string, canonical string",
    "people": "id string, name string, orcid string",
    "names": "id string, name string",
    "roles": "entry_key string, role string, position long, contributor_id string",
}

#: Tables that only the statistics read.
STATISTICS = {
    "files": "path string", "field_mappings": "source_field string, target_field string", "superseded": "field string, triage_status string", "parents": "key string", "waived": "key string", "oldies": "key string",
    "non_double_entries": "a string", "non_double_contributors": "a string", "non_double_names": "a string", "flags": "key string",
}


@dataclass(frozen=True)
class Library:
    entries: DataFrame
    groups: DataFrame
    aliases: DataFrame
    people: DataFrame
    names: DataFrame
    roles: DataFrame

    # --- storage

    @staticmethod
    def of(entries: DataFrame, **tables: DataFrame) -> Library:
        spark = entries.sparkSession
        return Library(entries, **{n: tables.get(n) if tables.get(n) is not None else spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n != "entries"})

    @staticmethod
    def import_bib(spark: SparkSession, path: str) -> Library:
        """Entries of all files; of a key that occurs in several the first file's entry counts."""
        rows = bib.read(spark, path).filter("entry_key <> ''")
        first = rows.groupBy("entry_key").agg(F.min(F.struct("path", "pos")).alias("f"))
        kept = rows.join(first, "entry_key").filter((F.col("path") == F.col("f.path")) & (F.col("pos") == F.col("f.pos")))
        return Library.of(kept.groupBy("entry_key", "field").agg(F.max("value").alias("value")))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Library:
        return Library(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()})

    def save(self, path: str) -> None:
        """A new folder: snapshots aren't overwritten."""
        for n in SCHEMAS:
            getattr(self, n).write.parquet(f"{path}/{n}")

    def export_bib(self, path: str, keys: DataFrame | None = None) -> None:
        bib.write(self.entries if keys is None else self.entries.join(keys, "entry_key", "left_semi"), path)

    # --- queries

    def records(self, fields: list[str] | None = None) -> DataFrame:
        return rel.records(rel.live(self.entries), fields or [*entry_checks.FIELDS, "date", "journal", "school", "institution"])

    def find_entries(self, field: str, part: str | None = None) -> DataFrame:
        found = rel.find_by_group(self.groups, part or "") if field == "group" else rel.find_by_field(self.entries, field, part)
        return found.select("entry_key").distinct()

    def resolve_keys(self, keys: DataFrame) -> DataFrame:
        """key, entry_key: live keys as they are, aliases by the end of their chain, '' for others."""
        flat = graph.flatten(self.aliases).select(F.col("alias").alias("key"), "canonical")
        there = rel.live_keys(self.entries).select(F.col("entry_key").alias("key"), F.lit(True).alias("_live"))
        found = keys.select("key").distinct().join(there, "key", "left").join(flat, "key", "left")
        target = F.when(F.col("_live"), F.col("key")).otherwise(F.coalesce("canonical", F.lit("")))
        return found.select("key", target.alias("entry_key"))

    def show_entry(self, key: str) -> DataFrame:
        return self.entries.filter(F.col("entry_key") == key).select("field", "value")

    def statistics(self, **tables: DataFrame) -> DataFrame:
        """metric, value: the 21 numbers of upkeep.library_statistics(); tables that a library doesn't hold may be given, and count as empty otherwise."""
        spark, names = self.entries.sparkSession, F.col("field").isin("author", "editor")
        empty = {n: spark.createDataFrame([], s) for n, s in STATISTICS.items()}
        own = {"entries": rel.live(self.entries), "groups": self.groups, "contributors": self.people, "names": self.names, "hints": self.aliases}
        used = self.entries.filter(names & (F.col("value") != "")).select(F.explode(fn.split_names_braced(F.col("value"))).alias("name_used"))
        known = self.names.unionByName(self.people.select("id", "name")).groupBy("name").agg(F.min("id").alias("contributor_id"))
        own["used"] = used.join(known.withColumnRenamed("name", "name_used"), "name_used", "left")
        return upkeep.library_statistics({**empty, **own, **tables})

    def select(self, script: str) -> DataFrame:
        return rules.select(script, self.entries, self.groups)

    # --- rendering

    def render_as_bibtex(self, keys: DataFrame | None = None) -> DataFrame:
        return bib.rendered(self.entries if keys is None else self.entries.join(keys, "entry_key", "left_semi"))

    def _with_inherited(self) -> DataFrame:
        rows = self.records()
        return render.self_contained(rows, rows, [c for c in entry_checks.MUST_INHERIT if c in rows.columns])

    def render_as_html(self) -> DataFrame:
        return render.citation(self._with_inherited(), "html")

    def render_as_text(self) -> DataFrame:
        return render.citation(self._with_inherited(), "text")

    def render_group(self) -> DataFrame:
        return render.group_rows(self.groups, self.records())

    # --- edits

    def set_fields(self, changes: DataFrame) -> Library:
        """changes: entry_key, field, value; values are normalised, '' deletes, and no entry becomes its own parent."""
        clean = changes.select("entry_key", "field", fn.field_value(F.col("field"), F.col("value")).alias("value"))
        clean = clean.filter(~((F.col("field") == "crossref") & (F.col("value") == F.col("entry_key"))))
        return replace(self, entries=store.upsert(self.entries, clean, ["entry_key", "field"]).filter("value <> ''"))

    def delete_entries(self, keys: DataFrame) -> Library:
        gone = keys.select("entry_key")
        return replace(self, **{n: store.delete(getattr(self, n), gone, ["entry_key"]) for n in ("entries", "groups", "roles")})

    def add_to_groups(self, rows: DataFrame) -> Library:
        return replace(self, groups=store.insert_new(self.groups, rows.select("group_name", "entry_key").distinct(), ["group_name", "entry_key"]))

    def remove_from_groups(self, rows: DataFrame) -> Library:
        return replace(self, groups=store.delete(self.groups, rows.select("group_name", "entry_key"), ["group_name", "entry_key"]))

    def add_aliases(self, rows: DataFrame) -> Library:
        """An alias that is taken, or that is a live entry's key, is ignored; chains are flat afterwards."""
        fresh = rows.select("alias", "canonical").join(rel.live_keys(self.entries).withColumnRenamed("entry_key", "alias"), "alias", "left_anti")
        return replace(self, aliases=graph.flatten(store.insert_new(self.aliases, fresh, ["alias"])))

    def merge_entries(self, links: DataFrame) -> Library:
        """links: a, b.  Entries of a component become its smallest key, which keeps its values where it has them."""
        ids = store.cut(resolve.merge_map(links))
        moved = store.propagate(self.entries, "entry_key", ids)
        own = self.entries.join(ids.select(F.col("old").alias("entry_key")), "entry_key", "left_anti").select("entry_key", "field", F.col("value").alias("kept"))
        rows = moved.groupBy("entry_key", "field").agg(F.min("value").alias("value")).join(own, ["entry_key", "field"], "left").select("entry_key", "field", F.coalesce("kept", "value").alias("value"))
        old = ids.select(F.col("old").alias("alias"), F.col("new").alias("canonical"))
        return replace(
            self, entries=rows, groups=store.propagate(self.groups, "entry_key", ids).distinct(), roles=store.propagate(self.roles, "entry_key", ids).dropDuplicates(["entry_key", "role", "position"]), aliases=graph.flatten(store.insert_new(self.aliases, old, ["alias"]))
        )

    def merge_contributors(self, links: DataFrame | None = None) -> Library:
        """By equal ORCIDs, and by links (a, b)."""
        ids = store.cut(contributors.merge_by_orcid(self.people, links))
        aliases = self.names.unionByName(self.people.join(ids.select(F.col("old").alias("id")), "id", "left_semi").select("id", "name"))
        people = store.delete(self.people, ids.select(F.col("old").alias("id")), ["id"])
        return replace(self, people=people, names=contributors.apply_merges(aliases, ids, "id"), roles=contributors.apply_merges(self.roles, ids, "contributor_id"))

    # --- checks

    def check(self, settings: entry_checks.Settings | None = None) -> DataFrame:
        """entry_key, check, message of what the steps of the entry check leave to a person."""
        return entry_checks.check_entries(self.records(), settings)[1]

    def fix(self, settings: entry_checks.Settings | None = None) -> Library:
        """The steps of the entry check, written back as the fields that they changed; fields that became empty go."""
        fixed = entry_checks.check_entries(self.records(), settings)[0]
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in entry_checks.FIELDS])
        rows = fixed.select("entry_key", F.explode(pairs).alias("x")).select("entry_key", "x.field", "x.value")
        before = self.entries.select("entry_key", "field", F.col("value").alias("_old"))
        changed = rows.join(before, ["entry_key", "field"], "left").filter(F.col("value") != F.coalesce("_old", F.lit(""))).select("entry_key", "field", "value")
        return replace(self, entries=store.upsert(self.entries, changed, ["entry_key", "field"]).filter("value <> ''"))

    def with_preferred_aliases(self) -> Library:
        """Entries without a preferred alias, or with one of another shape, get one that nobody has; all preferred aliases are registered, and old ones stay so."""
        records = self.records(["entrytype", "author", "editor", "publisher", "year", "title", "dblp", "crossref", "preferredalias"])
        derived = store.cut(keys.derived_aliases(records, self.aliases, records))
        fields = derived.select("entry_key", F.lit("preferredalias").alias("field"), F.col("alias").alias("value"))
        every = self.entries.filter("field = 'preferredalias' AND value <> ''").select(F.col("value").alias("alias"), F.col("entry_key").alias("canonical"))
        every = every.unionByName(derived.select("alias", F.col("entry_key").alias("canonical")))
        return replace(self, entries=store.upsert(self.entries, fields, ["entry_key", "field"])).add_aliases(every.groupBy("alias").agg(F.min("canonical").alias("canonical")))

    def duplicates(self) -> DataFrame:
        titles = self.entries.filter("field = 'title'").join(rel.live_keys(self.entries), "entry_key", "left_semi")
        return resolve.title_buckets(titles.select("entry_key", F.col("value").alias("title")))

    def apply_rules(self, script: str) -> DataFrame:
        fields = self.entries.groupBy("entry_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
        held = self.groups.groupBy("entry_key").agg(F.collect_set("group_name").alias("groups"))
        return rules.apply_rules(fields.join(held, "entry_key", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>"))), script)

    # --- synchronisation

    def sync_status(self, other: Library, snapshot: Library) -> DataFrame:
        """entry_key, status of this library (right) and another (left) since a common snapshot, by content."""
        mark = lambda x: fn.fingerprint(x.entries)
        return store.three_way(mark(snapshot), mark(other), mark(self), "entry_key", "fingerprint")

    def harvest(self, other: Library) -> DataFrame:
        row = lambda x: x.records(["dblp", "title", "entrytype"]).select(F.col("entry_key").alias("key"), "dblp", "title")
        return resolve.harvest(row(other), row(self))
