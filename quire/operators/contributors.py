"""Contributors: people with ids, names and ORCIDs, in ordered roles.  Merges and splits are maps of ids, applied with one join for each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.normalise import first_last, forms
from quire.operators.graph import components


def by_orcid(contributors: DataFrame) -> DataFrame:
    """orcid, ids: ORCIDs of several contributors."""
    rows = contributors.filter("orcid <> ''").groupBy("orcid").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return rows.filter(F.size("ids") > 1)


def merge_by_orcid(contributors: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """old, new: contributors that share an ORCID, or are linked by extra (a, b), into the smallest id."""
    least = contributors.filter("orcid <> ''").groupBy("orcid").agg(F.min("id").alias("a"))
    links = contributors.join(least, "orcid").filter("id <> a").select("a", F.col("id").alias("b"))
    links = links if extra is None else links.unionByName(extra.select("a", "b"))
    return components(links, "a", "b").filter("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new"))


def apply_merges(rows: DataFrame, ids: DataFrame, column: str, distinct: bool = True) -> DataFrame:
    """rows with merged ids; what became equal is one row."""
    out = rows.join(ids.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).select(*rows.columns)
    return out.distinct() if distinct else out


def names_of(contributors: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, name: every name and alias, and the forms that follow from them."""
    both = contributors.select("id", "name").unionByName(aliases.select("id", "name"))
    return both.select("id", F.explode(forms(F.col("name"))).alias("name")).distinct()


def same_person(a: Column, b: Column) -> Column:
    """Two names are equal in either order of their parts."""
    return (F.lower(a) == F.lower(b)) | (F.lower(first_last(a)) == F.lower(first_last(b)))


def best_name(names: DataFrame) -> DataFrame:
    """id, name: the primary one, else one of the form 'Last, First', else the first in alphabetical order.  names has id, name, is_primary."""
    return names.groupBy("id").agg(F.min_by("name", F.struct(~F.col("is_primary"), ~F.col("name").contains(","), F.col("name"))).alias("name"))


def alias_mismatches(used: DataFrame, contributors: DataFrame) -> DataFrame:
    """entry_key, position, name_used, name where the name that was used isn't the contributor's."""
    return used.join(contributors.select(F.col("id").alias("contributor_id"), "name"), "contributor_id").filter("name_used <> name").select("entry_key", "position", "name_used", "name")


def unregistered(used: DataFrame, names: DataFrame) -> DataFrame:
    """name_used, contributor_id, n of used names that aren't registered for their contributor."""
    known = names.select(F.col("id").alias("contributor_id"), F.col("name").alias("name_used"))
    counts = used.groupBy("name_used", "contributor_id").agg(F.count("*").alias("n"))
    return counts.join(known, ["contributor_id", "name_used"], "left_anti").select("name_used", "contributor_id", "n")


def split(roles: DataFrame, publications: DataFrame, person: str, old: str, new: str) -> DataFrame:
    """Roles of contributor old go to new where the entry is among the person's publications (person, entry_key)."""
    theirs = publications.filter(F.col("person") == person).select("entry_key").distinct().withColumn("_theirs", F.lit(True))
    moved = roles.join(theirs, "entry_key", "left")
    return moved.withColumn("contributor_id", F.when((F.col("contributor_id") == old) & F.col("_theirs"), F.lit(new)).otherwise(F.col("contributor_id"))).select(*roles.columns)


def misattributed(roles: DataFrame, publications: DataFrame, persons: DataFrame) -> DataFrame:
    """contributor_id, entry_key: entries of contributors with a known person (id, person) that aren't among the person's publications."""
    mine = roles.join(persons.select(F.col("id").alias("contributor_id"), "person"), "contributor_id").select("contributor_id", "person", "entry_key").distinct()
    return mine.join(publications, ["person", "entry_key"], "left_anti").select("contributor_id", "entry_key")


def id_sequences(roles: DataFrame) -> DataFrame:
    """entry_key, role, ids in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "contributor_id")))
    return roles.groupBy("entry_key", "role").agg(F.transform(ordered, lambda x: x["contributor_id"]).alias("ids"))


def seed(names: DataFrame, contributors: DataFrame, prefix: str = "c") -> DataFrame:
    """id, name of contributors for names that nobody has, in any form; ids follow from the name, so that a run can be repeated."""
    known = contributors.select(F.explode(forms(F.col("name"))).alias("form")).distinct()
    fresh = names.select("name").distinct().withColumn("form", F.explode(forms(F.col("name"))))
    taken = fresh.join(known, "form", "left_semi").select("name").distinct()
    rows = fresh.join(taken, "name", "left_anti")
    # of the forms of one person the smallest name stands for all
    lead = rows.groupBy("form").agg(F.min("name").alias("lead"))
    chosen = rows.join(lead, "form").groupBy("name").agg(F.min("lead").alias("lead")).filter("name = lead")
    return chosen.select(F.concat(F.lit(prefix), F.substring(F.md5("name"), 1, 12)).alias("id"), "name")


def people(persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From person rows (person, names, canonical form): alias -> person without ambiguous ones, and alias -> canonical."""
    rows = persons.select("person", "canonical", F.explode("names").alias("alias"))
    key = rows.groupBy("alias").agg(F.when(F.min("person") == F.max("person"), F.min("person")).alias("person"), F.min("canonical").alias("canonical")).filter("person IS NOT NULL")
    return key.select("alias", "person"), key.filter("alias <> canonical").select("alias", "canonical")
