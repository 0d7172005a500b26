"""What a dump's persons tell about the library's contributors, all from one grouping.

Contributors and persons are nodes.  A contributor is linked to a person by the
person's key (the strongest evidence), by ORCID, or by a name that no other person has.  A group has at
most one person key and one ORCID, and contributors known to be different never meet.  What
follows from the groups: contributors to merge, keys and ORCIDs to set, names to
register; and from links that lead to another group: contributors that stand for two
persons, to be split by the publications of these, and ORCIDs that contradict each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.normalise import first_last, forms
from quire.operators.grouping import constrained_components
from quire.operators.store import cut

BY_KEY, BY_ORCID, BY_NAME = 1, 2, 3


@dataclass(frozen=True)
class Absorbed:
    """merges: old, new.  keys: id, person.  orcids: id, orcid.  names: id, name.  splits: id, person, other (the person it has, and another one's key).  conflicts: id, orcid, other (the ORCID it has, and the person's)."""

    merges: DataFrame
    keys: DataFrame
    orcids: DataFrame
    names: DataFrame
    splits: DataFrame
    conflicts: DataFrame


def person_forms(people: DataFrame) -> DataFrame:
    """person, form: names of persons (person, name) in both orders, without those of several persons."""
    name = F.trim("name")
    every = people.select("person", F.explode(F.array(name, first_last(name))).alias("form")).filter("form <> ''")
    return every.groupBy("form").agg(F.min("person").alias("person"), F.max("person").alias("last")).filter("person = last").select("person", "form")


def absorb(contributors: DataFrame, aliases: DataFrame, people: DataFrame, persons: DataFrame, different: DataFrame | None = None) -> Absorbed:
    """contributors: id, name, dblp_key, orcid; aliases: id, name; people: person, name; persons: person, orcid; different: a, b (ids).

    Empty keys, ORCIDs and names count as none, and take part in no join.  A merged
    contributor goes to the one of its group that has the person's key, else to the smallest id;
    ids that occur twice are one contributor, with the smallest key and ORCID.
    Joins are by merging: contributors and persons grow with the input, and stay off the driver.
    """
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    known = cut(contributors.groupBy(F.col("id").cast("string").alias("id")).agg(F.min(filled("dblp_key")).alias("key"), F.min(filled("orcid")).alias("orcid")))
    orcids = cut(persons.groupBy("person").agg(F.min(filled("orcid")).alias("orcid")).filter("orcid IS NOT NULL"))
    held = contributors.select(F.col("id").cast("string").alias("id"), "name").unionByName(aliases.select(F.col("id").cast("string").alias("id"), "name"))
    held = cut(held.filter("name <> ''").distinct())
    mine = held.select("id", F.explode(forms(F.col("name"))).alias("form")).filter("form <> ''").distinct()
    theirs = cut(person_forms(people))
    every = people.select("person").unionByName(persons.select("person")).distinct()
    by_key = known.filter("key IS NOT NULL").select("id", F.col("key").alias("person")).hint("merge").join(every, "person", "left_semi")
    owner = orcids.groupBy("orcid").agg(F.min("person").alias("person"), F.max("person").alias("last")).filter("person = last")
    by_orcid = known.filter("orcid IS NOT NULL").select("id", "orcid").hint("merge").join(owner, "orcid").select("id", "person")
    by_name = mine.hint("merge").join(theirs, "form").select("id", "person").distinct()
    level = lambda df, n: df.select("id", "person", F.lit(n).alias("level"))
    links = cut(level(by_key, BY_KEY).unionByName(level(by_orcid, BY_ORCID)).unionByName(level(by_name, BY_NAME)))
    # nodes: contributors with a c before them, persons with a p
    c, p = lambda x: F.concat(F.lit("c"), F.col(x).cast("string")), lambda x: F.concat(F.lit("p"), F.col(x))
    label = lambda df, node, kind, value: df.select(node.alias("node"), F.lit(kind).alias("kind"), F.col(value).alias("value"))
    labels = label(known.filter("key IS NOT NULL"), c("id"), "key", "key").unionByName(label(known.filter("orcid IS NOT NULL"), c("id"), "orcid", "orcid"))
    labels = labels.unionByName(label(every, p("person"), "key", "person")).unionByName(label(orcids, p("person"), "orcid", "orcid"))
    pairs = None if different is None else different.select(c("a").alias("a"), c("b").alias("b"))
    groups = cut(constrained_components(links.select(c("id").alias("a"), p("person").alias("b"), "level"), labels, pairs))
    # a group without a person has no link, and with two it would have two keys
    person = groups.filter(F.startswith("node", F.lit("p"))).select("root", F.substring("node", 2, 1 << 30).alias("person"))
    members = groups.filter(F.startswith("node", F.lit("c"))).select("root", F.substring("node", 2, 1 << 30).alias("id"))
    found = cut(members.hint("merge").join(person, "root").hint("merge").join(known, "id").select("id", "person", "key", "orcid"))
    best = found.groupBy("person").agg(F.min_by("id", F.struct(F.col("key").isNull(), F.col("id"))).alias("new"), F.max("key").alias("held"), F.max("orcid").alias("mine"))
    best = cut(best.hint("merge").join(orcids.withColumnRenamed("orcid", "theirs"), "person", "left"))
    merges = found.hint("merge").join(best.select("person", "new"), "person").filter("id <> new").select(F.col("id").alias("old"), "new")
    keys = best.filter("held IS NULL").select(F.col("new").alias("id"), "person")
    # of the one that stays: what a merged one or the person has, if it has none itself
    own = known.filter("orcid IS NOT NULL").select(F.col("id").alias("new"))
    set_ = best.filter("mine IS NOT NULL OR theirs IS NOT NULL").hint("merge").join(own, "new", "left_anti").select(F.col("new").alias("id"), F.coalesce("mine", "theirs").alias("orcid"))
    to_merge = merges.withColumnRenamed("old", "id")
    given = people.select("person", F.trim("name").alias("name")).hint("merge").join(best.select("person", F.col("new").alias("id")), "person").select("id", "name")
    given = given.unionByName(theirs.hint("merge").join(best.select("person", F.col("new").alias("id")), "person").select("id", F.col("form").alias("name")))
    given = given.unionByName(held.hint("merge").join(to_merge, "id").select(F.col("new").alias("id"), "name"))
    names = given.filter("name <> ''").distinct().hint("merge").join(held, ["id", "name"], "left_anti")
    elsewhere = links.hint("merge").join(found.select("id", F.col("person").alias("mine")), "id", "left").filter("mine IS NULL OR mine <> person")
    elsewhere = elsewhere.hint("merge").join(known, "id").hint("merge").join(orcids.withColumnRenamed("orcid", "theirs"), "person", "left")
    held_key = F.coalesce("mine", "key")
    splits = elsewhere.filter(held_key.isNotNull()).select("id", held_key.alias("person"), F.col("person").alias("other")).filter("person <> other").distinct()
    conflicts = elsewhere.filter("orcid <> theirs").select("id", "orcid", F.col("theirs").alias("other")).distinct()
    return Absorbed(merges, keys, set_, names, splits, conflicts)


def split_roles(roles: DataFrame, splits: DataFrame, publications: DataFrame, contributors: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributors that stand for two persons, taken apart by these persons' publications (person, entry_key): roles as they should be, and contributors (id, name, dblp_key) to add.

    A role of an entry that's among the other person's publications and not among those
    of the person that the contributor has goes to the other person's contributor: the one with
    its key, else a new one, whose id follows from the key.  An entry of several others
    goes to the smallest.  Without such entries nothing is split.
    """
    roles = roles.withColumn("contributor_id", F.col("contributor_id").cast("string"))
    pubs = publications.select("person", "entry_key").distinct()
    mine = roles.select("entry_key", F.col("contributor_id").alias("id")).distinct().join(splits.select("id", "person", "other"), "id")
    theirs = mine.join(pubs.withColumnRenamed("person", "other"), ["other", "entry_key"]).join(pubs, ["person", "entry_key"], "left_anti")
    moved = cut(theirs.groupBy("id", "entry_key").agg(F.min("other").alias("other")))
    holder = contributors.filter("dblp_key <> ''").groupBy(F.col("dblp_key").alias("other")).agg(F.min(F.col("id").cast("string")).alias("holder"))
    needed = cut(moved.select("other").distinct().join(holder, "other", "left").withColumn("new", F.coalesce("holder", F.concat(F.lit("dblp:"), "other"))))
    name = people.groupBy(F.col("person").alias("other")).agg(F.min(F.trim("name")).alias("name"))
    added = needed.filter("holder IS NULL").join(name, "other", "left").select(F.col("new").alias("id"), F.coalesce("name", "other").alias("name"), F.col("other").alias("dblp_key"))
    to = moved.join(needed, "other").select("entry_key", F.col("id").alias("contributor_id"), "new")
    return roles.join(to, ["entry_key", "contributor_id"], "left").withColumn("contributor_id", F.coalesce("new", "contributor_id")).select(*roles.columns), added
