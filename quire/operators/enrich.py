"""Enrichment from a bibliographic dump: its persons, records and title index against the library's contributors and entries.

Person maps are relations: names (name, person), orcids (orcid, person), canonical (person, name).  Look-ups are joins on
exploded forms of names; nothing is looked up one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.maps import Maps, dblp_to_latex
from quire.functions.normalise import bare_dblp_key, date, dblp_key, first_last, title_hash
from quire.operators.store import spread


def without_dblp(roles: DataFrame, entries: DataFrame) -> DataFrame:
    """contributor_id, entry_key of contributors' entries that have no dblp value."""
    keyed = entries.filter("field = 'dblp' AND value <> ''").select("entry_key")
    return roles.select("contributor_id", "entry_key").distinct().join(keyed, "entry_key", "left_anti").select("contributor_id", "entry_key")


def keyed_with_dblp(roles: DataFrame, entries: DataFrame, contributors: DataFrame) -> DataFrame:
    """contributor_id of contributors with a person (dblp_key) and an entry that has a dblp value."""
    keyed = entries.filter("field = 'dblp' AND value <> ''").select("entry_key")
    known = contributors.filter(F.coalesce("dblp_key", F.lit("")) != "").select(F.col("id").alias("contributor_id"))
    return roles.join(keyed, "entry_key", "left_semi").join(known, "contributor_id", "left_semi").select("contributor_id").distinct()


def expected_persons(authors: DataFrame, names: DataFrame, orcids: DataFrame) -> DataFrame:
    """record_key, person of a record's authors and editors (record_key, name, orcid): by ORCID, else by name."""
    by_orcid = orcids.groupBy("orcid").agg(F.min("person").alias("_o"))
    by_name = names.groupBy("name").agg(F.min("person").alias("_n"))
    who = authors.withColumn("_orcid", spread("orcid", F.struct("record_key", "name"))).withColumn("_name", spread("name", F.struct("record_key", "orcid")))
    found = who.join(by_orcid.withColumnRenamed("orcid", "_orcid"), "_orcid", "left").join(by_name.withColumnRenamed("name", "_name"), "_name", "left")
    return found.select("record_key", F.coalesce("_o", "_n").alias("person")).filter("person IS NOT NULL").distinct()


def _forms(people: DataFrame) -> DataFrame:
    """person, form: every name of a person, and its other order."""
    name = F.trim("name")
    return people.select("person", F.explode(F.array_distinct(F.array(name, first_last(name)))).alias("form")).filter("form <> ''").distinct()


def entry_matches(roles: DataFrame, contributors: DataFrame, links: DataFrame, expected: DataFrame, people: DataFrame) -> DataFrame:
    """contributor_id, entry_key, person, dblp_key: contributors (id, name, dblp_key) of linked entries (entry_key, record_key) whose name is that of an expected person other than theirs.

    Contributors whose own person is expected are right; names in braces aren't persons; of
    several persons of one name the smallest.
    """
    rows = roles.select("entry_key", "contributor_id").distinct().join(links.select("entry_key", "record_key"), "entry_key")
    known = contributors.filter(~F.startswith("name", F.lit("{"))).select(F.col("id").alias("contributor_id"), F.trim("name").alias("form"), F.coalesce("dblp_key", F.lit("")).alias("dblp_key"))
    rows = rows.join(known, "contributor_id")
    right = expected.select("record_key", F.col("person").alias("dblp_key"))
    wrong = rows.join(right, ["record_key", "dblp_key"], "left_anti")
    found = wrong.join(expected, "record_key").join(_forms(people), ["person", "form"])
    return found.filter("person <> dblp_key").groupBy("contributor_id", "entry_key").agg(F.min("person").alias("person"), F.min("dblp_key").alias("dblp_key"))


def unkeyed_persons(roles: DataFrame, contributors: DataFrame, links: DataFrame, authors: DataFrame, names: DataFrame, orcids: DataFrame) -> DataFrame:
    """contributor_id, person, entries: contributors without a person, and the persons that records name with exactly their name, with how many entries say so."""
    unkeyed = contributors.filter(F.coalesce("dblp_key", F.lit("")) == "").select(F.col("id").alias("contributor_id"), "name")
    rows = roles.select("entry_key", "contributor_id").distinct().join(unkeyed, "contributor_id").join(links, "entry_key")
    told = authors.filter("name <> ''").withColumn("_orcid", spread("orcid", F.struct("record_key", "name")))
    told = told.join(orcids.groupBy(F.col("orcid").alias("_orcid")).agg(F.min("person").alias("_o")), "_orcid", "left").join(names.groupBy("name").agg(F.min("person").alias("_n")), "name", "left")
    told = told.select("record_key", "name", F.coalesce("_o", "_n").alias("person")).filter("person IS NOT NULL")
    return rows.join(told, ["record_key", "name"]).groupBy("contributor_id", "person").agg(F.count_distinct("entry_key").alias("entries"))


def watched_missing(watched: DataFrame, names: DataFrame, orcids: DataFrame, contributors: DataFrame, publications: DataFrame, entries: DataFrame) -> DataFrame:
    """value, record_key: publications (person, record_key) of watched people (kind, value) that no entry's dblp value names."""
    by = lambda kind, rows: watched.filter(F.col("kind") == kind).select("value").join(rows, "value").select("value", "person")
    people = (
        by("name", names.select(F.col("name").alias("value"), "person"))
        .unionByName(by("orcid", orcids.select(F.col("orcid").alias("value"), "person")))
        .unionByName(by("contributor", contributors.select(F.col("id").cast("string").alias("value"), F.col("dblp_key").alias("person"))))
    )
    have = entries.filter("field = 'dblp'").select(bare_dblp_key(F.col("value")).alias("record_key"))
    return people.distinct().join(publications, "person").join(have, "record_key", "left_anti").select("value", "record_key").distinct()


def upgraded_watches(watched: DataFrame, orcids_of: DataFrame, contributors: DataFrame) -> DataFrame:
    """kind, value, comment of watches, each by the surest identifier that's known: a name becomes its ORCID (name, orcid), that its contributor (orcid, id); the comment keeps the name."""
    by_name = orcids_of.groupBy("name").agg(F.when(F.min("orcid") == F.max("orcid"), F.min("orcid")).alias("_orcid"))
    owner = contributors.filter("orcid <> ''").groupBy("orcid").agg(F.min("id").cast("string").alias("_id"))
    rows = watched.join(by_name.withColumnRenamed("name", "value"), "value", "left")
    rows = rows.withColumn("_o", F.when(F.col("kind") == "orcid", F.col("value")).when(F.col("kind") == "name", F.col("_orcid")))
    rows = rows.join(owner.withColumnRenamed("orcid", "_o"), "_o", "left")
    kind = F.when(F.col("_id").isNotNull(), "contributor").when(F.col("_o").isNotNull(), "orcid").otherwise(F.col("kind"))
    comment = F.coalesce(F.nullif("comment", F.lit("")), F.when(F.col("kind") == "name", F.col("value")), F.lit(""))
    return rows.select(kind.alias("kind"), F.coalesce("_id", "_o", "value").alias("value"), comment.alias("comment")).distinct()


def stale_marks(marks: DataFrame, entries: DataFrame) -> DataFrame:
    """entry_key, record_key of entries that were marked (entry_key, record_key) as lacking a record, and still do."""
    have = entries.filter("field = 'dblp'").select("entry_key", bare_dblp_key(F.col("value")).alias("record_key"))
    return marks.join(have, ["entry_key", "record_key"], "left_anti").select("entry_key", "record_key")


def candidates(entries: DataFrame, links: DataFrame, different: DataFrame) -> DataFrame:
    """entry_key, record_key: records of the title index (hash, record_key) with the title of an entry that has no dblp value, and that aren't recorded as different (entry_key, record)."""
    keyed = entries.filter("field = 'dblp' AND value <> ''").select("entry_key")
    titles = entries.filter("field = 'title'").join(keyed, "entry_key", "left_anti").select("entry_key", title_hash(F.col("value")).alias("hash")).filter("hash <> ''")
    found = titles.join(links, "hash").select("entry_key", "record_key", dblp_key(F.col("record_key")).alias("record")).distinct()
    return found.join(different.select("entry_key", "record").distinct(), ["entry_key", "record"], "left_anti").select("entry_key", "record_key")


def candidate_count(entries: DataFrame, links: DataFrame, different: DataFrame) -> DataFrame:
    """One row, n: entries with a candidate, of candidates(), whose pairs aren't made: an entry has one if its title has more records than are recorded as different from it."""
    keyed = entries.filter("field = 'dblp' AND value <> ''").select("entry_key")
    titles = entries.filter("field = 'title' AND entry_key IS NOT NULL").join(keyed, "entry_key", "left_anti").select("entry_key", title_hash(F.col("value")).alias("hash")).filter("hash <> ''").distinct()
    # records without a key are candidates that nothing is known about
    records = links.select("hash", dblp_key(F.col("record_key")).alias("record")).distinct()
    every = records.groupBy("hash").agg(F.count("*").alias("records"))
    known = different.select("entry_key", "record").distinct().join(titles, "entry_key").join(records, ["hash", "record"]).groupBy("entry_key", "hash").agg(F.count("*").alias("known"))
    left = titles.join(every, "hash").join(known, ["entry_key", "hash"], "left").filter("records > coalesce(known, 0)")
    return left.agg(F.count_distinct("entry_key").alias("n"))


def absorbed_names(contributors: DataFrame, people: DataFrame, known: DataFrame) -> DataFrame:
    """id, name: forms of their persons' names (person, name) that contributors (id, dblp_key) don't have yet (id, name); forms of several persons are left out."""
    forms = _forms(people)
    sure = forms.groupBy("form").agg(F.count_distinct("person").alias("n")).filter("n = 1").select("form")
    mine = contributors.select("id", F.col("dblp_key").alias("person")).join(forms.join(sure, "form", "left_semi"), "person").select("id", F.col("form").alias("name"))
    return mine.distinct().join(known.select("id", "name"), ["id", "name"], "left_anti")


def absorbed_orcids(contributors: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What persons (person, name, orcid) tell about contributors (id, name, dblp_key, orcid): new ORCIDs (id, orcid), and conflicts (id, orcid, other) to merge or ask about.

    A person is found by the contributor's key, else by its name, or by its name in
    the other order; what its own ORCID says needs no look-up.  An ORCID that another contributor has makes the two a conflict.
    """
    person = persons.filter(F.coalesce("orcid", F.lit("")) != "").select("person", F.trim("name").alias("_name"), F.col("orcid").alias("_orcid"))
    one = lambda rows, at: rows.select("id", "orcid", F.lit(at).alias("at"), F.col("_orcid").alias("found"))
    who = contributors.select("id", F.trim("name").alias("_mine"), F.coalesce("dblp_key", F.lit("")).alias("person"), F.coalesce("orcid", F.lit("")).alias("orcid"))
    alone = person.groupBy("_name").agg(F.when(F.min("_orcid") == F.max("_orcid"), F.min("_orcid")).alias("_orcid")).filter("_orcid IS NOT NULL")
    by_key = one(who.filter("person <> ''").join(person.drop("_name"), "person"), 1)
    named = who.filter("_mine <> ''")
    by_name = one(named.join(alone, F.col("_mine") == F.col("_name")), 2)
    by_swap = one(named.join(alone, first_last(F.col("_mine")) == F.col("_name")), 3)
    best = by_key.unionByName(by_name).unionByName(by_swap).groupBy("id", "orcid").agg(F.min_by("found", F.struct("at", "found")).alias("found"))
    fresh = best.filter("orcid = ''")
    owner = who.filter("orcid <> ''").groupBy(F.col("orcid").alias("found")).agg(F.min("id").alias("other"))
    clash = fresh.join(owner, "found").select("id", F.col("found").alias("orcid"), "other")
    differs = best.filter("orcid <> '' AND orcid <> found").select("id", F.col("found").alias("orcid"), F.col("id").alias("other"))
    return fresh.join(owner, "found", "left_anti").select("id", F.col("found").alias("orcid")), clash.unionByName(differs)


def profile_forms(profiles: DataFrame, seen: DataFrame) -> DataFrame:
    """contributor_id, name of ORCID profiles (contributor_id, credit_name, declared_name, other_names) that aren't those that were seen with the same content."""
    content = F.md5(F.concat_ws("\x1f", "credit_name", "declared_name", F.array_join(F.array_sort("other_names"), "\x1f")))
    new = profiles.withColumn("signature", content).join(seen.select("contributor_id", "signature"), ["contributor_id", "signature"], "left_anti")
    names = F.array_distinct(F.concat(F.array("credit_name", "declared_name"), "other_names"))
    return new.select("contributor_id", F.explode(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")).alias("name"))


def names_and_orcids(homepages: DataFrame, authors: DataFrame) -> DataFrame:
    """name, orcid: by homepage records (name, orcid) first, else by the authors of publications (name, orcid); '' of several."""
    sure = lambda rows, at: rows.filter(F.coalesce("orcid", F.lit("")) != "").groupBy("name").agg(F.when(F.min("orcid") == F.max("orcid"), F.min("orcid")).otherwise("").alias("orcid")).withColumn("at", F.lit(at))
    return sure(homepages, 1).unionByName(sure(authors, 2)).groupBy("name").agg(F.min_by("orcid", "at").alias("orcid"))


def data_record(records: DataFrame) -> DataFrame:
    """Records (record_key, entrytype, howpublished, note, urldate, mdate) where data sets are misc without howpublished, and their access date is that of the note, else the record's."""
    is_data = F.startswith("record_key", F.lit("data/"))
    told = date(F.regexp_extract("note", r"(?i)accessed on:?\s*(.+?)\.?\s*\z", 1))
    return records.withColumns(
        {
            "entrytype": F.when(is_data, "misc").otherwise(F.col("entrytype")),
            "howpublished": F.when(is_data, "").otherwise(F.col("howpublished")),
            "urldate": F.when(is_data & (told != ""), told).when(is_data & (F.col("urldate") == ""), F.col("mdate")).otherwise(F.col("urldate")),
            "note": F.when(is_data & (told != ""), F.trim(F.regexp_replace("note", r"(?i)[\s,;.(]*accessed on:?\s*.+\z", ""))).otherwise(F.col("note")),
        }
    )


#: Fields that an entry with a parent takes from it; fixed values.
INHERITED = ["booktitle", "year", "editor", "publisher", "volume", "number", "series", "address", "month", "edition", "issn", "isbn", "type", "organization"]


def record_fields(records: DataFrame, parents: DataFrame) -> DataFrame:
    """entry_key, field, value that a record (entry_key, entrytype, crossref, withdrawn, fields: map) offers to its entry.

    With a parent among parents (record_key, entry_key) the crossref is the parent's
    entry, and inherited fields go.  A withdrawn record offers its date and the author that stands for that.
    """
    known = parents.select(F.col("record_key").alias("_key"), F.col("entry_key").alias("_parent"))
    rows = records.withColumn("_key", spread("crossref", "entry_key")).join(known, "_key", "left")
    own = F.when(F.col("_parent").isNotNull(), F.map_filter("fields", lambda k, _: ~k.isin(INHERITED))).otherwise(F.col("fields"))
    gone = F.coalesce("withdrawn", F.lit("")) != ""
    more = F.array(
        F.struct(F.lit("entrytype").alias("key"), F.col("entrytype").alias("value")),
        F.struct(F.lit("crossref").alias("key"), F.coalesce("_parent", F.lit("")).alias("value")),
        F.struct(F.lit("withdrawn").alias("key"), F.coalesce("withdrawn", F.lit("")).alias("value")),
        F.struct(F.lit("author").alias("key"), F.when(gone, "{Withdrawn publication}").otherwise("").alias("value")),
    )
    kept = F.filter(F.map_entries(own), lambda x: ~(gone & (x["key"] == "author")))
    pairs = F.filter(F.concat(kept, more), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return rows.select("entry_key", F.explode(pairs).alias("x")).select("entry_key", F.col("x.key").alias("field"), F.col("x.value").alias("value"))


def to_latex(x: Column, maps: Maps | None = None) -> Column:
    """A value of the dump as TeX: entities, characters beyond ASCII, inline tags, and a bare & with its backslash; see functions.maps."""
    return dblp_to_latex(x, maps)


def compare_encoding(x: Column) -> Column:
    """TeX in one encoding: short accents, one-letter commands without outer braces, plain hyphens, and &, _, #, % as commands."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), r"\{(\\['`^\"~=.])\{([A-Za-z])\}\}", "{$1$2}")
    out = F.regexp_replace(out, r"\{(\\[A-Za-z]+)\{([A-Za-z])\}\}", "$1{$2}")
    out = F.replace(out, F.lit("{-}"), F.lit("-"))
    out = F.regexp_replace(out, r"\{\\c ([A-Za-z])\}", r"{\\c{$1}}")
    out = F.regexp_replace(out, r"(?<!\\)&", r"\\&")
    out = F.regexp_replace(F.regexp_replace(out, r"\{\\_\}|\\_", "_"), r"_(?!\{)", r"{\\_}")
    out = F.regexp_replace(F.regexp_replace(out, r"\{\\#\}|\\#", "#"), "#", r"{\\#}")
    return F.regexp_replace(F.regexp_replace(out, r"\{\\%\}|\\%", "%"), "%", r"{\\%}")


#: What titles of two sources write differently, in the order in which it's made one; fixed values.
TITLE_FORMS = [
    ("\\^{}", "^"), ("\\^", "^"), ("~", " "), ("\\textcopyright", "\\copyright"), ("\\textgreater", ">"), ("\\textless", "<"), ("\\texteuro", "\\euro"), ("\\texttildelow", "{\\~{}}"), ("\\textasciitilde", "{\\~{}}"),
    ("\\textasciiacute", "\\'{}"), ("\\texttimes", "\\(\\times\\)"), ("\\textdollar", "\\$"), ("\\textdegree", "{^\\circ}"), ("\\textsection", "\\S"), ("\\textsterling", "\\pounds"), ("\\texttheta", "\\theta"), ("\\textquestiondown", "?"),
    ("\\not =", "\\neq"), ("\\not=", "\\neq"), ("\\varepsilon", "\\epsilon"), ("\\,", ""), ("\\:", ""),
]


def compare_title(x: Column) -> Column:
    """A title in the form in which two sources are compared: carets, spaces, names of signs, and no thin spaces."""
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), TITLE_FORMS, F.coalesce(x, F.lit("")))


def compare_fallback(x: Column) -> Column:
    """What is tried on both sides when titles still differ: parentheses and punctuation go into braces, and a lone I is in braces."""
    out = reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), [("({", "{("), ("})", ")}"), (" I ", " {I} "), ("}.{", ".")], F.coalesce(x, F.lit("")))
    return F.regexp_replace(out, r"\}([:.;,]+)", "$1}")
