"""Curation steps that combine the basic operators: names, mappings, aliases, contradictions, parents, export policies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.normalise import first_last, keywords, split_names_braced, title_index
from quire.operators.relational import lowest_of, lowest_parts, set_relation

#: Suffixes of names; fixed values.
SUFFIXES = ["jr", "jr.", "sr", "sr.", "ii", "iii", "iv"]


def garbled(name: Column) -> Column:
    """Why a name can't be right, or '': commas, braces that don't balance, a truncated accent, an ' and ' outside braces."""
    commas = F.length(F.regexp_replace(name, "[^,]", ""))
    second = F.lower(F.trim(F.get(F.split(name, ","), F.lit(1))))
    opened, closed = F.length(F.regexp_replace(name, r"[^{]", "")), F.length(F.regexp_replace(name, r"[^}]", ""))
    bare = F.regexp_replace(name, r"\{[^{}]*\}", "")
    return (
        F.when((commas > 2) | ((commas == 2) & ~second.isin(SUFFIXES)), "commas")
        .when(opened != closed, "braces")
        .when(bare.rlike(r"\\[`'^\"~=.]?\s*\z"), "accent")
        .when(bare.rlike(r"(?i)\sand\s"), "several")
        .otherwise("")
    )


def withdrawn(records: DataFrame) -> DataFrame:
    return records.filter(F.lower("publtype") == "withdrawn").select("record_key", "mdate")


def contradictions(aliases: DataFrame, hints: DataFrame) -> DataFrame:
    """key, alias_target, hint_target of strings that both tables (key, target) resolve, but differently."""
    return aliases.select("key", F.col("target").alias("alias_target")).join(hints.select("key", F.col("target").alias("hint_target")), "key").filter("alias_target <> hint_target")


def works_missing(works: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """orcid, doi of works that no entry's doi field and no doi alias (doi) has, ignoring case."""
    known = entries.filter("field = 'doi'").select(F.lower("value").alias("doi")).unionByName(aliases.select(F.lower("doi").alias("doi"))).distinct()
    return works.select("orcid", F.lower("doi").alias("doi")).distinct().join(known, "doi", "left_anti").select("orcid", "doi")


def map_values(entries: DataFrame, generic: DataFrame, specific: DataFrame) -> DataFrame:
    """entry_key, field, value after mappings: the generic one (field, challenger, winner) first, then the entry's own (entry_key, field, challenger, winner)."""
    g = generic.select("field", F.col("challenger").alias("value"), F.col("winner").alias("_g"))
    s = specific.select("entry_key", "field", F.col("challenger").alias("_v"), F.col("winner").alias("_s"))
    once = entries.join(g, ["field", "value"], "left").select("entry_key", "field", F.coalesce("_g", "value").alias("_v"))
    out = once.join(s, ["entry_key", "field", "_v"], "left").select("entry_key", "field", F.coalesce("_s", "_v").alias("value"))
    return out.withColumn("value", F.when((F.col("field") == "crossref") & (F.col("value") == F.col("entry_key")), "").otherwise(F.col("value")))


def alias_base(records: DataFrame) -> DataFrame:
    """entry_key, base: surname of the first author, else editor, else first word of publisher, else keyword of the title; then the year."""
    first = lambda f: F.get(split_names_braced(F.col(f)), F.lit(0))
    surname = lambda f: F.regexp_replace(F.element_at(F.split(first_last(first(f)), r"\s+"), -1), r"[^\p{L}]", "")
    words = keywords(F.col("title"))
    given = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    base = F.coalesce(given(surname("author")), given(surname("editor")), given(F.regexp_extract("publisher", r"([\p{L}]+)", 1)), given(F.get(words, F.lit(0))), F.lit("anon"))
    return records.select("entry_key", F.concat(base, F.coalesce("year", F.lit(""))).alias("base"))


def alias_proposals(records: DataFrame) -> DataFrame:
    """entry_key, rank, alias: the base with each keyword of the title, shorter keywords first."""
    words = F.array_sort(F.transform(keywords(F.col("title")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    base = alias_base(records)
    rows = records.join(base, "entry_key").select("entry_key", F.col("base"), F.posexplode(words).alias("i", "w"))
    return rows.select("entry_key", (F.col("i") + 1).alias("rank"), F.concat(F.col("base"), F.lit("-"), F.col("w.w")).alias("alias"))


def name_pairs(pairs: DataFrame) -> DataFrame:
    """Adds relation, and the positions at which two lists of one length differ; pairs has a and b, names joined by ' and '."""
    a, b = split_names_braced(F.col("a")), split_names_braced(F.col("b"))
    differing = F.filter(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, i: F.struct((i + 1).alias("position"), z["x"].alias("mine"), z["y"].alias("theirs"))), lambda z: ~z["mine"].eqNullSafe(z["theirs"]))
    return pairs.withColumn("relation", set_relation(a, b)).withColumn("differing", F.when(F.size(a) == F.size(b), differing))


def parent_candidates(children: DataFrame, parents: DataFrame) -> DataFrame:
    """entry_key, rule, parent: the child's own claim if that exists, else among parents of the same venue and year the lowest by volume, by the volume that the title names, or by the key's suffix - each only if every candidate has it."""
    numbers = parents.withColumns(
        {
            "_volume": F.col("volume").try_cast("int"),
            "_named": F.regexp_extract("title", r"(?i)\bvol(?:ume|\.)?\s+([0-9]+)", 1).try_cast("int"),
            "_suffix": F.regexp_extract("parent", r"-([0-9]+)\z", 1).try_cast("int"),
        }
    )
    own = children.join(parents.select(F.col("parent").alias("crossref")), "crossref", "left_semi").select("entry_key", F.lit("claim").alias("rule"), F.col("crossref").alias("parent"))
    rest = children.join(own.select("entry_key"), "entry_key", "left_anti").select("entry_key", "venue", "year")
    # parents of one venue and year are summed up before they meet its children
    rules = [("volume", F.col("_volume")), ("title", F.col("_named")), ("suffix", F.col("_suffix"))]
    same = rest.join(lowest_parts(numbers, ["venue", "year"], rules, "parent"), ["venue", "year"])
    best = lowest_of(same, "entry_key", rules, "parent")
    return own.unionByName(best.select("entry_key", F.when(F.col("rule") == "", "ask").otherwise(F.col("rule")).alias("rule"), F.coalesce("parent", F.lit("")).alias("parent")))


def fields_to_clear(library: DataFrame, file: DataFrame, keep: list[str]) -> DataFrame:
    """entry_key, field that the library has, a synchronised file of the same entry doesn't, and that aren't kept."""
    there = file.select("entry_key").distinct()
    rows = library.filter((F.col("value") != "") & ~F.col("field").isin(*keep)).join(there, "entry_key", "left_semi")
    return rows.join(file.filter("value <> ''"), ["entry_key", "field"], "left_anti").select("entry_key", "field")


def export_policy(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, url_needs_date: bool = True, date_in_note: bool = False) -> DataFrame:
    """Rows that an export has: chosen fields, a url only with its date, and the date as a note if wanted."""
    rows = entries.filter(F.col("field").isin(*include, "entrytype")) if include else entries
    rows = rows.filter(~F.col("field").isin(*exclude)) if exclude else rows
    dated = entries.filter("field = 'urldate' AND value <> ''").select("entry_key", F.col("value").alias("_date"))
    if url_needs_date:
        rows = rows.filter("field <> 'url'").unionByName(rows.filter("field = 'url'").join(dated, "entry_key", "left_semi").select(*rows.columns))
    if date_in_note:
        notes = rows.filter("field = 'note'").select("entry_key", F.col("value").alias("_note"))
        both = dated.join(notes, "entry_key", "left").select("entry_key", F.lit("note").alias("field"), F.concat_ws(". ", "_note", F.concat(F.lit("Accessed on "), F.col("_date"))).alias("value"))
        kept = rows.join(both.select("entry_key", "field"), ["entry_key", "field"], "left_anti").filter("field <> 'urldate'")
        rows = kept.select("entry_key", "field", "value").unionByName(both)
    return rows.select("entry_key", "field", "value")


def group_blocks(comments: DataFrame) -> DataFrame:
    """group_name, entry_key of the group blocks in comments (value): property lists of static groups, and lines of a grouping block."""
    listed = comments.filter(F.col("value").contains("<plist"))
    dicts = F.regexp_extract_all("value", F.lit(r"(?s)<dict>(.*?)</dict>"), 1)
    text = lambda d, k: F.regexp_extract(d, rf"(?s)<key>{k}</key>\s*<string>(.*?)</string>", 1)
    one = listed.select(F.explode(dicts).alias("d")).select(text(F.col("d"), "group name").alias("group_name"), text(F.col("d"), "keys").alias("keys"))
    lines = comments.filter(~F.col("value").contains("<plist")).select(F.explode(F.split("value", r"\n")).alias("line"))
    pattern = r"\A\s*[0-9]+ (?:ExplicitGroup|StaticGroup):(.+?)\\;[0-9]*\\;(.*?)(?:\\;)?;\s*\z"
    two = lines.filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 1).alias("group_name"), F.replace(F.regexp_extract("line", pattern, 2), F.lit("\\;"), F.lit(",")).alias("keys"))
    rows = one.unionByName(two).select("group_name", F.explode(F.split("keys", ",")).alias("k"))
    return rows.select("group_name", F.trim("k").alias("entry_key")).filter("group_name <> '' AND entry_key <> ''").distinct()


def overlaid(base: str, own: str, renamed: dict[str, str] | None = None) -> dict:
    """A configuration in JSON over another one; old names of keys are understood."""
    out: dict = {}
    for text in (base, own):
        for k, v in (json.loads(text) if text.strip() else {}).items():
            out[(renamed or {}).get(k, k)] = v
    return out


def unresolved_buckets(titles: DataFrame, known_different: DataFrame) -> DataFrame:
    """bucket, n, open: title buckets, and how many of their pairs aren't recorded as different.

    Counted from the bucket's size and its known pairs, so pairs are never made.
    """
    rows = titles.select("entry_key", title_index(F.col("title")).alias("bucket")).filter("bucket <> ''").distinct()
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = known_different.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    inside = pairs.join(rows.withColumnRenamed("entry_key", "a"), "a").join(rows.select(F.col("entry_key").alias("b"), F.col("bucket").alias("_b")), "b").filter("bucket = _b")
    known = inside.groupBy("bucket").agg(F.count("*").alias("k"))
    out = sizes.join(known, "bucket", "left").select("bucket", "n", (F.expr("n * (n - 1) div 2") - F.coalesce("k", F.lit(0))).alias("open"))
    return out.filter("open > 0")
