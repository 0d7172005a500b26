"""Preferred aliases of entries: surname, year and a keyword, as in bee2002graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.normalise import bare_dblp_key, keywords, split_names_braced, split_unbraced, title_index
from quire.operators.checks import BOOKISH
from quire.operators.relational import is_year
from quire.operators.resolve import free_alias
from quire.operators.store import spread

#: The shape of a preferred alias; a fixed value.
SHAPE = r"\A[a-z]+[0-9]{4}[a-z](?:[a-z0-9-]*[a-z0-9])?\z"


def _letters(x: Column) -> Column:
    return F.regexp_replace(title_index(x), r"[^a-z0-9]", "")


def bases(records: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """entry_key, base: a surname with the year; entries without a year, or without letters in the name, have none.

    The name is that of the first author, else editor, else the parent's, else the publisher, else the venue in the dblp
    key, else the title's first keyword.  Publisher and a year that isn't one are
    looked for in the parent too (parents: entry_key, author, editor, publisher, year).  A surname of digits
    alone is the end of an organisation's name, which then counts as a whole.
    """
    filled = lambda f: F.nullif(F.trim(F.coalesce(F.col(f), F.lit(""))), F.lit(""))
    above = ["author", "editor", "publisher", "year"]
    rows = records.select("entry_key", *[F.col(f) if f in records.columns else F.lit("").alias(f) for f in ("author", "editor", "publisher", "year", "title", "dblp", "crossref")])
    if parents is None:
        rows = rows.withColumns({f"_{f}": F.lit("") for f in above})
    else:
        given = parents.groupBy(F.col("entry_key").cast("string").alias("_key")).agg(*[F.min(f).alias(f"_{f}") for f in above])
        rows = rows.withColumn("_key", spread("crossref", "entry_key")).join(given, "_key", "left")
    parts = F.split(bare_dblp_key(F.col("dblp")), "/")
    venue = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    name = F.coalesce(*map(filled, ("author", "editor", "_author", "_editor", "publisher", "_publisher")), F.nullif(venue, F.lit("")), F.get(keywords(F.col("title")), F.lit(0)), F.lit(""))
    year = F.when(is_year(F.col("year")), F.col("year")).otherwise(F.col("_year"))
    rows = rows.select("entry_key", F.trim(F.get(split_names_braced(name), F.lit(0))).alias("first"), year.alias("y")).filter(is_year(F.col("y")))
    tokens = F.filter(split_unbraced(F.col("first")), lambda t: t != "")
    last = F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))
    surname = F.when(F.contains("first", F.lit(", ")), F.substring_index("first", ", ", 1)).when(last.rlike(r"\A[0-9]+\z"), F.col("first")).otherwise(last)
    rows = rows.withColumn("s", surname).filter(~F.contains("s", F.lit("\\unicode{"))).select("entry_key", _letters(F.col("s")).alias("s"), "y")
    return rows.filter("s <> ''").select("entry_key", F.concat("s", "y").alias("base"))


def proposals(records: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """entry_key, rank, alias, in the order in which they're tried.

    The venue in the dblp key of a book, single keywords of the title, two neighbours joined,
    three, and so on; last the last two parts of the dblp key.
    """
    words, parts = keywords(F.col("title")), F.split(bare_dblp_key(F.col("dblp")), "/")
    venue = F.when(F.col("entrytype").isin(*BOOKISH) & (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin("conf", "journals"), F.array(_letters(F.try_element_at(parts, F.lit(-2)))))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), ""))))
    suffix = F.when(F.coalesce("dblp", F.lit("")) != "", F.array(_letters(F.concat(F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(""), F.try_element_at(parts, F.lit(-1))))))
    none = F.array().cast("array<string>")
    tried = records.select("entry_key", words.alias("w"), F.coalesce(venue, none).alias("v"), F.coalesce(suffix, none).alias("x"))
    every = F.concat("v", F.when(F.size("w") > 0, runs).otherwise(none), "x")
    rows = tried.join(bases(records, parents), "entry_key").select("entry_key", "base", F.posexplode(every).alias("rank", "word"))
    return rows.select("entry_key", "rank", F.concat("base", "word").alias("alias")).filter(F.col("alias").rlike(SHAPE))


def derived_aliases(records: DataFrame, taken: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """entry_key, alias for entries whose preferredalias is missing or has another shape: the first proposal that isn't taken (alias, canonical) by another entry, nor by an entry before it.

    A preferred alias of the right shape is taken by its entry.  Entries without a free proposal give no row.
    """
    wanting = records.filter(~F.coalesce(F.col("preferredalias").rlike(SHAPE), F.lit(False)))
    held = records.filter(F.col("preferredalias").rlike(SHAPE)).select(F.col("preferredalias").alias("alias"), F.col("entry_key").alias("canonical"))
    others = held.unionByName(taken.select("alias", "canonical")).distinct()
    asked = proposals(wanting, parents)
    away = asked.join(others, "alias").filter(F.col("canonical") != F.col("entry_key")).select("entry_key", "rank")
    return free_alias(asked.join(away, ["entry_key", "rank"], "left_anti"))
