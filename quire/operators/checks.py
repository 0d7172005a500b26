"""Data-quality checks over records: one row per entry, a string column per field, '' where a field is absent.

Reports of single records, checks between records, and health of files and pages.  Repairs
and the order of an entry's checks are in entry_checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.relational import is_chapter, is_date, is_isbn, is_issn, is_year

#: Fields that the checks read; missing columns are taken as empty.
FIELDS = ["entrytype", "title", "booktitle", "year", "date", "doi", "url", "urldate", "isbn", "issn", "dblp", "eprint", "eprinttype", "note", "howpublished", "volume", "number", "chapter", "crossref", "series"]
#: Types that are books or collections, and those that refer to one; fixed values.
BOOKISH = ["book", "proceedings"]
CHAPTERS = {"inproceedings": "proceedings", "incollection": "book", "inbook": "book", "misc": "misc"}


def complete(records: DataFrame) -> DataFrame:
    """Adds missing columns, and makes nulls empty."""
    present = set(records.columns)
    others = [c for c in records.columns if c not in FIELDS]
    return records.select(*others, *[F.coalesce(F.col(f), F.lit("")).alias(f) if f in present else F.lit("").alias(f) for f in FIELDS])


def _reports() -> list[tuple[str, Column, Column]]:
    c = F.col
    none = lambda *names: F.concat(*map(F.col, names)) == ""
    return [
        ("no-type", c("entrytype") == "", F.lit("the entry has no type")),
        ("no-title", (c("title") == "") & ~c("entrytype").isin("misc"), F.lit("the title is missing")),
        ("no-year", none("year", "date") & (c("crossref") == ""), F.lit("the year is missing")),
        ("year", (c("year") != "") & ~is_year(c("year")), F.concat(F.lit("not a year: "), c("year"))),
        ("date", (c("date") != "") & ~is_date(c("date")), F.concat(F.lit("not a date: "), c("date"))),
        ("urldate", (c("urldate") != "") & ~is_date(c("urldate")), F.concat(F.lit("not a date: "), c("urldate"))),
        ("issn", (c("issn") != "") & ~is_issn(c("issn")), F.concat(F.lit("not an ISSN: "), c("issn"))),
        ("isbn", (c("isbn") != "") & ~is_isbn(c("isbn")), F.concat(F.lit("not an ISBN: "), c("isbn"))),
        ("chapter", (c("chapter") != "") & ~is_chapter(c("chapter")), F.concat(F.lit("not a chapter: "), c("chapter"))),
        ("eprint", (c("eprint") == "") != (c("eprinttype") == ""), F.lit("half of eprint and eprinttype is missing")),
        ("booktitle", c("entrytype").isin(*BOOKISH) & (c("booktitle") != "") & (c("title") != c("booktitle")), F.lit("title and booktitle differ")),
        ("url-without-date", (c("url") != "") & none("doi", "dblp", "isbn", "issn", "urldate"), F.lit("the URL is the only identifier and has no date")),
    ]


def warnings(records: DataFrame, key: str = "entry_key") -> DataFrame:
    """key, check, message of everything that's wrong."""
    found = F.array(*[F.when(when, F.struct(F.lit(name).alias("check"), text.alias("message"))) for name, when, text in _reports()])
    return complete(records).select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def crossref_types(children: DataFrame, parents: DataFrame) -> DataFrame:
    """entry_key, parent, message where a crossref leads nowhere or to a parent of the wrong type."""
    kind = F.create_map(*[F.lit(x) for p in CHAPTERS.items() for x in p])[F.col("entrytype")]
    given = parents.select(F.col("entry_key").alias("crossref"), F.col("entrytype").alias("_type"))
    rows = children.filter("crossref <> ''").join(given, "crossref", "left")
    message = F.when(F.col("_type").isNull(), "the parent doesn't exist").when(kind.isNull(), "this type has no parent").when(kind != F.col("_type"), F.concat(F.lit("the parent isn't a "), kind))
    return rows.withColumn("message", message).filter("message IS NOT NULL").select("entry_key", F.col("crossref").alias("parent"), "message")


def push_up(children: DataFrame, parents: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Children and parents after inheritance: a parent's empty field gets the smallest value that all of its children with
    one agree on, and children drop what equals their parent's.  One aggregate and one join for all fields."""
    value = lambda f: F.nullif(F.col(f), F.lit(""))
    pushed = children.filter("crossref <> ''").groupBy("crossref").agg(*[F.when(F.min(value(f)) == F.max(value(f)), F.min(value(f))).alias(f"_up_{f}") for f in fields])
    joined = parents.join(pushed.withColumnRenamed("crossref", "entry_key"), "entry_key", "left")
    above = joined.select(*[F.coalesce(value(f), F.col(f"_up_{f}"), F.lit("")).alias(f) if f in fields else F.col(f) for f in parents.columns])
    given = above.select(F.col("entry_key").alias("crossref"), *[F.col(f).alias(f"_given_{f}") for f in fields])
    below = children.join(given, "crossref", "left").select(*[F.when(F.col(f) == F.coalesce(F.col(f"_given_{f}"), F.lit("")), "").otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in children.columns])
    return below, above


def volumes(title: Column) -> tuple[Column, Column]:
    """Volume and edition that a title names."""
    return F.regexp_extract(title, r"(?i)\bvol(?:ume|\.)?\s+([0-9]+|[IVXLC]+)\b", 1), F.regexp_extract(title, r"(?i)\b([0-9]+(?:st|nd|rd|th)|first|second|third|fourth|fifth)\s+ed(?:ition|\.)", 1)


def dangling(tables: dict[str, tuple[DataFrame, str]], anchor: DataFrame, key: str) -> DataFrame:
    """table, key, rows: keys in dependent tables that the anchor doesn't have; each table is pre-aggregated before the join."""
    out = None
    for name, (rows, column) in tables.items():
        counts = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("rows"))
        one = counts.join(anchor.select(F.col(key).alias("key")).distinct(), "key", "left_anti").select(F.lit(name).alias("table"), F.col("key").cast("string").alias("key"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def magic(content: Column) -> Column:
    """pdf, html, postscript or other, by a file's first bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    return F.when(F.startswith(head, F.lit("%pdf-")), "pdf").when(F.startswith(head, F.lit("%!ps")), "postscript").when(head.rlike(r"\A\s*(?:<!doctype html|<html|<head)"), "html").otherwise("other")


#: What parked or vanished pages say; fixed values.
PARKED = ["domain is for sale", "buy this domain", "page not found", "404 not found", "parked free"]


def page_health(pages: DataFrame, key: str, html: str, least: int = 300) -> DataFrame:
    """key, status of landed pages: ok, too-small or parked; the whole page is looked at."""
    text = F.lower(F.coalesce(F.col(html), F.lit("")))
    parked = F.lit(False)
    for phrase in PARKED:
        parked = parked | F.contains(text, F.lit(phrase))
    return pages.select(key, F.when(F.octet_length(text) < least, "too-small").when(parked, "parked").otherwise("ok").alias("status"))
