"""Citations from records, as text or HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.normalise import first_last, name_list, split_names_braced, to_html


def _people(x: Column, editors: bool = False) -> Column:
    return name_list(F.transform(split_names_braced(x), lambda n: first_last(n)), editors)


def sentences(*parts: Column) -> Column:
    """Non-empty parts joined by '. ', without doubling dots, and closed by one."""
    given = F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.regexp_replace(F.concat(F.array_join(F.transform(given, lambda x: F.regexp_replace(x, r"\.\z", "")), ". "), F.lit(".")), r"\A\.\z", "")


def citation(records: DataFrame, style: str = "html", key: str = "entry_key") -> DataFrame:
    """key, citation: a template for each type, over records with a column for each field."""
    present = set(records.columns)
    raw = lambda f: F.coalesce(F.col(f), F.lit("")) if f in present else F.lit("")
    html = style == "html"
    get = (lambda f: to_html(raw(f))) if html else (lambda f: F.regexp_replace(raw(f), r"[{}]", ""))
    emph = (lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("<em>"), x, F.lit("</em>")))) if html else (lambda x: x)
    quoted = lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("“"), F.regexp_replace(x, r"\.\z", ""), F.lit("”")))
    led = lambda label, x: F.when(x == "", "").otherwise(F.concat(F.lit(label), x))
    commas = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x != ""), ", ")
    authors, editors = _people(get("author")), _people(get("editor"), True)
    who = F.when(raw("author") != "", authors).otherwise(F.when(raw("editor") != "", editors).otherwise(""))
    pages = F.regexp_replace(raw("pages"), "--", "&ndash;" if html else "-")
    place = commas(F.when(raw("publisher") != "", get("publisher")).otherwise(get("organization")), get("address"), get("year"))
    volume = F.concat(get("volume"), F.when(raw("number") == "", "").otherwise(F.concat(F.lit("("), get("number"), F.lit(")"))), F.when(pages == "", "").otherwise(F.concat(F.lit(":"), pages)))
    inside = led("In: ", commas(F.when((raw("editor") != "") & (raw("author") != ""), editors).otherwise(""), emph(get("booktitle")), led("vol. ", get("volume")), get("series"), led("pp. ", pages)))
    kind = raw("entrytype")
    label = F.when(kind == "phdthesis", "PhD thesis").when(kind == "mastersthesis", "Master's thesis").otherwise("")
    body = (
        F.when(kind.isin("inproceedings", "incollection", "inbook"), sentences(who, quoted(get("title")), inside, place))
        .when(kind == "article", sentences(who, quoted(get("title")), commas(emph(get("journal")), volume, get("year"))))
        .when(kind == "book", sentences(who, emph(get("title")), F.when(raw("edition") == "", "").otherwise(F.concat(get("edition"), F.lit(" edition"))), place))
        .when(kind == "proceedings", sentences(who, emph(get("title")), F.when(raw("series") != "", commas(get("series"), led("vol. ", get("volume")))).otherwise(led("Vol. ", get("volume"))), place))
        .when(kind.isin("phdthesis", "mastersthesis"), sentences(who, quoted(get("title")), label, commas(get("school"), get("address"), get("year"))))
        .when(kind == "techreport", sentences(who, quoted(get("title")), F.concat(F.lit("Technical Report "), get("number")), commas(get("institution"), get("address"), get("year"))))
        .otherwise(sentences(who, quoted(get("title")), get("howpublished"), get("year")))
    )
    link = (lambda href, text: F.concat(F.lit('<a href="'), href, F.lit('">'), text, F.lit("</a>"))) if html else (lambda href, text: href)
    doi = F.when(raw("doi") == "", "").otherwise(link(F.concat(F.lit("https://doi.org/"), raw("doi")), raw("doi")))
    url = F.when(raw("url") == "", "").otherwise(link(raw("url"), raw("url")))
    return records.select(key, F.array_join(F.filter(F.array(body, url, doi), lambda x: x != ""), " ").alias("citation"))


def self_contained(children: DataFrame, parents: DataFrame, fields: list[str]) -> DataFrame:
    """Records with what they inherit filled in, for output without their parents."""
    from quire.operators.relational import inherit

    given = parents.select(F.col("entry_key").alias("crossref"), *fields)
    return inherit(children, given, "crossref", fields)


def group_rows(groups: DataFrame, records: DataFrame) -> DataFrame:
    """group_name, year, entry_key, dblp of every member, with its parent's dblp where it has none."""
    parents = records.select(F.col("entry_key").alias("crossref"), F.col("dblp").alias("_dblp"))
    rows = groups.join(records.select("entry_key", "year", "dblp", "crossref"), "entry_key").join(parents, "crossref", "left")
    return rows.select("group_name", "year", "entry_key", F.coalesce(F.nullif("dblp", F.lit("")), "_dblp", F.lit("")).alias("dblp"))
