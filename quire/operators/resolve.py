"""Entity resolution: decisions as columns.  Where a person would be asked, needs_review is true and the current value stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.normalise import title_index
from quire.operators.graph import components
from quire.operators.relational import redundant_url
from quire.operators.store import cut


#: Fields in which a source's value is taken without asking; fixed values.
AUTO_ACCEPT = ["entrytype", "year", "pages", "doi", "number", "publisher", "series", "isbn", "issn", "month"]


def resolve_fields(pairs: DataFrame, auto_accept: list[str] | None = None) -> DataFrame:
    """Adds value, rule, needs_review to rows with field, current, challenger, current_priority, challenger_priority, edited, required.

    The first rule that applies decides; '' is an empty value.  Columns that say more are
    used where they're there: same_people (both lists name the same contributors), doi
    (the entry's), mapped (the value that a stored mapping gives for the two), evolved (the source has another
    value than when it was last seen), source (of the challenger, '' if unknown).
    """
    there = set(pairs.columns)
    extra = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in there else F.lit(default)
    cur, new = F.coalesce("current", F.lit("")), F.coalesce("challenger", F.lit(""))
    field, title = F.col("field"), F.col("field").isin("title", "booktitle")
    is_date = lambda x: x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    short = lambda a, b: F.startswith(a, F.lit("{")) & (F.octet_length(a) * 3 < F.octet_length(b))
    named = extra("source", "dblp") != ""
    mapped = extra("mapped", "")
    rules: list[tuple[str, Column, Column]] = [
        ("equal", cur == new, cur),
        ("same-people", field.isin("author", "editor") & extra("same_people", False), cur),
        ("nothing-new", new == "", cur),
        ("crossref-was-empty", (field == "crossref") & (cur == ""), new),
        ("crossref", field == "crossref", cur),
        ("earlier-date", field.isin("date", "urldate", "modificationdate", "creationdate") & (cur != "") & (is_date(cur) & is_date(new) | field.isin("modificationdate", "creationdate")), F.least(cur, new)),
        ("redundant-url", (field == "url") & redundant_url(new, extra("doi", "")), F.lit("")),
        ("groups", field == "groups", F.array_join(F.array_sort(F.filter(F.array_union(F.split(cur, r",\s*"), F.split(new, r",\s*")), lambda x: x != "")), ", ")),
        ("doi-case", (field == "doi") & (F.lower(cur) == F.lower(new)), F.when(F.lower(cur) == cur, new).otherwise(cur)),
        ("required", (cur == "") & F.col("required"), new),
        ("was-empty", cur == "", new),
        ("mapping", (mapped != "") & mapped.isin(cur, new), mapped),
        ("abbreviation", title & short(cur, new), new),
        ("abbreviation", title & short(new, cur), cur),
        ("lower-priority", F.col("challenger_priority") < F.col("current_priority"), cur),
        ("edited", F.col("edited") & ~extra("evolved", False), cur),
        ("same-index", (title_index(cur) == title_index(new)) & (~title | named), cur),
        ("auto-accept", named & field.isin(*(auto_accept or AUTO_ACCEPT)), new),
    ]
    # crossrefs that differ are asked about, and the current one stays
    rule, value = F.lit("ask"), cur
    for name, when, then in reversed(rules):
        when = F.coalesce(when, F.lit(False))
        rule, value = F.when(when, name).otherwise(rule), F.when(when, then).otherwise(value)
    return pairs.withColumn("value", value).withColumn("rule", rule).withColumn("needs_review", F.col("rule").isin("ask", "crossref"))


def title_buckets(titles: DataFrame) -> DataFrame:
    """bucket, keys (sorted), n of (entry_key, title) with one index; buckets of one and empty indexes are left out."""
    rows = titles.select("entry_key", title_index(F.col("title")).alias("bucket")).filter("bucket <> ''")
    return rows.groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_set("entry_key")), "|").alias("keys"), F.count_distinct("entry_key").alias("n")).filter("n > 1")


def merge_map(links: DataFrame) -> DataFrame:
    """old, new of entries (a, b) that are to be merged: each into the smallest of its component."""
    return components(links, "a", "b").filter("node <> root").select(F.col("node").alias("old"), F.col("root").alias("new"))


def bucket_links(titles: DataFrame) -> DataFrame:
    """a, b: every entry linked with the smallest of its title bucket, which connects it in linear size."""
    rows = titles.select("entry_key", title_index(F.col("title")).alias("bucket")).filter("bucket <> ''")
    least = rows.groupBy("bucket").agg(F.min("entry_key").alias("a"))
    return rows.join(least, "bucket").filter("entry_key <> a").select("a", F.col("entry_key").alias("b"))


def contributor_for(names: DataFrame, known: DataFrame, shared: DataFrame) -> DataFrame:
    """Chooses a contributor for (entry_key, name) among known (name, id): the only one, else the one with most shared entries.

    shared: entry_key, id, shared - what each candidate shares with the entry's sure contributors.  Ties go to the smallest id.
    """
    candidates = names.join(known, "name").join(shared, ["entry_key", "id"], "left")
    best = candidates.groupBy("entry_key", "name").agg(
        F.count_distinct("id").alias("n"), F.min_by("id", F.struct(-F.coalesce("shared", F.lit(0)), F.col("id"))).alias("id"), F.max(F.coalesce("shared", F.lit(0))).alias("most")
    )
    rule = F.when(F.col("n") == 1, "unambiguous").when(F.col("most") > 0, "co-authors").otherwise("first")
    return best.select("entry_key", "name", "id", rule.alias("rule"))


def harvest(sources: DataFrame, library: DataFrame) -> DataFrame:
    """source_key, rule, entry_key: by key, then by dblp, then by title index; 'new' without a match.

    Both have (key, dblp, title).  Of several matches by the winning rule the smallest key is taken.
    """
    lib = library.select(F.col("key").alias("entry_key"), "dblp", title_index(F.col("title")).alias("index"))
    src = sources.select(F.col("key").alias("source_key"), "dblp", title_index(F.col("title")).alias("index"))
    by_key = src.join(lib.select(F.col("entry_key")), F.col("source_key") == F.col("entry_key")).select("source_key", F.lit(1).alias("at"), "entry_key")
    by_dblp = src.filter("dblp <> ''").join(lib.groupBy("dblp").agg(F.min("entry_key").alias("entry_key")), "dblp").select("source_key", F.lit(2).alias("at"), "entry_key")
    by_title = src.filter("index <> ''").join(lib.groupBy("index").agg(F.min("entry_key").alias("entry_key")), "index").select("source_key", F.lit(3).alias("at"), "entry_key")
    best = by_key.unionByName(by_dblp).unionByName(by_title).groupBy("source_key").agg(F.min(F.struct("at", "entry_key")).alias("x"))
    rule = F.when(F.col("x.at") == 1, "key").when(F.col("x.at") == 2, "dblp").when(F.col("x.at") == 3, "title").otherwise("new")
    return src.select("source_key").join(best, "source_key", "left").select("source_key", rule.alias("rule"), F.coalesce(F.col("x.entry_key").cast("string"), F.lit("")).alias("entry_key"))


def content_duplicates(rows: DataFrame, key: str, content: list[Column], order: list[str]) -> DataFrame:
    """Adds kept: true for the first row, by order, of each content."""
    digest = F.md5(F.concat_ws("\x1f", *content))
    with_digest = rows.withColumn("_digest", digest)
    first = with_digest.groupBy("_digest").agg(F.min_by(key, F.struct(*order)).alias("_first"))
    return with_digest.join(first, "_digest").withColumn("kept", F.col(key) == F.col("_first")).drop("_digest", "_first")


def author_lists(a: Column, b: Column) -> Column:
    """How two lists of names relate: same, reordered, subset, superset, one-differs or mixed."""
    size = lambda x: F.size(x)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda z: z))
    only_a, only_b = size(F.array_except(a, b)), size(F.array_except(b, a))
    return (
        F.when(a == b, "same").when((only_a == 0) & (only_b == 0), "reordered").when(only_a == 0, "subset").when(only_b == 0, "superset").when((size(a) == size(b)) & (differ == 1), "one-differs").otherwise("mixed")
    )


def free_alias(proposals: DataFrame) -> DataFrame:
    """entry_key, alias: each entry gets the first of its proposals (entry_key, rank, alias) that nobody before it takes.

    In each round every entry without one proposes its next; the smallest entry_key
    wins an alias, the others go on, until no entry has a proposal left.
    """
    mine = Window.partitionBy("entry_key").orderBy("rank")
    waiting = cut(proposals.select("entry_key", "rank", "alias"))
    given = cut(waiting.select("entry_key", "alias").limit(0))
    while not waiting.isEmpty():
        asked = waiting.withColumn("_n", F.row_number().over(mine)).filter("_n = 1").drop("_n")
        won = cut(asked.groupBy("alias").agg(F.min("entry_key").alias("entry_key")).select("entry_key", "alias"))
        rest = waiting.join(won.select("entry_key"), "entry_key", "left_anti").join(won.select("alias"), "alias", "left_anti").select("entry_key", "rank", "alias")
        given, waiting = cut(given.unionByName(won)), cut(rest)
    return given
