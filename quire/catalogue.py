"""Queries over the driver's tables, one or more for each operator family, with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import adapters as ad
from quire.functions import normalise as fn
from quire.functions import render
from quire.operators import checks, contributors, graph, lookups, resolve, store
from quire.operators import relational as rel
from quire.plans import rules
from quire.sources import bib

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- filters


@query(ad.with_sql("e", "SELECT entry_key, value FROM e WHERE field = 'title' AND contains(lower(value), 'ring')"))
def flt1_find_by_field(spark, sf):
    return rel.find_by_field(ad.entries(spark, sf), "title", "Ring").select("entry_key", "value")


@query(ad.with_sql("g", "SELECT group_name, entry_key FROM g WHERE lower(group_name) = 'building'"))
def flt2_find_by_group(spark, sf):
    return rel.find_by_group(ad.groups(spark, sf), "Building")


@query(ad.with_sql("e", "SELECT entry_key, field, value FROM e SEMI JOIN (SELECT entry_key FROM e WHERE field = 'entrytype') t USING (entry_key)"))
def flt3_live_entries(spark, sf):
    return rel.live(ad.entries(spark, sf)).select("entry_key", "field", "value")


@query(ad.with_sql("e", """SELECT entry_key, coalesce(max(value) FILTER (field = 'title'), '') AS title, coalesce(max(value) FILTER (field = 'dblp'), '') AS dblp,
    coalesce(max(value) FILTER (field = 'entrytype'), '') AS entrytype FROM e GROUP BY entry_key"""))  # fmt: skip
def flt4_records(spark, sf):
    keys = ad.entries(spark, sf).select("entry_key").distinct()
    found = rel.records(ad.entries(spark, sf), ["title", "dblp", "entrytype"])
    return keys.join(found, "entry_key", "left").na.fill("")


@query(ad.with_sql("e", "SELECT DISTINCT field FROM e"))
def flt5_distinct_fields(spark, sf):
    return lookups.field_names(ad.entries(spark, sf))


@query(ad.with_sql("e", """SELECT x.entry_key, t.value AS type, x.field FROM e x JOIN e t ON x.entry_key = t.entry_key AND t.field = 'entrytype' AND x.field <> 'entrytype'
    WHERE NOT (x.field IN ('title', 'year') AND t.value LIKE 'e%') AND NOT (x.field = 'title')"""))  # fmt: skip
def flt6_illegal_fields(spark, sf):
    rows = ad.entries(spark, sf)
    kinds = rows.filter("field = 'entrytype'").select(F.col("value").alias("type")).distinct()
    allowed = kinds.select("type", F.explode(F.when(F.startswith("type", F.lit("e")), F.array(F.lit("title"), F.lit("year"))).otherwise(F.array(F.lit("title")))).alias("field"))
    return rel.illegal_fields(rows, allowed)


@query(ad.with_sql("e", """SELECT t.entry_key, t.value AS type, 'dblp' AS field FROM e t WHERE t.field = 'entrytype'
    AND NOT EXISTS (SELECT 1 FROM e x WHERE x.entry_key = t.entry_key AND x.field = 'dblp')"""))  # fmt: skip
def flt7_missing_fields(spark, sf):
    rows = ad.entries(spark, sf)
    required = rows.filter("field = 'entrytype'").select(F.col("value").alias("type")).distinct().select("type", F.lit("dblp").alias("field"))
    return rel.missing_fields(rows, required)


@query("""SELECT doc_id FROM labels WHERE quality = 1""")
def flt8_flag(spark, sf):
    return lookups.flagged(ad.table(spark, sf, "labels"), "doc_id", "quality")


_SHAPES = """WITH s AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS d, CAST(1900 + p_size AS VARCHAR) AS y FROM part)
SELECT k, regexp_full_match(d[1:4] || '-' || d[5:7] || CASE WHEN k % 3 = 0 THEN 'X' ELSE '' END, '[0-9]{4}-[0-9]{3}[0-9X]') AS issn,
regexp_full_match(y, '[0-9]{4}') AS year, regexp_full_match(y || '-0' || CAST(k % 12 AS VARCHAR) || '-01', '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date,
regexp_full_match('0000-000' || CAST(k % 11 AS VARCHAR) || '-' || d[1:4] || '-' || d[4:7], '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]') AS orcid FROM s"""


@query(_SHAPES)
def flt11_identifier_shapes(spark, sf):
    rows = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("d"), (F.col("p_size") + 1900).cast("string").alias("y"))
    issn = F.concat(F.substring("d", 1, 4), F.lit("-"), F.substring("d", 5, 3), F.when(F.col("k") % 3 == 0, "X").otherwise(""))
    day = F.concat("y", F.lit("-0"), (F.col("k") % 12).cast("string"), F.lit("-01"))
    orcid = F.concat(F.lit("0000-000"), (F.col("k") % 11).cast("string"), F.lit("-"), F.substring("d", 1, 4), F.lit("-"), F.substring("d", 4, 4))
    return rows.select("k", rel.is_issn(issn).alias("issn"), rel.is_year(F.col("y")).alias("year"), rel.is_date(day).alias("date"), rel.is_orcid(orcid).alias("orcid"))


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
    WHERE abs(year(a.o_orderdate) - year(b.o_orderdate)) < 3""")  # fmt: skip
def flt16_year_window(spark, sf):
    rows = ad.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias("y"))
    a, b = rows.select(F.col("o_orderkey").alias("a"), "o_custkey", F.col("y").alias("ya")), rows.select(F.col("o_orderkey").alias("b"), "o_custkey", F.col("y").alias("yb"))
    return a.join(b, "o_custkey").filter("a < b").filter(rel.within_years(F.col("ya"), F.col("yb"))).select("a", "b")


@query(ad.with_sql("e", """SELECT a.entry_key AS a, b.entry_key AS b, coalesce(x.value <> y.value, false) AS different
    FROM e a JOIN e b ON a.field = 'title' AND b.field = 'title' AND a.value = b.value AND a.entry_key < b.entry_key
    LEFT JOIN e x ON x.entry_key = a.entry_key AND x.field = 'dblp' LEFT JOIN e y ON y.entry_key = b.entry_key AND y.field = 'dblp'"""))  # fmt: skip
def flt18_different_publications(spark, sf):
    rows = rel.records(ad.entries(spark, sf), ["title", "dblp"])
    # the driver's tables have no doi, volume or book: they aren't carried through the pairs
    absent = {f"{x}_{c}": v for x in "ab" for c, v in (("doi", F.lit("")), ("volume", F.lit("")), ("book", F.lit(False)))}
    found = rel.pairs(rows.select("title", "entry_key", "dblp"), "title", "entry_key").withColumns(absent)
    return rel.different_publications(found).select(F.col("a_entry_key").alias("a"), F.col("b_entry_key").alias("b"), "different")


@query(ad.with_sql("g", "SELECT DISTINCT group_name FROM g WHERE regexp_full_match(group_name, '[BF][^/]*')"))
def flt21_group_glob(spark, sf):
    return rel.find_by_glob(ad.groups(spark, sf), "[BF]*").select("group_name").distinct()


# --- joins


@query(ad.with_sql("e", """SELECT a.entry_key AS key_a, b.entry_key AS key_b, a.value FROM e a JOIN e b ON a.field = 'dblp' AND b.field = 'dblp' AND a.value = b.value
    AND a.entry_key < b.entry_key WHERE EXISTS (SELECT 1 FROM e x WHERE x.entry_key = a.entry_key AND x.field = 'entrytype')
    AND EXISTS (SELECT 1 FROM e x WHERE x.entry_key = b.entry_key AND x.field = 'entrytype')"""))  # fmt: skip
def join2_duplicate_pairs(spark, sf):
    return rel.duplicate_pairs(ad.entries(spark, sf), "dblp")


@query(ad.with_sql("r c", "SELECT entry_key, role, string_agg(name, ' and ' ORDER BY position, name) AS names FROM r JOIN c ON contributor_id = id GROUP BY entry_key, role"))
def join3_role_names(spark, sf):
    return rel.name_lists(ad.roles(spark, sf), ad.contributors(spark, sf))


@query("""WITH k AS (SELECT least(p_partkey, p_partkey // 2) AS lo, greatest(p_partkey, p_partkey // 2) AS hi FROM part)
    SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, a.p_name AS name FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey
    WHERE NOT EXISTS (SELECT 1 FROM k WHERE lo = a.p_partkey AND hi = b.p_partkey)""")  # fmt: skip
def join5_same_name(spark, sf):
    part = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    known = part.select(F.col("id").alias("id_a"), F.expr("id div 2").alias("id_b"))
    return rel.same_names(part, known)


@query("""WITH f AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1),
    l AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
    SELECT f.user_id, f.value AS superseded, l.value AS winner FROM f JOIN l USING (user_id) WHERE f.value IS DISTINCT FROM l.value""")  # fmt: skip
def join7_superseded(spark, sf):
    events = ad.table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    first = rel.first_wins(events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("value").alias("superseded"))
    last = store.latest(events, "user_id", ["ts", "event_id"]).select("user_id", F.col("value").alias("winner"))
    return first.join(last, "user_id").filter(~F.col("superseded").eqNullSafe(F.col("winner")))


@query(ad.with_sql("r", """SELECT a.contributor_id AS id_a, b.contributor_id AS id_b, count(*) AS shared FROM (SELECT DISTINCT entry_key, role, contributor_id FROM r) a
    JOIN (SELECT DISTINCT entry_key, role, contributor_id FROM r) b ON a.entry_key = b.entry_key AND a.role = b.role AND a.contributor_id < b.contributor_id GROUP BY ALL"""))  # fmt: skip
def join8_coauthors(spark, sf):
    return rel.coauthors(ad.roles(spark, sf))


@query("""SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 1 OR c.text IS NULL OR c.text = '' THEN coalesce(p.text, '') ELSE c.text END AS text
    FROM conversations c LEFT JOIN (SELECT conv_id, min(text) AS text FROM conversations WHERE turn = 0 GROUP BY conv_id) p ON c.conv_id = p.conv_id""")  # fmt: skip
def join20_parent_inherit(spark, sf):
    turns = ad.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    parents = ad.table(spark, sf, "conversations").filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    return rel.inherit(turns, parents, "conv_id", ["text"])


@query("""SELECT c_custkey FROM customer ANTI JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01') o USING (c_custkey)""")
def join22_lone_parents(spark, sf):
    early = ad.table(spark, sf, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1993-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.orphans(early, ad.table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query(ad.with_sql("e", """SELECT g.entry_key, g.value, count(s.entry_key) AS live_siblings FROM e g
    LEFT JOIN e s ON s.field = 'dblp' AND s.value = g.value AND s.entry_key IN (SELECT entry_key FROM e WHERE field = 'entrytype')
    WHERE g.field = 'dblp' AND g.entry_key NOT IN (SELECT entry_key FROM e WHERE field = 'entrytype') GROUP BY g.entry_key, g.value"""))  # fmt: skip
def join27_ghosts(spark, sf):
    return rel.ghosts(ad.entries(spark, sf))


# --- aggregates, rankings, sets


@query(ad.with_sql("e", """SELECT count(*) AS entries, CAST(sum(live) AS BIGINT) AS live, CAST(sum(n) AS BIGINT) AS fields, round(100.0 * sum(live * dblp) / sum(live), 4) AS dblp_percent
    FROM (SELECT entry_key, count(*) AS n, max(CAST(field = 'entrytype' AS INT)) AS live, max(CAST(field = 'dblp' AS INT)) AS dblp FROM e GROUP BY entry_key)"""))  # fmt: skip
def agg3_statistics(spark, sf):
    return rel.statistics(ad.entries(spark, sf))


@query(ad.with_sql("e", """SELECT value, count(*) AS n, string_agg(entry_key, '|' ORDER BY entry_key) AS keys FROM e
    SEMI JOIN (SELECT entry_key FROM e WHERE field = 'entrytype') t USING (entry_key) WHERE field = 'title' GROUP BY value HAVING count(*) > 1"""))  # fmt: skip
def agg5_duplicate_groups(spark, sf):
    return rel.duplicate_groups(ad.entries(spark, sf), "title")


@query("SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def agg7_min_dedup(spark, sf):
    return lookups.least_of(ad.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


# The title index in SQL: letter commands, dropped characters, wrappers (those of them that nest aren't met here), case.
_STEPS = [("\\c ", ""), ("\\k ", ""), ("\\v ", ""), ("\\r ", ""), ("\\H ", ""), ("\\AA", "aa"), ("\\AE", "ae"), ("\\OE", "oe"), ("\\aa", "aa"), ("\\ae", "ae"), ("\\oe", "oe"), ("\\i", "i"), ("\\ss", "s"), ("\\ell", "l"), ("\\&", "&"), ("\\vert", "|")]
_WRAPPED = ["\\mathscr", "\\mathcal", "\\textit", "\\textbf", "\\mathbb", "\\mathbf", "\\mathit", "\\mathrm", "\\mbox", "\\hbox", "\\emph", "\\text", "\\"]


class _Index:
    """SQL of the title index of an expression."""

    @staticmethod
    def format(expression: str) -> str:
        out = f"regexp_replace(coalesce({expression}, ''), '\\\\unicode\\{{(x[0-9A-Fa-f]+|[0-9]+)\\}}', '', 'g')"
        for old, new in _STEPS:
            out = f"replace({out}, '{old}', '{new}')"
        out = f"translate({out}, '{{}}()$~.,\"''`^*=!?_-:;/| ', '')"
        out = f"replace(replace({out}, '\\backslash', '\\'), '\\textbackslash', '\\')"
        for old in _WRAPPED:
            out = f"replace({out}, '{old}', '')"
        return f"lower({out})"


_INDEX = _Index()


@query(f"""SELECT bucket, string_agg(DISTINCT entry_key, '|' ORDER BY entry_key) AS keys, count(DISTINCT entry_key) AS n FROM
    (SELECT CAST(doc_id AS VARCHAR) AS entry_key, {_INDEX.format('text')} AS bucket FROM documents) WHERE bucket <> '' GROUP BY bucket HAVING count(DISTINCT entry_key) > 1""")
def agg10_title_buckets(spark, sf):
    docs = ad.table(spark, sf, "documents")
    return resolve.title_buckets(docs.select(F.col("doc_id").cast("string").alias("entry_key"), F.col("text").alias("title")))


@query(ad.with_sql("r", """SELECT contributor_id, role, n FROM (SELECT contributor_id, role, count(*) AS n, row_number() OVER (PARTITION BY contributor_id ORDER BY count(*) DESC, role) AS k
    FROM r GROUP BY contributor_id, role) WHERE k = 1"""))  # fmt: skip
def agg14_most_frequent(spark, sf):
    return rel.most_frequent(ad.roles(spark, sf), "contributor_id", "role")


@query("SELECT p_name, count(DISTINCT p_brand) AS targets FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def agg17_ambiguous_names(spark, sf):
    return rel.ambiguous(ad.table(spark, sf, "part"), "p_name", "p_brand")


@query("SELECT p_name, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) ELSE '' END AS p_brand FROM part GROUP BY p_name")
def agg19_name_map(spark, sf):
    return rel.name_map(ad.table(spark, sf, "part"), "p_name", "p_brand")


@query("""SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n = 1""")
def win1_first_wins(spark, sf):
    return rel.first_wins(ad.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])


@query("""SELECT doc_id, CAST(i AS BIGINT) AS position, parts[i] AS name FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '') AS parts,
    unnest(range(1, len(list_filter(list_transform(regexp_split_to_array(text, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '')) + 1)) AS i FROM documents)""")  # fmt: skip
def win3_positions(spark, sf):
    return rel.positions(ad.table(spark, sf, "documents"), "doc_id", fn.split_names(F.col("text")))


@query("""SELECT p_brand, CASE WHEN bool_and(p_size % 10 <> 0) THEN 'size' WHEN bool_and(p_retailprice > 0) THEN 'price' ELSE '' END AS rule,
    CASE WHEN bool_and(p_size % 10 <> 0) THEN arg_min(p_partkey, (p_size, p_partkey)) WHEN bool_and(p_retailprice > 0) THEN arg_min(p_partkey, (p_retailprice, p_partkey)) END AS p_partkey
    FROM part GROUP BY p_brand""")  # fmt: skip
def win4_lowest_of_all(spark, sf):
    size = F.when(F.col("p_size") % 10 != 0, F.col("p_size"))
    price = F.when(F.col("p_retailprice") > 0, F.col("p_retailprice"))
    return rel.lowest_if_all(ad.table(spark, sf, "part"), "p_brand", [("size", size), ("price", price)], "p_partkey")


@query("""SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS kept FROM documents""")
def win7_keep_first(spark, sf):
    docs = ad.table(spark, sf, "documents").select("doc_id", "text")
    return resolve.content_duplicates(docs, "doc_id", [F.coalesce("text", F.lit(""))], ["doc_id"]).select("doc_id", "kept")


@query("""SELECT n.n_nationkey, n.n_name, 1 AS depth FROM nation n UNION ALL SELECT 1000 + r_regionkey, r_name, 0 FROM region""")
def win8_parents_first(spark, sf):
    nation = ad.table(spark, sf, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") + 1000).alias("parent"))
    region = ad.table(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(None).cast("int").alias("parent"))
    return rel.parents_first(nation.unionByName(region), "n_nationkey", "parent").select("n_nationkey", "n_name", "depth")


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events) WHERE rank <= 9""")
def sort3_top9(spark, sf):
    return rel.top_per_key(ad.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", [F.col("value").desc(), F.col("event_id")], 9).select("user_id", "event_id", "rank")


_SETS = """WITH s AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 5000)) AS a, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal < 0)) AS b FROM customer GROUP BY c_nationkey),
t AS (SELECT c_nationkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT c_nationkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS united, array_to_string(list_sort(list_intersect(a, b)), ',') AS common,
array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a,
CASE WHEN list_has_all(b, a) AND list_has_all(a, b) THEN 'equal' WHEN list_has_all(b, a) THEN 'subset' WHEN list_has_all(a, b) THEN 'superset' WHEN len(list_intersect(a, b)) = 0 THEN 'disjoint' ELSE 'mixed' END AS relation FROM t"""


@query(_SETS)
def set1_algebra(spark, sf):
    pick = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("c_mktsegment"))))
    sets = ad.table(spark, sf, "customer").groupBy("c_nationkey").agg(pick(F.col("c_acctbal") > 5000).alias("a"), pick(F.col("c_acctbal") < 0).alias("b"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return sets.select(
        "c_nationkey", text(F.array_union("a", "b")).alias("united"), text(F.array_intersect("a", "b")).alias("common"), text(F.array_except("a", "b")).alias("only_a"), rel.set_relation(F.col("a"), F.col("b")).alias("relation")
    )


@query("""SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand""")
def agg2_count_distinct(spark, sf):
    return lookups.distinct_values(ad.table(spark, sf, "part"), "p_brand", "p_name")


# --- functions


@query(f"SELECT doc_id, md5({_INDEX.format('text')}) AS hash FROM documents WHERE {_INDEX.format('text')} <> ''")
def fn1_title_hash(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", fn.title_hash(F.col("text")).alias("hash")).filter("hash <> ''")


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
    CASE WHEN starts_with(url, 'http://doi.org/') THEN 'https://doi.org/' || url[16:] ELSE url END AS url FROM pages""")  # fmt: skip
def fn6_url(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", fn.host(F.col("url")).alias("host"), fn.url(F.col("url")).alias("url"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 5 = 0 THEN '' ELSE '--' || CAST(p_size + p_size % 5 AS VARCHAR) END AS pages,
    CAST(p_size AS VARCHAR) || '--' || CAST(p_size + 3 AS VARCHAR) AS number FROM part""")  # fmt: skip
def fn11_pages(spark, sf):
    size = F.col("p_size").cast("string")
    raw = F.concat(size, F.lit("---"), (F.col("p_size") + F.col("p_size") % 5).cast("string"))
    return ad.table(spark, sf, "part").select("p_partkey", fn.pages(raw).alias("pages"), fn.number(F.concat(size, F.lit("-"), (F.col("p_size") + 3).cast("string"))).alias("number"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def fn8_date(spark, sf):
    return ad.table(spark, sf, "orders").select("o_orderkey", fn.date(F.date_format("o_orderdate", "MMMM d, y")).alias("day"))


@query("""SELECT s_suppkey, split_part(s_name, '#', 2) || ' ' || split_part(s_name, '#', 1) AS name FROM supplier""")
def fn24_name_inversion(spark, sf):
    return ad.table(spark, sf, "supplier").select("s_suppkey", fn.first_last(F.replace("s_name", F.lit("#"), F.lit(", "))).alias("name"))


_STOP = "'a', 'an', 'the', 'of', 'in', 'on', 'at', 'to', 'for', 'by', 'and', 'or', 'with', 'from', 'is', 'are', 'was', 'were', 'proceedings', 'workshop', 'conference', 'symposium', 'international', 'annual'"


@query(f"""SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[ :,./~(]+'), lambda x: regexp_replace({_INDEX.format('x')}, '[^a-z0-9]', '', 'g')),
    lambda y: y <> '' AND NOT list_contains([{_STOP}], y) AND NOT regexp_matches(y, '^[0-9]')))) AS INT) AS n FROM documents""")  # fmt: skip
def fn29_keywords(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", F.size(fn.keywords(F.col("text"))).alias("n"))


@query("""SELECT p_partkey, replace(replace(p_name, 'green', 'gr.'), 'a', 'A') AS name FROM part""")
def fn32_shorten(spark, sf):
    return ad.table(spark, sf, "part").select("p_partkey", fn.shorten(F.col("p_name"), [("green", "gr."), ("a", "A")]).alias("name"))


@query(ad.with_sql("e", "SELECT entry_key, md5(array_to_string(list_sort(list(field || '=' || value)), ';')) AS fingerprint FROM e WHERE value <> '' AND field <> 'year' GROUP BY entry_key"))
def fn41_fingerprint(spark, sf):
    return fn.fingerprint(ad.entries(spark, sf), noise=["year"])


# --- graphs


@query(ad.with_sql("a", "SELECT alias, arg_max(canonical, depth) AS canonical FROM w GROUP BY alias", "w(alias, canonical, depth) AS (SELECT alias, canonical, 1 FROM a UNION ALL SELECT w.alias, a.canonical, depth + 1 FROM w JOIN a ON w.canonical = a.alias)", recursive=True))
def grf1_alias_flatten(spark, sf):
    return graph.flatten(ad.aliases(spark, sf))


_CYCLE = "d AS (SELECT alias AS x, CASE WHEN alias % 50 = 0 THEN alias + 1 WHEN alias % 50 = 1 THEN alias - 1 ELSE canonical END AS y FROM a)"


def _cyclic(spark, sf):
    x = F.col("alias")
    return ad.aliases(spark, sf).select(x.alias("x"), F.when(x % 50 == 0, x + 1).when(x % 50 == 1, x - 1).otherwise(F.col("canonical")).alias("y"))


@query(ad.with_sql("a", "SELECT x AS node FROM d WHERE x NOT IN (SELECT x FROM w) ", _CYCLE + ", w(x) AS (SELECT x FROM d WHERE y NOT IN (SELECT x FROM d) UNION SELECT d.x FROM d JOIN w ON d.y = w.x)", recursive=True))
def grf6_cycles(spark, sf):
    return graph.on_cycles(_cyclic(spark, sf), "x", "y").select(F.col("x").alias("node"))


@query(ad.with_sql("a", "SELECT node FROM w", _CYCLE + ", w(node) AS (SELECT CAST(100 AS BIGINT) UNION SELECT d.y FROM d JOIN w ON d.x = w.node)", recursive=True))
def grf4_reachable(spark, sf):
    return graph.reachable(_cyclic(spark, sf), spark.range(100, 101).withColumnRenamed("id", "node"), "x", "y")


@query("""WITH b AS (SELECT p_partkey AS k, p_name || p_brand AS n FROM part), m AS (SELECT n, min(k) AS r FROM b GROUP BY n HAVING count(*) > 1) SELECT k AS node, r AS root FROM b JOIN m USING (n)""")
def grf7_components(spark, sf):
    rows = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", "p_brand").alias("n"))
    least = rows.groupBy("n").agg(F.min("k").alias("a"))
    return graph.components(rows.join(least, "n").select("a", F.col("k").alias("b")), "a", "b")


@query(ad.with_sql("a", "SELECT * FROM a WHERE canonical IN (SELECT alias FROM a)"))
def grf9_mapping_conflicts(spark, sf):
    return graph.mapping_conflicts(ad.aliases(spark, sf), "alias", "canonical")


# --- state


_HALVES = """WITH o AS (SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 2 = 0) WHERE n = 1),
c AS (SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0) WHERE n = 1)"""


def _halves(spark, sf):
    events = ad.table(spark, sf, "events").select("user_id", "value", "event_id")
    old = store.latest(events.filter("event_id % 2 = 0"), "user_id", ["event_id"])
    return old, store.latest(events.filter("event_id % 2 = 1 AND user_id % 3 = 0"), "user_id", ["event_id"])


@query(_HALVES + " SELECT user_id, value, event_id FROM o ANTI JOIN c USING (user_id) UNION ALL SELECT * FROM c")
def dml1_upsert(spark, sf):
    return store.upsert(*_halves(spark, sf), ["user_id"])


@query(_HALVES + " SELECT * FROM o UNION ALL SELECT user_id, value, event_id FROM c ANTI JOIN o USING (user_id)")
def dml3_insert_new(spark, sf):
    return store.insert_new(*_halves(spark, sf), ["user_id"])


@query(_HALVES + " SELECT user_id, value, event_id FROM o ANTI JOIN c USING (user_id)")
def dml2_delete(spark, sf):
    old, gone = _halves(spark, sf)
    return store.delete(old, gone.select("user_id"), ["user_id"])


@query(_HALVES + " SELECT o.user_id, coalesce(c.value, o.value) AS value, o.event_id FROM o LEFT JOIN c USING (user_id)")
def dml5_correlated_update(spark, sf):
    old, new = _halves(spark, sf)
    return store.correlated_update(old, new, ["user_id"], "value")


@query("""SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 2 = 0""")
def dml14_renormalise(spark, sf):
    rows = ad.table(spark, sf, "part").select("p_partkey", "p_name")
    return store.set_where(rows, "p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))


@query("""WITH m AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) SELECT l_orderkey, l_linenumber, m.k AS l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN m USING (p_name)""")
def dml8_propagate_merges(spark, sf):
    part = ad.table(spark, sf, "part")
    ids = part.join(part.groupBy("p_name").agg(F.min("p_partkey").alias("new")), "p_name").select(F.col("p_partkey").alias("old"), "new")
    return store.propagate(ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", ids)


_THREE = """WITH b AS (SELECT event_id, value FROM events WHERE event_id % 7 <> 0), l AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 11 <> 0),
r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 13 <> 0)"""


@query(_THREE + """ SELECT event_id, CASE WHEN b.event_id IS NULL THEN CASE WHEN r.event_id IS NULL THEN 'new-left' WHEN l.event_id IS NULL THEN 'new-right' ELSE 'new-both' END
    WHEN l.event_id IS NULL THEN CASE WHEN r.event_id IS NULL THEN 'deleted-both' ELSE 'deleted-left' END WHEN r.event_id IS NULL THEN 'deleted-right'
    WHEN l.value IS NOT DISTINCT FROM r.value THEN CASE WHEN b.value IS NOT DISTINCT FROM l.value THEN 'unchanged' ELSE 'same-change' END
    WHEN b.value IS NOT DISTINCT FROM l.value THEN 'right-changed' WHEN b.value IS NOT DISTINCT FROM r.value THEN 'left-changed' ELSE 'both' END AS status
    FROM b FULL JOIN l USING (event_id) FULL JOIN r USING (event_id)""")  # fmt: skip
def syn1_three_way(spark, sf):
    rows = ad.table(spark, sf, "events").select("event_id", "value")
    plus = lambda n: F.when(F.col("event_id") % n == 0, F.col("value") + 1).otherwise(F.col("value"))
    left, right = rows.filter("event_id % 11 <> 0").withColumn("value", plus(5)), rows.filter("event_id % 13 <> 0").withColumn("value", plus(3))
    return store.three_way(rows.filter("event_id % 7 <> 0"), left, right, "event_id", "value")


@query(ad.with_sql("g", """SELECT group_name, entry_key, CASE WHEN b AND s THEN 'remove-from-bib' WHEN b THEN 'add-to-db' WHEN s THEN 'remove-from-db' ELSE 'add-to-bib' END AS action
    FROM (SELECT group_name, entry_key, entry_key % 2 = 0 AS b, entry_key % 3 = 0 AS d, entry_key % 5 = 0 AS s FROM g) WHERE b <> d"""))  # fmt: skip
def syn2_group_merge(spark, sf):
    rows = ad.groups(spark, sf)
    return store.merge_memberships(rows.filter("entry_key % 2 = 0"), rows.filter("entry_key % 3 = 0"), rows.filter("entry_key % 5 = 0"), ["group_name", "entry_key"])


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def inc1_latest(spark, sf):
    return store.latest(ad.table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"]).drop("ts")


@query(_HALVES + " SELECT c.user_id, c.event_id FROM c LEFT JOIN o USING (user_id) WHERE o.event_id IS DISTINCT FROM c.event_id")
def inc1_changed(spark, sf):
    old, new = _halves(spark, sf)
    return store.changed(old, new, "user_id", "event_id").select("user_id", "event_id")


@query(_HALVES + " SELECT DISTINCT user_id FROM o ANTI JOIN c USING (user_id)")
def inc2_vanished(spark, sf):
    old, new = _halves(spark, sf)
    return store.vanished(old, new, "user_id")


# --- resolution, rules, rendering


@query("""WITH p AS (SELECT user_id, min(CAST(value AS INT)) AS a, max(CAST(value AS INT)) AS b FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN a = b THEN 'equal' WHEN user_id % 2 = 0 THEN 'lower-priority' ELSE 'auto-accept' END AS rule,
    CASE WHEN a = b OR user_id % 2 = 0 THEN CAST(a AS VARCHAR) ELSE CAST(b AS VARCHAR) END AS value, false AS needs_review FROM p""")  # fmt: skip
def res2_resolver(spark, sf):
    per = ad.table(spark, sf, "events").groupBy("user_id").agg(F.min(F.rint("value").cast("int")).alias("a"), F.max(F.rint("value").cast("int")).alias("b"))
    pairs = per.select(
        "user_id", F.lit("number").alias("field"), F.col("a").cast("string").alias("current"), F.col("b").cast("string").alias("challenger"),
        F.when(F.col("user_id") % 2 == 0, 100).otherwise(0).alias("current_priority"), F.lit(0).alias("challenger_priority"), F.lit(False).alias("edited"), F.lit(False).alias("required"),
    )
    return resolve.resolve_fields(pairs).select("user_id", "rule", "value", "needs_review")


@query(f"""WITH b AS (SELECT p_partkey AS k, {_INDEX.format('p_name')} AS i FROM part), m AS (SELECT i, min(k) AS r FROM b GROUP BY i) SELECT k AS old, r AS new FROM b JOIN m USING (i) WHERE k <> r""")
def res6_title_merges(spark, sf):
    titles = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("entry_key"), F.col("p_name").alias("title"))
    return resolve.merge_map(resolve.bucket_links(titles))


@query(f"""WITH l AS (SELECT p_partkey AS k, p_brand AS dblp, {_INDEX.format('p_name')} AS i FROM part),
    o AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN coalesce(p_brand, '') ELSE '' END AS dblp, {_INDEX.format("CASE WHEN o_orderstatus = 'P' THEN p_type ELSE p_name END")} AS i
        FROM orders LEFT JOIN o ON o_orderkey = l_orderkey LEFT JOIN part ON p = p_partkey)
    SELECT s.k AS source_key, CASE WHEN a.k IS NOT NULL THEN 'key' WHEN d.k IS NOT NULL THEN 'dblp' WHEN t.k IS NOT NULL THEN 'title' ELSE 'new' END AS rule,
    coalesce(CAST(coalesce(a.k, d.k, t.k) AS VARCHAR), '') AS entry_key FROM s LEFT JOIN l a ON s.k = a.k
    LEFT JOIN (SELECT dblp, min(k) AS k FROM l WHERE dblp <> '' GROUP BY dblp) d ON s.dblp = d.dblp LEFT JOIN (SELECT i, min(k) AS k FROM l WHERE i <> '' GROUP BY i) t ON s.i = t.i""")  # fmt: skip
def res7_harvest_orders(spark, sf):
    """Orders as sources, each with the first of its parts, against all parts as the library."""
    part, status = ad.table(spark, sf, "part"), F.col("o_orderstatus")
    first = ad.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
    rows = ad.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(first, "o_orderkey", "left").join(part, "p_partkey", "left")
    sources = rows.select(F.col("o_orderkey").alias("key"), F.when(status == "F", F.coalesce("p_brand", F.lit(""))).otherwise("").alias("dblp"), F.when(status == "P", F.col("p_type")).otherwise(F.col("p_name")).alias("title"))
    return resolve.harvest(sources, part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("dblp"), F.col("p_name").alias("title")))


SCRIPT = """
define early 1981 1982 1983
if field year in early and not type = "x" then add group "early" else add group "late"
if in group "early" and field dblp is empty then warn "no key"
if field year > 2010 then remove group "late"
"""


@query(ad.with_sql("e", """SELECT entry_key, array_to_string(CASE WHEN y IN (1981, 1982, 1983) THEN ['early'] WHEN y > 2010 THEN [] ELSE ['late'] END, ',') AS groups,
    CASE WHEN y IN (1981, 1982, 1983) AND d IS NULL THEN 'no key' ELSE '' END AS warnings FROM
    (SELECT entry_key, CAST(max(value) FILTER (field = 'year') AS INT) AS y, max(value) FILTER (field = 'dblp') AS d FROM e GROUP BY entry_key)"""))  # fmt: skip
def dsl1_rules(spark, sf):
    records = ad.entries(spark, sf).groupBy("entry_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields")).withColumn("groups", F.array().cast("array<string>"))
    return rules.apply_rules(records, SCRIPT).select("entry_key", F.array_join("groups", ",").alias("groups"), F.array_join("warnings", ",").alias("warnings"))


@query(ad.with_sql("e g", """SELECT CAST(entry_key AS VARCHAR) AS entry_key FROM g WHERE regexp_full_match(group_name, 'AUTO[^/]*') UNION SELECT entry_key FROM e WHERE field = 'title' AND contains(lower(value), 'ring')
    UNION SELECT entry_key FROM e WHERE entry_key IN ('1', '2')"""))  # fmt: skip
def dsl3_select(spark, sf):
    return rules.select('group "AUTO*"\nfield "title" "ring"\nkey "1" "2"', ad.entries(spark, sf), ad.groups(spark, sf))


@query(ad.with_sql("e", """SELECT t.entry_key, '@' || t.value || '{' || t.entry_key || ',' || chr(10) || string_agg('  ' || x.field || ' = {' || x.value || '}', ',' || chr(10) ORDER BY '  ' || x.field || ' = {' || x.value || '}') || chr(10) || '}' || chr(10) AS bibtex
    FROM e t JOIN e x ON t.entry_key = x.entry_key AND t.field = 'entrytype' AND x.field <> 'entrytype' GROUP BY t.entry_key, t.value"""))  # fmt: skip
def src33_bibtex(spark, sf):
    return bib.rendered(ad.entries(spark, sf))


@query(ad.with_sql("e", "SELECT entry_key, field, value FROM e SEMI JOIN (SELECT entry_key FROM e WHERE field = 'entrytype') t USING (entry_key)"))
def src1_bibtex_round_trip(spark, sf):
    """Live entries, rendered as BibTeX and scanned again."""
    texts = bib.rendered(ad.entries(spark, sf)).select(F.col("entry_key").alias("path"), F.col("bibtex").alias("text"))
    return bib.parse(texts).select("entry_key", "field", "value")


# --- checks, contributors, rendering


def _records(spark, sf):
    """Records from part: some with damaged fields."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return ad.table(spark, sf, "part").select(
        k.cast("string").alias("entry_key"), F.when(k % 5 == 0, "proceedings").when(k % 7 == 0, "").otherwise("inproceedings").alias("entrytype"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 3 == 0, (size + 1980).cast("string")).when(k % 3 == 1, F.concat(F.lit("'"), size.cast("string"))).otherwise("").alias("year"), F.when(k % 5 == 0, "").otherwise((F.floor(k / 5) * 5).cast("string")).alias("crossref"),
        F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("series"),
    )


_REC = """rec AS (SELECT CAST(p_partkey AS VARCHAR) AS entry_key, CASE WHEN p_partkey % 5 = 0 THEN 'proceedings' WHEN p_partkey % 7 = 0 THEN '' ELSE 'inproceedings' END AS entrytype,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 1980 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN '''' || CAST(p_size AS VARCHAR) ELSE '' END AS year,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey // 5 * 5 AS VARCHAR) END AS crossref, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS series FROM part)"""


@query(f"""WITH {_REC} SELECT entry_key, 'no-type' AS "check" FROM rec WHERE entrytype = '' UNION ALL SELECT entry_key, 'no-title' FROM rec WHERE title = ''
    UNION ALL SELECT entry_key, 'no-year' FROM rec WHERE year = '' AND crossref = '' UNION ALL SELECT entry_key, 'year' FROM rec WHERE year <> '' AND NOT regexp_full_match(year, '[0-9]{{4}}')""")  # fmt: skip
def chk2_warnings(spark, sf):
    return checks.warnings(_records(spark, sf)).select("entry_key", "check")


@query(f"""WITH {_REC} SELECT c.entry_key, c.crossref AS parent, CASE WHEN p.entry_key IS NULL THEN 'the parent doesn''t exist' WHEN c.entrytype = '' THEN 'this type has no parent' ELSE 'the parent isn''t a proceedings' END AS message
    FROM rec c LEFT JOIN rec p ON c.crossref = p.entry_key WHERE c.crossref <> '' AND (p.entry_key IS NULL OR c.entrytype = '' OR p.entrytype <> 'proceedings')""")  # fmt: skip
def chk8_crossref_types(spark, sf):
    rows = _records(spark, sf)
    return checks.crossref_types(rows, rows)


@query(f"""WITH {_REC}, up AS (SELECT crossref, CASE WHEN min(series) = max(series) THEN min(series) END AS s FROM rec WHERE crossref <> '' AND series <> '' GROUP BY crossref),
    p AS (SELECT r.entry_key, CASE WHEN r.series <> '' THEN r.series ELSE coalesce(s, '') END AS series FROM rec r LEFT JOIN up ON up.crossref = r.entry_key WHERE r.crossref = '')
    SELECT * FROM p UNION ALL SELECT c.entry_key, CASE WHEN c.series = coalesce(p.series, '') THEN '' ELSE c.series END FROM rec c LEFT JOIN p ON c.crossref = p.entry_key WHERE c.crossref <> ''""")  # fmt: skip
def chk8_inheritance(spark, sf):
    rows = _records(spark, sf)
    below, above = checks.push_up(rows.filter("crossref <> ''"), rows.filter("crossref = ''"), ["series"])
    return below.select("entry_key", "series").unionByName(above.select("entry_key", "series"))


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT 'orders' AS "table", CAST(l_orderkey AS VARCHAR) AS key, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (FROM o) GROUP BY l_orderkey
    UNION ALL SELECT 'parts', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (FROM o) GROUP BY l_partkey""")  # fmt: skip
def chk21_dangling(spark, sf):
    lines, anchor = ad.table(spark, sf, "lineitem"), ad.table(spark, sf, "orders").filter("o_orderkey % 4 <> 0").select("o_orderkey")
    return checks.dangling({"orders": (lines, "l_orderkey"), "parts": (lines, "l_partkey")}, anchor, "o_orderkey")


@query("""SELECT page_id, CASE WHEN strlen(coalesce(html, '')) < 300 THEN 'too-small' WHEN regexp_matches(lower(html), 'domain is for sale|buy this domain|page not found|404 not found|parked free') THEN 'parked' ELSE 'ok' END AS status FROM pages""")
def chk19_page_health(spark, sf):
    return checks.page_health(ad.table(spark, sf, "pages"), "page_id", "html")


_PEOPLE = "WITH p AS (SELECT s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS orcid FROM supplier)"


def _people(spark, sf):
    return ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("orcid"))


@query(_PEOPLE + " SELECT orcid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM p GROUP BY orcid HAVING count(*) > 1")
def agg15_by_orcid(spark, sf):
    return contributors.by_orcid(_people(spark, sf)).select("orcid", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(_PEOPLE + " SELECT p.id AS old, m.new FROM p JOIN (SELECT orcid, min(id) AS new FROM p GROUP BY orcid) m USING (orcid) WHERE p.id <> m.new")
def res10_orcid_merges(spark, sf):
    return contributors.merge_by_orcid(_people(spark, sf))


@query(ad.with_sql("r", "SELECT DISTINCT r.entry_key, r.role, r.position, m.new AS contributor_id FROM r JOIN (SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new FROM supplier) m ON r.contributor_id = m.id"))
def dml8_apply_merges(spark, sf):
    return contributors.apply_merges(ad.roles(spark, sf), contributors.merge_by_orcid(_people(spark, sf)), "contributor_id")


@query(ad.with_sql("r", "SELECT entry_key, role, string_agg(CAST(contributor_id AS VARCHAR), ',' ORDER BY position, contributor_id) AS ids FROM r GROUP BY entry_key, role"))
def res4_id_sequences(spark, sf):
    return contributors.id_sequences(ad.roles(spark, sf)).select("entry_key", "role", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(ad.with_sql("r", """SELECT DISTINCT r.contributor_id, r.entry_key FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.entry_key AND l.l_suppkey % 10 = r.contributor_id % 10 AND l.l_returnflag = 'R')"""))
def join13_misattributed(spark, sf):
    roles = ad.roles(spark, sf)
    persons = ad.contributors(spark, sf).select("id", (F.col("id") % 10).alias("person"))
    theirs = ad.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_suppkey") % 10).alias("person"), F.col("l_orderkey").alias("entry_key")).distinct()
    return contributors.misattributed(roles, theirs, persons)


@query("""SELECT p_partkey AS entry_key, '“' || p_name || '”. ' || CAST(p_size + 1980 AS VARCHAR) || '.' || CASE WHEN p_partkey % 2 = 0 THEN ' <a href="https://doi.org/10.1/' || CAST(p_partkey AS VARCHAR) || '">10.1/' || CAST(p_partkey AS VARCHAR) || '</a>' ELSE '' END AS citation FROM part""")
def rnd2_citation(spark, sf):
    k = F.col("p_partkey")
    rows = ad.table(spark, sf, "part").select(k.alias("entry_key"), F.lit("misc").alias("entrytype"), F.col("p_name").alias("title"), (F.col("p_size") + 1980).cast("string").alias("year"), F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"))
    return render.citation(rows)


@query(f"""WITH {_REC} SELECT g.c_mktsegment AS group_name, r.year, r.entry_key, CASE WHEN r.series <> '' THEN r.series ELSE coalesce(p.series, '') END AS dblp
    FROM (SELECT DISTINCT c_mktsegment, CAST(c_custkey AS VARCHAR) AS entry_key FROM customer) g JOIN rec r USING (entry_key) LEFT JOIN rec p ON r.crossref = p.entry_key""")  # fmt: skip
def rnd3_group(spark, sf):
    groups = ad.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("group_name"), F.col("c_custkey").cast("string").alias("entry_key")).distinct()
    return render.group_rows(groups, _records(spark, sf).withColumnRenamed("series", "dblp"))
