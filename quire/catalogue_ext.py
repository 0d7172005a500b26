"""More queries of the catalogue: predicates, look-ups, mappings, rankings and state on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import adapters as ad
from quire.catalogue import _HALVES, _INDEX, _PEOPLE, _halves, query
from quire.functions import normalise as fn
from quire.functions import tex
from quire.operators import checks, contributors, curation, lookups, resolve, store
from quire.operators import relational as rel
from quire.plans import rules
from quire.sources import bib, tables

_PART = "SELECT p_partkey, "


def _part(spark, sf, *columns):
    return ad.table(spark, sf, "part").select("p_partkey", *columns)


@query("SELECT doc_id, 'quality' AS property, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels")
def flt9_metadata(spark, sf):
    return lookups.properties(ad.table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


@query(_PART + "regexp_full_match(t, '[0-9]+') OR regexp_full_match(upper(t), 'M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})') AS chapter FROM (SELECT p_partkey, ['12', 'XIV', 'Xa1', 'IIII', 'VX', 'Xii', 'mcmxcix', 'IL'][1 + p_size % 8] AS t FROM part)")
def flt13_chapter(spark, sf):
    text = F.get(F.array(*map(F.lit, ["12", "XIV", "Xa1", "IIII", "VX", "Xii", "mcmxcix", "IL"])), F.col("p_size") % 8)
    return _part(spark, sf, rel.is_chapter(text).alias("chapter"))


@query(_PART + "p_partkey % 4 = 0 AS redundant, p_partkey % 2 <> 0 AS unequal FROM part")
def flt14_redundant_url(spark, sf):
    k = F.col("p_partkey")
    doi = F.when(k % 4 == 1, "").otherwise("10.1/aB")
    url = F.when(k % 4 == 0, "HTTPS://doi.org/10.1/AB").otherwise("https://doi.org/10.1/other")
    return _part(spark, sf, rel.redundant_url(url, doi).alias("redundant"), rel.evidently_unequal(F.lit("a"), F.when(k % 2 == 0, "").otherwise("b")).alias("unequal"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(nullif(text, ''), 'none ' || CAST(doc_id AS VARCHAR))) AS class, count(*) OVER (PARTITION BY coalesce(nullif(text, ''), 'none ' || CAST(doc_id AS VARCHAR))) AS size FROM documents")
def flt19_content_equal(spark, sf):
    return lookups.classes(ad.table(spark, sf, "documents"), "doc_id", F.coalesce("text", F.lit("")))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'braces' WHEN s_suppkey % 4 = 1 THEN 'several' WHEN s_suppkey % 4 = 2 THEN 'commas' ELSE '' END AS why FROM supplier")
def flt20_garbled(spark, sf):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat("s_name", F.lit("{"))).when(k == 1, F.concat("s_name", F.lit(" and B"))).when(k == 2, F.concat("s_name", F.lit(", B, C"))).otherwise(F.concat("s_name", F.lit(", Jr, B")))
    return ad.table(spark, sf, "supplier").select("s_suppkey", curation.garbled(name).alias("why"))


@query("SELECT c_name FROM customer WHERE contains(c_name, '00012') ORDER BY c_name LIMIT 9")
def flt22_key_search(spark, sf):
    return lookups.key_search(ad.table(spark, sf, "customer"), "c_name", "00012", 9)


@query("SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'pdf' WHEN regexp_matches(lower(left(html, 512)), '^\\s*(<!doctype html|<html|<head)') THEN 'html' ELSE 'other' END AS kind FROM pages")
def flt23_signature(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", checks.magic(F.encode("html", "UTF-8")).alias("kind"))


@query(ad.with_sql("e", "SELECT t.entry_key, t.value AS type, d.value AS dblp FROM e t JOIN e d ON t.entry_key = d.entry_key AND t.field = 'entrytype' AND d.field = 'dblp'"))
def join1_two_fields(spark, sf):
    found = rel.records(ad.entries(spark, sf), ["entrytype", "dblp"])
    return found.filter("entrytype <> '' AND dblp <> ''").select("entry_key", F.col("entrytype").alias("type"), "dblp")


@query("SELECT o_orderkey AS id, o_orderstatus AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join6_orphan_orders(spark, sf):
    used = ad.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return rel.orphans(used, ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name")), "id")


@query(ad.with_sql("r c", "SELECT entry_key, position, upper(name) AS name_used, name FROM r JOIN c ON contributor_id = id WHERE contributor_id % 2 = 0"))
def join9_alias_mismatch(spark, sf):
    people = ad.contributors(spark, sf)
    used = ad.roles(spark, sf).join(people, F.col("contributor_id") == F.col("id")).select("entry_key", "position", "contributor_id", F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name_used"))
    return contributors.alias_mismatches(used, people)


@query(ad.with_sql("r c", "SELECT upper(name) AS name_used, contributor_id, count(*) AS n FROM r JOIN c ON contributor_id = id WHERE contributor_id % 3 <> 0 GROUP BY ALL"))
def join10_unregistered(spark, sf):
    people = ad.contributors(spark, sf)
    used = ad.roles(spark, sf).join(people, F.col("contributor_id") == F.col("id")).select("contributor_id", F.upper("name").alias("name_used"))
    names = people.filter("id % 3 = 0").select("id", F.upper("name").alias("name"))
    return contributors.unregistered(used, names)


@query(f"SELECT a.p_partkey AS id, min(b.p_partkey) AS match FROM (SELECT p_partkey, {_INDEX.format('p_name')} AS i FROM part WHERE p_size <= 25) a JOIN (SELECT p_partkey, {_INDEX.format('p_name')} AS i FROM part WHERE p_size > 25) b ON a.i = b.i GROUP BY a.p_partkey")
def join17_title_hash(spark, sf):
    """Small parts with the smallest large part of their title index."""
    index = fn.title_index(F.col("p_name")).alias("i")
    rows = ad.table(spark, sf, "part")
    one = lambda when: rows.filter(when).select(F.col("p_partkey").alias("id"), index)
    return lookups.title_matches(one("p_size <= 25"), one("p_size > 25"), "i")


@query(f"""WITH t AS (SELECT 'document' AS kind, doc_id AS id, md5({_INDEX.format('text')}) AS h FROM documents UNION ALL SELECT 'benchmark', item_id, md5({_INDEX.format('text')}) FROM benchmark),
    m AS (SELECT h, min(id) AS first FROM t WHERE kind = 'document' AND h <> md5('') GROUP BY h) SELECT kind, id, first FROM t LEFT JOIN m ON t.h = m.h""")  # fmt: skip
def join17_title_classes(spark, sf):
    """Every document and benchmark item with the smallest document of its title index: two have a link when these are the same."""
    one = lambda name, key, kind: ad.table(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), fn.title_index(F.col("text")).alias("i"))
    return lookups.title_classes(one("documents", "doc_id", "document"), one("benchmark", "item_id", "benchmark"), "i")


@query("SELECT c_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def join21_children(spark, sf):
    parents = ad.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return lookups.children_of(ad.table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", parents)


@query("SELECT 'o' || CAST(user_id % 5 AS VARCHAR) AS orcid, '10.1/x' || CAST(user_id AS VARCHAR) AS doi FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0 AND user_id % 4 <> 0")
def join24_works_missing(spark, sf):
    users = ad.table(spark, sf, "events").select("user_id").distinct()
    doi = F.concat(F.lit("10.1/X"), F.col("user_id").cast("string"))
    works = users.select(F.concat(F.lit("o"), (F.col("user_id") % 5).cast("string")).alias("orcid"), doi.alias("doi"))
    return curation.works_missing(works, users.filter("user_id % 3 = 0").select(F.lit("k").alias("entry_key"), F.lit("doi").alias("field"), doi.alias("value")), users.filter("user_id % 4 = 0").select(doi.alias("doi")))


@query(ad.with_sql("a", "SELECT CAST(alias AS VARCHAR) AS key, CAST(canonical AS VARCHAR) AS alias_target, CAST(alias // 3 AS VARCHAR) AS hint_target FROM a WHERE canonical <> alias // 3"))
def join25_contradictions(spark, sf):
    rows = ad.aliases(spark, sf)
    text = lambda x: x.cast("string")
    return curation.contradictions(rows.select(text(F.col("alias")).alias("key"), text(F.col("canonical")).alias("target")), rows.select(text(F.col("alias")).alias("key"), text(F.expr("alias div 3")).alias("target")))


@query(ad.with_sql("r", "SELECT contributor_id, role, count(*) AS n FROM r GROUP BY ALL"))
def agg6_two_key_count(spark, sf):
    return lookups.pair_counts(ad.roles(spark, sf), "contributor_id", "role")


@query(ad.with_sql("g", "SELECT group_name, array_to_string(list_sort(list(DISTINCT CAST(entry_key AS VARCHAR))), ',') AS keys FROM g GROUP BY group_name"))
def agg11_group_index(spark, sf):
    return lookups.inverted(ad.groups(spark, sf), "group_name", "entry_key")


@query(f"""WITH b AS (SELECT p_partkey AS k, {_INDEX.format('p_name')} AS i FROM part), s AS (SELECT i, count(*) AS n FROM b GROUP BY i HAVING count(*) > 1),
    d AS (SELECT x.i, count(*) AS k FROM b x JOIN b y ON y.k = x.k // 2 AND x.i = y.i AND x.k > 1 GROUP BY x.i) SELECT s.i AS bucket, n, n * (n - 1) // 2 - coalesce(k, 0) AS open FROM s LEFT JOIN d USING (i) WHERE n * (n - 1) // 2 > coalesce(k, 0)""")  # fmt: skip
def agg12_unresolved_buckets(spark, sf):
    part = ad.table(spark, sf, "part")
    known = part.filter("p_partkey > 1").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
    return curation.unresolved_buckets(part.select(F.col("p_partkey").alias("entry_key"), F.col("p_name").alias("title")), known)


@query("SELECT text_md5 AS md5, n FROM (SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1")
def agg16_md5_groups(spark, sf):
    return lookups.digest_groups(ad.table(spark, sf, "documents"), "text")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'unchanged' ELSE 'both' END AS status FROM (SELECT DISTINCT user_id FROM events)) GROUP BY status")
def agg20_status_counts(spark, sf):
    users = ad.table(spark, sf, "events").select("user_id").distinct()
    side = lambda n: users.select("user_id", F.when(F.col("user_id") % 2 == 0, 0).otherwise(n).alias("v"))
    return store.three_way(side(1), side(2), side(3), "user_id", "v").groupBy("status").agg(F.count("*").alias("n"))


@query(_PEOPLE.replace("CAST(s_nationkey AS VARCHAR) AS orcid", "s_name AS name, s_nationkey AS g") + " SELECT g, arg_min(name, (id % 7 <> 0, name)) AS name FROM p GROUP BY g")
def win6_best_name(spark, sf):
    rows = ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7 == 0).alias("is_primary"))
    return contributors.best_name(rows).withColumnRenamed("id", "g")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def win2_first_local(spark, sf):
    return rel.first_wins(ad.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def sort4_distinct(spark, sf):
    return lookups.distinct_rows(ad.table(spark, sf, "part"), ["p_brand", "p_type"])


@query("SELECT p_partkey, replace('97' || CAST(p_partkey AS VARCHAR) || '-1', '-', '') AS isbn, '10.1/' || CAST(p_partkey AS VARCHAR) || '_x' AS doi, lpad(CAST(p_partkey AS VARCHAR), 7, '0')[1:4] || '-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')[5:7] || 'X' AS issn FROM part")
def fn5_identifiers(spark, sf):
    k = F.col("p_partkey").cast("string")
    return _part(
        spark, sf, fn.isbn_index(F.concat(F.lit("97"), k, F.lit("-1"))).alias("isbn"), fn.doi(F.concat(F.lit("https://dx.doi.org/10.1/"), k, F.lit("\\_x"))).alias("doi"), fn.issn(F.concat(F.lit("ISSN: "), F.lpad(k, 7, "0"), F.lit("X, 1"))).alias("issn")
    )


@query(_PART + "'b, c' || CASE WHEN p_size % 2 = 0 THEN ', d' ELSE '' END AS groups FROM part")
def fn12_groups(spark, sf):
    return _part(spark, sf, fn.group_list(F.concat(F.lit("c,, b ,c"), F.when(F.col("p_size") % 2 == 0, ",d").otherwise(""))).alias("groups"))


@query("SELECT s_suppkey, 'Ann B, ' || s_name || ', and C (eds.)' AS names, s_name || ' and others' AS tail, 'Doe, A.B.' AS initials FROM supplier")
def fn27_name_lists(spark, sf):
    names = F.concat(F.lit("B, Ann and {"), F.col("s_name"), F.lit("} and C"))
    plain = F.transform(fn.split_names_braced(names), lambda n: F.regexp_replace(fn.first_last(n), r"[{}]", ""))
    return ad.table(spark, sf, "supplier").select("s_suppkey", fn.name_list(plain, True).alias("names"), fn.et_al(F.concat("s_name", F.lit(" et al."))).alias("tail"), fn.compress_initials(F.lit("Doe, A. B.")).alias("initials"))


@query("SELECT s_suppkey, split_part(s_name, '#', 1) || CAST(1990 + s_nationkey AS VARCHAR) AS base FROM supplier")
def fn30_alias_base(spark, sf):
    rows = ad.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entry_key"), F.concat(F.split("s_name", "#").getItem(0), F.lit(", Ann and B, C")).alias("author"), F.lit("").alias("editor"), F.lit("").alias("publisher"), F.lit("x").alias("title"), (F.col("s_nationkey") + 1990).cast("string").alias("year")
    )
    return curation.alias_base(rows).withColumnRenamed("entry_key", "s_suppkey")


@query(_PART + "p_name || ' Gödel é' AS text, '2020-01-0' || CAST(p_size % 10 AS VARCHAR) AS day FROM part")
def fn38_unicode(spark, sf):
    key = F.concat(F.lit("EP-2020-01-0"), (F.col("p_size") % 10).cast("string"), F.lit("-01-02-03"))
    return _part(spark, sf, tex.to_unicode(F.concat("p_name", F.lit(' G{\\"o}del \\\'e'))).alias("text"), tex.key_time(key).alias("day"))


@query(_PART + "CASE WHEN p_size % 2 = 0 THEN 'austin, Texas, USA' ELSE 'austin, Ohio' END AS address FROM part")
def fn14_address(spark, sf):
    return _part(spark, sf, tex.location(F.when(F.col("p_size") % 2 == 0, "austin,{TX}").otherwise("austin , Ohio"), {"TX": "Texas"}, {"Texas": "USA"}).alias("address"))


@query(ad.with_sql("e", "SELECT entry_key, field, CASE WHEN field = 'title' AND contains(value, 'a') THEN CASE WHEN CAST(entry_key AS INT) % 2 = 0 THEN 'own' ELSE 'generic' END ELSE value END AS value FROM e"))
def fn31_mapped_values(spark, sf):
    rows = ad.entries(spark, sf)
    titles = rows.filter("field = 'title' AND contains(value, 'a')")
    generic = titles.select("field", F.col("value").alias("challenger"), F.lit("generic").alias("winner")).distinct()
    specific = titles.filter("CAST(entry_key AS INT) % 2 = 0").select("entry_key", "field", F.lit("generic").alias("challenger"), F.lit("own").alias("winner"))
    return curation.map_values(rows, generic, specific)


@query(_HALVES + " SELECT user_id, coalesce(c.value, o.value) AS value, coalesce(c.event_id, o.event_id) AS event_id FROM o FULL JOIN c USING (user_id)")
def dml4_coalesce_upsert(spark, sf):
    return store.coalesce_upsert(*_halves(spark, sf), ["user_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 3 <> 0")
def dml34_bulk_delete(spark, sf):
    gone = ad.table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return store.delete(ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, ["l_partkey"])


@query("""SELECT o_orderkey AS entry_key, 'claim' AS rule, CAST(o_custkey AS VARCHAR) AS parent FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
    SELECT o.o_orderkey, 'volume', CAST(m.k AS VARCHAR) FROM orders o JOIN (SELECT c_nationkey, arg_min(c_custkey, (CAST(abs(c_acctbal) AS INT), CAST(c_custkey AS VARCHAR))) AS k FROM customer GROUP BY c_nationkey) m ON m.c_nationkey = o.o_custkey % 25 WHERE o.o_orderkey % 3 <> 0""")  # fmt: skip
def res13_parent_candidates(spark, sf):
    parents = ad.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("parent"), F.col("c_nationkey").cast("string").alias("venue"), F.lit("1").alias("year"), F.rint(F.abs("c_acctbal")).cast("int").cast("string").alias("volume"), F.lit("").alias("title"))
    children = ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_key"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("crossref"), (F.col("o_custkey") % 25).cast("string").alias("venue"), F.lit("1").alias("year"))
    return curation.parent_candidates(children, parents)


@query(ad.with_sql("r", """SELECT entry_key, role, CASE WHEN bool_and(contributor_id % 2 = 0) THEN 'same' WHEN bool_and(contributor_id % 2 <> 0) AND count(DISTINCT contributor_id) = 1 AND count(*) = 1 THEN 'one' ELSE 'other' END AS kind FROM r GROUP BY entry_key, role"""))
def res15_author_triage(spark, sf):
    lists = contributors.id_sequences(ad.roles(spark, sf))
    changed = F.transform("ids", lambda x: F.when(x % 2 == 0, x).otherwise(-x))
    relation = resolve.author_lists(F.col("ids"), changed)
    kind = F.when(relation == "same", "same").when((relation == "one-differs") & (F.size("ids") == 1), "one").otherwise("other")
    return lists.select("entry_key", "role", kind.alias("kind"))


@query("SELECT DISTINCT CAST(k AS VARCHAR) AS entry_key FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1000 + n_regionkey FROM nation WHERE n_nationkey % 2 = 0)")
def dsl4_with_parents(spark, sf):
    nation = ad.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("entry_key"), (F.col("n_regionkey") + 1000).cast("string").alias("parent"))
    return rules.with_parents(nation.filter("CAST(entry_key AS INT) % 2 = 0").select("entry_key"), nation)


@query(ad.with_sql("e", "SELECT entry_key, field, value FROM e WHERE field IN ('title', 'entrytype')"))
def dsl5_export_policy(spark, sf):
    return curation.export_policy(ad.entries(spark, sf), include=["title"])


@query(ad.with_sql("e", "SELECT entry_key, field FROM e WHERE field IN ('dblp', 'title') AND CAST(entry_key AS INT) % 2 = 0"))
def syn3_fields_to_clear(spark, sf):
    rows = ad.entries(spark, sf)
    return curation.fields_to_clear(rows, rows.filter("field = 'year' AND CAST(entry_key AS INT) % 2 = 0"), ["entrytype"])


@query("SELECT user_id FROM events GROUP BY user_id HAVING CAST(max(ts) AS DATE) + INTERVAL 1 MONTH < DATE '2024-02-29'")
def inc5_stale(spark, sf):
    last = ad.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    return tables.stale(last, "at", F.lit("2024-02-29").cast("date")).select("user_id")


@query("SELECT CAST(alias AS VARCHAR) AS local, CAST(canonical AS VARCHAR) AS canonical FROM (SELECT p_partkey AS alias, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE p_partkey END AS canonical FROM part)")
def src25_keys_file(spark, sf):
    k = F.col("p_partkey")
    lines = ad.table(spark, sf, "part").select(F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" ; "), F.expr("p_partkey div 2").cast("string"), F.lit(" # c"))).otherwise(k.cast("string")).alias("value"))
    return bib.keys_file(lines)


@query("SELECT CAST(doc_id AS VARCHAR) AS entry_key, 'toxic' AS property, CAST(toxic AS VARCHAR) AS value FROM (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)")
def src23_metadata_round_trip(spark, sf):
    rows = ad.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").cast("string").alias("entry_key"), F.lit("toxic").alias("property"), F.col("toxic").cast("string").alias("value"))
    return tables.read_metadata(tables.metadata_json(rows))
