"""Queries of upkeep, enrichment, look-ups, checks and functions, on relations made from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import adapters as ad
from quire.catalogue import _INDEX, query
from quire.functions import normalise as fn
from quire.operators import enrich, entry_checks, lookups, upkeep
from quire.plans import rules

c = F.col


def _t(spark, sf, name):
    return ad.table(spark, sf, name)


def _text(x):
    return (c(x) if isinstance(x, str) else x).cast("string")


def _orders_dblp(spark, sf):
    """Entries from orders: a dblp value where the status isn't F."""
    return _t(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(c("o_orderkey").alias("entry_key"), F.lit("dblp").alias("field"), F.concat(F.lit("DBLP:"), _text("o_orderkey")).alias("value"))


def _suppliers(spark, sf):
    """Contributors from suppliers: a person where the balance is positive."""
    key = F.when(c("s_acctbal") > 0, F.concat(F.lit("x"), _text("s_suppkey"))).otherwise("")
    return _t(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), key.alias("dblp_key"))


_S = "s AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'x' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS dblp_key FROM supplier)"
_D = "d AS (SELECT o_orderkey AS entry_key FROM orders WHERE o_orderstatus <> 'F')"


# --- enrichment


@query(ad.with_sql("r", "SELECT DISTINCT contributor_id, entry_key FROM r ANTI JOIN d USING (entry_key)", _D))
def join11_without_dblp(spark, sf):
    return enrich.without_dblp(ad.roles(spark, sf), _orders_dblp(spark, sf))


@query(ad.with_sql("r", "SELECT DISTINCT contributor_id FROM r JOIN d USING (entry_key) JOIN s ON contributor_id = id WHERE dblp_key <> ''", _D + ",\n" + _S))
def join12_keyed_with_dblp(spark, sf):
    return enrich.keyed_with_dblp(ad.roles(spark, sf), _orders_dblp(spark, sf), _suppliers(spark, sf))


def _records(spark, sf, flag):
    rows = _t(spark, sf, "lineitem").filter(c("l_returnflag") == flag).select(c("l_orderkey").alias("record_key"), c("l_suppkey").alias("id")).distinct()
    return rows.join(_t(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name")), "id").select("record_key", "id", "name", F.lit("").alias("orcid"))


def _persons(spark, sf):
    return _t(spark, sf, "supplier").select(F.concat(F.lit("p"), _text("s_suppkey")).alias("person"), c("s_name").alias("name"))


@query(ad.with_sql("r", """SELECT DISTINCT r.contributor_id, r.entry_key, 'p' || CAST(r.contributor_id AS VARCHAR) AS person, dblp_key FROM r JOIN s ON r.contributor_id = s.id
    JOIN lineitem ON l_orderkey = r.entry_key AND l_suppkey = r.contributor_id AND l_returnflag = 'A'""", _S))  # fmt: skip
def join16_entry_author_matches(spark, sf):
    authors, names = _records(spark, sf, "A"), _persons(spark, sf)
    none = names.select(c("name").alias("orcid"), "person").limit(0)
    roles = ad.roles(spark, sf)
    links = roles.select("entry_key").distinct().select("entry_key", c("entry_key").alias("record_key"))
    return enrich.entry_matches(roles, _suppliers(spark, sf), links, enrich.expected_persons(authors, names, none), names)


@query(ad.with_sql("r", """SELECT r.contributor_id, 'p' || CAST(r.contributor_id AS VARCHAR) AS person, count(DISTINCT r.entry_key) AS entries FROM r JOIN s ON r.contributor_id = s.id AND dblp_key = ''
    JOIN lineitem ON l_orderkey = r.entry_key AND l_suppkey = r.contributor_id AND l_returnflag = 'R' GROUP BY ALL""", _S))  # fmt: skip
def join14_unkeyed_persons(spark, sf):
    names = _persons(spark, sf)
    roles = ad.roles(spark, sf)
    links = roles.select("entry_key").distinct().select("entry_key", c("entry_key").alias("record_key"))
    return enrich.unkeyed_persons(roles, _suppliers(spark, sf), links, _records(spark, sf, "R"), names, names.select(c("name").alias("orcid"), "person").limit(0))


@query("""SELECT DISTINCT s_name AS value, CAST(l_orderkey AS VARCHAR) AS record_key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3
    AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")  # fmt: skip
def join23_watched_missing(spark, sf):
    names = _persons(spark, sf)
    watched = _t(spark, sf, "supplier").filter("s_nationkey = 3").select(F.lit("name").alias("kind"), c("s_name").alias("value"))
    publications = _t(spark, sf, "lineitem").select(F.concat(F.lit("p"), _text("l_suppkey")).alias("person"), _text("l_orderkey").alias("record_key"))
    entries = _orders_dblp(spark, sf)
    return enrich.watched_missing(watched, names, names.select(c("name").alias("orcid"), "person").limit(0), _suppliers(spark, sf), publications, entries)


@query("SELECT o_orderkey AS entry_key, CAST(o_custkey AS VARCHAR) AS record_key FROM orders WHERE o_orderstatus <> 'O'")
def join31_stale_marks(spark, sf):
    orders = _t(spark, sf, "orders")
    value = F.concat(F.lit("DBLP:"), F.when(c("o_orderstatus") == "O", _text("o_custkey")).otherwise("none"))
    return enrich.stale_marks(orders.select(c("o_orderkey").alias("entry_key"), _text("o_custkey").alias("record_key")), orders.select(c("o_orderkey").alias("entry_key"), F.lit("dblp").alias("field"), value.alias("value")))


@query(ad.with_sql("e", f"""SELECT count(DISTINCT t.entry_key) AS n FROM e t JOIN part p ON {_INDEX.format('t.value')} = {_INDEX.format('p.p_name')} AND p.p_size > 25 AND CAST(p.p_partkey AS VARCHAR) <> t.entry_key
    WHERE t.field = 'title' AND t.entry_key NOT IN (SELECT entry_key FROM e WHERE field = 'dblp')"""))  # fmt: skip
def agg13_candidate_count(spark, sf):
    part = _t(spark, sf, "part")
    links = part.filter("p_size > 25").select(fn.title_hash(c("p_name")).alias("hash"), _text("p_partkey").alias("record_key"))
    own = part.select(_text("p_partkey").alias("entry_key"), F.concat(F.lit("DBLP:"), _text("p_partkey")).alias("record"))
    return enrich.candidate_count(ad.entries(spark, sf), links, own)


@query("""WITH f AS (SELECT n_nationkey AS n, n_name || ', ' || r_name AS a, r_name || ' ' || n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey AS id, unnest([a, b]) AS name FROM supplier JOIN f ON s_nationkey = n WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, b FROM supplier JOIN f ON s_nationkey = n WHERE s_acctbal <= 0""")  # fmt: skip
def res8_absorbed_names(spark, sf):
    both = _t(spark, sf, "nation").join(_t(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    people = both.select(_text("n_nationkey").alias("person"), F.concat("n_name", F.lit(", "), "r_name").alias("name"))
    supplier = _t(spark, sf, "supplier")
    mine = supplier.select(c("s_suppkey").alias("id"), _text("s_nationkey").alias("dblp_key"))
    known = supplier.filter("s_acctbal <= 0").select(c("s_suppkey").alias("id"), _text("s_nationkey").alias("person")).join(people, "person").select("id", "name")
    return enrich.absorbed_names(mine, people, known)


@query("""WITH o AS (SELECT min(s_suppkey) AS k FROM supplier WHERE s_nationkey = 1)
    SELECT s_suppkey AS id, 'o' || CAST(s_nationkey AS VARCHAR) AS orcid, 0 AS other FROM supplier WHERE s_nationkey NOT IN (1, 2)
    UNION ALL SELECT s_suppkey, 'o1', s_suppkey FROM supplier WHERE s_nationkey = 1 UNION ALL SELECT s_suppkey, 'o2', k FROM supplier, o WHERE s_nationkey = 2 AND k IS NOT NULL
    UNION ALL SELECT s_suppkey, 'o2', 0 FROM supplier, o WHERE s_nationkey = 2 AND k IS NULL""")  # fmt: skip
def res9_absorbed_orcids(spark, sf):
    supplier = _t(spark, sf, "supplier")
    persons = supplier.select(F.concat(F.lit("x"), _text("s_suppkey")).alias("person"), c("s_name").alias("name"), F.concat(F.lit("o"), _text("s_nationkey")).alias("orcid"))
    orcid = supplier.select(c("s_suppkey").alias("id"), F.when(c("s_nationkey") == 1, "o2").otherwise("").alias("orcid"))
    new, conflicts = enrich.absorbed_orcids(_suppliers(spark, sf).join(orcid, "id"), persons)
    return new.withColumn("other", F.lit(0).cast("long")).unionByName(conflicts.withColumn("other", c("other").cast("long")))


@query("""WITH p AS (SELECT p_brand, min(p_partkey) AS k FROM part WHERE p_size > 40 GROUP BY p_brand),
    x AS (SELECT p_partkey AS entry_key, p_name, CAST(1980 + p_size AS VARCHAR) AS y, p_size, k FROM part LEFT JOIN p USING (p_brand))
    SELECT entry_key, 'title' AS field, p_name AS value FROM x UNION ALL SELECT entry_key, 'year', y FROM x WHERE k IS NULL UNION ALL SELECT entry_key, 'entrytype', 'inproceedings' FROM x
    UNION ALL SELECT entry_key, 'crossref', CAST(k AS VARCHAR) FROM x WHERE k IS NOT NULL UNION ALL SELECT entry_key, 'withdrawn', '2020-01-01' FROM x WHERE p_size = 1
    UNION ALL SELECT entry_key, 'author', CASE WHEN p_size = 1 THEN '{Withdrawn publication}' ELSE 'A' END FROM x""")  # fmt: skip
def res12_record_fields(spark, sf):
    part = _t(spark, sf, "part")
    parents = part.filter("p_size > 40").groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select(c("p_brand").alias("record_key"), _text("k").alias("entry_key"))
    fields = F.create_map(F.lit("title"), c("p_name"), F.lit("year"), _text(c("p_size") + 1980), F.lit("author"), F.lit("A"))
    rows = part.select(c("p_partkey").alias("entry_key"), F.lit("inproceedings").alias("entrytype"), c("p_brand").alias("crossref"), F.when(c("p_size") == 1, "2020-01-01").otherwise("").alias("withdrawn"), fields.alias("fields"))
    return enrich.record_fields(rows, parents)


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'misc' ELSE 'article' END AS entrytype, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'h' END AS howpublished,
    CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN '2020-02-03' ELSE '2019-01-01' END ELSE '' END AS urldate, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 'Set' ELSE 'Set.' END ELSE 'Set. Accessed on 3 February 2020.' END AS note FROM pages""")  # fmt: skip
def res17_data_records(spark, sf):
    k = c("page_id")
    note = F.when((k % 2 == 1) | (k % 4 == 0), "Set. Accessed on 3 February 2020.").otherwise("Set.")
    rows = _t(spark, sf, "pages").select("page_id", F.concat(F.when(k % 2 == 0, "data/").otherwise("journals/"), _text("page_id")).alias("record_key"), F.lit("article").alias("entrytype"), F.lit("h").alias("howpublished"), note.alias("note"), F.lit("").alias("urldate"), F.lit("2019-01-01").alias("mdate"))
    return enrich.data_record(rows).select("page_id", "entrytype", "howpublished", "urldate", "note")


@query("""WITH h AS (SELECT p_name AS name, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) ELSE '' END AS orcid FROM part WHERE p_size > 25 GROUP BY p_name),
    a AS (SELECT p_name AS name, CASE WHEN min(p_type) = max(p_type) THEN min(p_type) ELSE '' END AS orcid FROM part GROUP BY p_name) SELECT name, coalesce(h.orcid, a.orcid) AS orcid FROM a LEFT JOIN h USING (name)""")  # fmt: skip
def res14_names_and_orcids(spark, sf):
    part = _t(spark, sf, "part")
    return enrich.names_and_orcids(part.filter("p_size > 25").select(c("p_name").alias("name"), c("p_brand").alias("orcid")), part.select(c("p_name").alias("name"), c("p_type").alias("orcid")))


@query("""SELECT CASE WHEN s_nationkey < 5 THEN 'contributor' WHEN s_nationkey < 10 THEN 'orcid' ELSE 'name' END AS kind, CASE WHEN s_nationkey < 5 THEN CAST(s_suppkey AS VARCHAR) WHEN s_nationkey < 10 THEN 'o' || CAST(s_suppkey AS VARCHAR) ELSE s_name END AS value, s_name AS comment FROM supplier""")
def res19_upgraded_watches(spark, sf):
    supplier = _t(spark, sf, "supplier")
    orcid = F.concat(F.lit("o"), _text("s_suppkey"))
    watched = supplier.select(F.lit("name").alias("kind"), c("s_name").alias("value"), F.lit("").alias("comment"))
    return enrich.upgraded_watches(watched, supplier.filter("s_nationkey < 10").select(c("s_name").alias("name"), orcid.alias("orcid")), supplier.filter("s_nationkey < 5").select(c("s_suppkey").alias("id"), orcid.alias("orcid")))


@query("""SELECT l_suppkey AS contributor_id, unnest([n_name, 'X ' || n_name]) AS name FROM (SELECT DISTINCT l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def res11_profile_forms(spark, sf):
    rows = _t(spark, sf, "lineitem").select(c("l_suppkey").alias("s_suppkey")).distinct().join(_t(spark, sf, "supplier"), "s_suppkey").join(_t(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey"))
    profiles = rows.select(c("s_suppkey").alias("contributor_id"), c("n_name").alias("credit_name"), F.concat(F.lit("X "), "n_name").alias("declared_name"), F.array("n_name").alias("other_names"), "s_acctbal")
    signature = F.md5(F.concat_ws("\x1f", "credit_name", "declared_name", F.array_join("other_names", "\x1f")))
    return enrich.profile_forms(profiles.drop("s_acctbal"), profiles.filter("s_acctbal <= 0").select("contributor_id", signature.alias("signature")))


# --- upkeep


@query("SELECT DISTINCT p_brand AS id, CASE WHEN p_type = 'ECONOMY' THEN 'Economy' ELSE p_type END AS name FROM part")
def dml10_correct_name(spark, sf):
    rows = _t(spark, sf, "part").select(c("p_brand").alias("id"), c("p_type").alias("name"))
    return upkeep.correct_name({"names": (rows, "name")}, "ECONOMY", "Economy")["names"]


@query("""WITH v AS (SELECT s_suppkey AS entry_key, [s_name, n_name] AS ns FROM supplier JOIN nation ON s_nationkey = n_nationkey), p AS (SELECT entry_key, unnest(ns) AS name, unnest([1, 2]) AS position FROM v)
    SELECT entry_key, 'author' AS role, CAST(position AS BIGINT) AS position, CASE WHEN position = 1 THEN 's' || CAST(entry_key AS VARCHAR) ELSE 'c' || md5(name)[1:12] END AS contributor_id FROM p
    UNION ALL SELECT s_suppkey, 'editor', 1, 'kept' FROM supplier""")  # fmt: skip
def dml11_rewrite_roles(spark, sf):
    supplier = _t(spark, sf, "supplier")
    values = supplier.join(_t(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("entry_key"), F.concat("s_name", F.lit(" and "), "n_name").alias("value"))
    roles = supplier.select(c("s_suppkey").alias("entry_key"), F.explode(F.array(F.lit("author"), F.lit("editor"))).alias("role"), F.lit(1).cast("long").alias("position"), F.lit("kept").alias("contributor_id"))
    names = supplier.select(F.concat(F.lit("s"), _text("s_suppkey")).alias("id"), c("s_name").alias("name"))
    return upkeep.rewrite_roles(roles, values, names, "author")[0]


@query(ad.with_sql("r", "SELECT entry_key, role, position, coalesce(CASE WHEN position = 1 THEN s_suppkey + 100000 END, contributor_id) AS contributor_id FROM r LEFT JOIN supplier ON contributor_id = s_suppkey AND s_acctbal > 0"))
def dml12_reassign_by_orcid(spark, sf):
    roles = ad.roles(spark, sf)
    evidence = roles.filter("position = 1").select("entry_key", "role", "position", F.concat(F.lit("o"), _text("contributor_id")).alias("orcid"))
    owners = _t(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("o"), _text("s_suppkey")).alias("orcid"), (c("s_suppkey") + 100000).alias("contributor_id"))
    return upkeep.reassign_by_orcid(roles, evidence, owners)


@query(ad.with_sql("e", "SELECT entry_key, field, value, CASE WHEN field = 'dblp' THEN 'dblp' ELSE '' END AS source, CAST(field = 'dblp' AS INT) AS edited FROM e"))
def dml18_current_lineage(spark, sf):
    rows = ad.entries(spark, sf)
    lineage = rows.filter("field IN ('dblp', 'year')").select("entry_key", "field", F.when(c("field") == "year", F.concat("value", F.lit("?"))).otherwise(c("value")).alias("value"), F.lit("dblp").alias("source"), F.lit(1).alias("edited"))
    return upkeep.current_lineage(rows, lineage)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS alias, CASE WHEN p_brand = 'Brand#11' THEN 'moved' ELSE p_brand END AS canonical FROM part UNION ALL SELECT 'Brand#11', 'moved' WHERE EXISTS (SELECT 1 FROM part)""")
def dml24_name_mappings(spark, sf):
    rows = _t(spark, sf, "part").select(_text("p_partkey").alias("alias"), c("p_brand").alias("canonical"))
    return upkeep.map_names(rows, spark.createDataFrame([("Brand#11", "moved")], "alias string, canonical string"))


@query("""SELECT '10.1/' || CAST(o_custkey AS VARCHAR) AS doi, min(o_orderkey) AS entry_key, c AS kept FROM orders JOIN (SELECT c_custkey AS c FROM customer WHERE c_acctbal > 0) ON o_custkey = c GROUP BY o_custkey, c HAVING min(o_orderkey) <> c""")
def dml25_doi_conflicts(spark, sf):
    have = _t(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("10.1/"), _text("c_custkey")).alias("doi"), c("c_custkey").alias("entry_key"))
    new = _t(spark, sf, "orders").select(F.concat(F.lit("https://doi.org/10.1/"), _text("o_custkey")).alias("doi"), c("o_orderkey").alias("entry_key"))
    return upkeep.add_doi_aliases(have, new)[1]


@query("""WITH m AS (SELECT user_id, event_type AS property, max(CAST(event_id AS VARCHAR)) AS value FROM events GROUP BY ALL), t AS (SELECT user_id // 2 AS k, user_id % 2 AS o, property, value FROM m WHERE user_id % 2 = 0 OR property = 'view')
    SELECT k * 2 AS entry_key, property, arg_min(value, o) AS value FROM t GROUP BY k, property""")  # fmt: skip
def dml27_moved_metadata(spark, sf):
    rows = _t(spark, sf, "events").groupBy(c("user_id").alias("entry_key"), c("event_type").alias("property")).agg(F.max(_text("event_id")).alias("value"))
    merges = rows.select(c("entry_key").alias("old")).distinct().filter("old % 2 = 1").select("old", (c("old") - 1).alias("new"))
    return upkeep.move_metadata(rows, merges, ["view"])


@query(ad.with_sql("r", """SELECT entry_key, role, position, contributor_id, s_name AS name_used FROM r JOIN supplier ON contributor_id = s_suppkey WHERE s_nationkey = 3 AND position > 1
    UNION ALL SELECT entry_key, role, position, contributor_id, 'used' FROM r WHERE position = 1"""))  # fmt: skip
def dml28_backfilled_names(spark, sf):
    roles, supplier = ad.roles(spark, sf), _t(spark, sf, "supplier")
    used = roles.filter("position = 1").select("entry_key", "role", "position", "contributor_id", F.lit("used").alias("name_used"))
    return upkeep.backfill_used_names(used, roles, ad.contributors(spark, sf), supplier.filter("s_nationkey = 3").select(c("s_suppkey").alias("contributor_id")))


@query("SELECT DISTINCT least(p_type, p_brand) AS name1, greatest(p_type, p_brand) AS name2 FROM part WHERE p_type <> p_brand")
def dml29_non_doubles(spark, sf):
    rows = _t(spark, sf, "part").select(F.concat("p_name", F.lit(" and "), "p_type").alias("mine"), F.concat("p_name", F.lit(" and "), "p_brand").alias("theirs"))
    return upkeep.non_doubles_of_skipped(rows)


@query("""SELECT p_name AS argument, CASE WHEN count(DISTINCT p_partkey) = 1 THEN CAST(min(p_partkey) AS VARCHAR) ELSE '' END AS id FROM part GROUP BY p_name UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN p_partkey IS NULL THEN '' ELSE CAST(s_suppkey AS VARCHAR) END FROM supplier LEFT JOIN part ON p_partkey = s_suppkey""")
def res20_resolved_arguments(spark, sf):
    part = _t(spark, sf, "part")
    people = part.select(_text("p_partkey").alias("id"), c("p_name").alias("name"))
    arguments = people.select(c("name").alias("argument")).distinct().unionByName(_t(spark, sf, "supplier").select(_text("s_suppkey").alias("argument")))
    return upkeep.resolve_argument(arguments, people, people.limit(0))


@query("""WITH p AS (SELECT p_partkey AS key, p_type AS a, p_brand AS b, p_size FROM part) SELECT key, 1 AS position, a AS mine, a AS theirs, 'same' AS decision FROM p
    UNION ALL SELECT key, 2, a || ', X', 'X ' || a, 'same' FROM p UNION ALL SELECT key, 3, a, b, CASE WHEN b = 'Brand#11' THEN 'orcid' ELSE 'ask' END FROM p WHERE p_size > 0""")  # fmt: skip
def res3_author_breakdown(spark, sf):
    part = _t(spark, sf, "part")
    pairs = part.select(c("p_partkey").alias("key"), F.concat_ws(" and ", "p_type", F.concat("p_type", F.lit(", X")), "p_type").alias("mine"), F.concat_ws(" and ", "p_type", F.concat(F.lit("X "), "p_type"), "p_brand").alias("theirs"))
    known = part.select(c("p_type").alias("name"), F.lit("one").alias("id")).distinct().unionByName(spark.createDataFrame([("Brand#11", "one")], "name string, id string"))
    return upkeep.author_breakdown(pairs, known).withColumn("position", c("position").cast("int"))


# --- checks of tables


@query(ad.with_sql("e", """SELECT m.entry_key, 'title' AS field, m.challenger, CASE WHEN l.entry_key IS NOT NULL AND m.k % 5 <> 0 THEN t.value ELSE m.winner END AS winner,
    CASE WHEN l.entry_key IS NULL THEN 'deleted' WHEN m.k % 5 = 0 THEN 'redundant' ELSE 'fixed' END AS verdict
    FROM (SELECT CAST(p_partkey AS VARCHAR) AS entry_key, p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'old' END AS challenger, CASE WHEN p_partkey % 5 = 1 THEN p_name ELSE 'won' END AS winner FROM part) m
    JOIN e t ON t.entry_key = m.entry_key AND t.field = 'title' LEFT JOIN e l ON l.entry_key = m.entry_key AND l.field = 'entrytype' WHERE l.entry_key IS NULL OR m.k % 5 <> 1"""))  # fmt: skip
def chk16_mapping_winners(spark, sf):
    k = c("p_partkey")
    rows = _t(spark, sf, "part").select(_text("p_partkey").alias("entry_key"), F.lit("title").alias("field"), F.when(k % 5 == 0, c("p_name")).otherwise("old").alias("challenger"), F.when(k % 5 == 1, c("p_name")).otherwise("won").alias("winner"))
    return upkeep.mapping_winners(rows, ad.entries(spark, sf))


@query(ad.with_sql("e", """SELECT entry_key AS key FROM e WHERE field = 'entrytype' AND entry_key NOT IN (SELECT entry_key FROM e WHERE field = 'dblp') AND entry_key NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"""))
def chk17_valid_waivers(spark, sf):
    return upkeep.valid_waivers(_t(spark, sf, "part").select(_text("p_partkey").alias("key")), ad.entries(spark, sf), _t(spark, sf, "supplier").select(_text("s_suppkey").alias("alias")))


@query("""SELECT n_name AS state, 'is a country''s name too' AS problem FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'has no country' FROM nation WHERE n_regionkey NOT IN (2, 3)""")
def chk18_address_problems(spark, sf):
    nation = _t(spark, sf, "nation")
    name = c("n_name")
    return upkeep.address_problems(nation.select(F.lower(name).alias("alias"), name.alias("canonical")), nation.filter("n_regionkey = 1").select(name.alias("alias")), nation.filter("n_regionkey IN (2, 3)").select(name.alias("state")))


@query("""WITH x AS (SELECT p_partkey AS k, p_brand AS b, p_size FROM part), y AS (SELECT b, min(k) AS there FROM x WHERE p_size > 45 GROUP BY b)
    SELECT 'p' || CAST(k AS VARCHAR) AS entry_key, CASE WHEN p_size > 45 THEN '' WHEN there IS NOT NULL THEN 'p' || CAST(there AS VARCHAR) ELSE 'parent-' || md5('proceedings|' || md5(lower(replace(b, '-', '')))) END AS crossref FROM x LEFT JOIN y USING (b)""")  # fmt: skip
def chk15_split_bookish(spark, sf):
    book = c("p_size") > 45
    rows = _t(spark, sf, "part").select(
        F.concat(F.lit("p"), _text("p_partkey")).alias("entry_key"), F.when(book, "proceedings").otherwise("inproceedings").alias("entrytype"), F.when(book, c("p_brand")).otherwise("t").alias("title"),
        F.when(book, "").otherwise(c("p_brand")).alias("booktitle"), F.lit("").alias("crossref"),
    )
    # of several proceedings of a title the smallest key as text is taken, here that of the smallest number
    least = F.lpad(F.regexp_replace("entry_key", "p", ""), 12, "0")
    out = upkeep.split_bookish(rows.withColumn("entry_key", least))[0]
    plain = lambda x: F.when(c(x).rlike(r"\A[0-9]+\z"), F.concat(F.lit("p"), c(x).try_cast("long").cast("string"))).otherwise(c(x))
    return out.select(plain("entry_key").alias("entry_key"), plain("crossref").alias("crossref"))


def _tables(spark, sf):
    part, supplier, orders = _t(spark, sf, "part"), _t(spark, sf, "supplier"), _t(spark, sf, "orders")
    people = ad.contributors(spark, sf)
    used = ad.roles(spark, sf).join(people, c("contributor_id") == c("id")).select("contributor_id", F.when(c("position") == 1, F.upper("name")).otherwise(F.concat("name", F.lit("!"))).alias("name_used"))
    return {
        "entries": ad.entries(spark, sf), "groups": ad.groups(spark, sf), "files": _t(spark, sf, "pages"), "contributors": people, "names": supplier, "used": used,
        "field_mappings": part.select(c("p_brand").alias("source_field"), F.when(c("p_size") > 25, c("p_brand")).otherwise("x").alias("target_field")),
        "superseded": orders.select(F.when(c("o_orderstatus") == "F", "author").otherwise("year").alias("field"), F.when(c("o_totalprice") > 100000, "done").alias("triage_status")),
        "parents": _t(spark, sf, "nation"), "waived": _t(spark, sf, "region"), "oldies": ad.aliases(spark, sf), "hints": part, "non_double_entries": _t(spark, sf, "customer"),
        "non_double_contributors": _t(spark, sf, "labels"), "non_double_names": _t(spark, sf, "benchmark"), "flags": _t(spark, sf, "events"),
    }


@query(ad.with_sql("e r c g a", """SELECT 'entries' AS metric, CAST(count(*) AS VARCHAR) AS value FROM e WHERE field = 'entrytype'
    UNION ALL SELECT 'groups', CAST(count(DISTINCT group_name) AS VARCHAR) FROM g UNION ALL SELECT 'pdf files', CAST(count(*) AS VARCHAR) FROM pages UNION ALL SELECT 'contributors', CAST(count(*) AS VARCHAR) FROM supplier
    UNION ALL SELECT 'contributor forms', CAST(count(*) AS VARCHAR) FROM supplier UNION ALL SELECT 'name spellings', CAST(count(DISTINCT n) AS VARCHAR) FROM u
    UNION ALL SELECT 'aliases in entries', CAST(count(*) AS VARCHAR) FROM u WHERE n <> name UNION ALL SELECT 'mappings within a field', CAST(count(*) AS VARCHAR) FROM part WHERE p_size > 25
    UNION ALL SELECT 'mappings across fields', CAST(count(*) AS VARCHAR) FROM part WHERE p_size <= 25 UNION ALL SELECT 'losing values', CAST(count(*) AS VARCHAR) FROM orders
    UNION ALL SELECT 'losing values to triage', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 100000
    UNION ALL SELECT 'dblp coverage', CAST(CAST(round(100.0 * (SELECT count(*) FROM e x SEMI JOIN (SELECT entry_key FROM e WHERE field = 'dblp') d USING (entry_key) WHERE x.field = 'entrytype') / (SELECT count(*) FROM e WHERE field = 'entrytype')) AS BIGINT) AS VARCHAR) || '%'
    UNION ALL SELECT 'dblp links', CAST(count(*) AS VARCHAR) FROM e x SEMI JOIN (SELECT entry_key FROM e WHERE field = 'dblp') d USING (entry_key) WHERE x.field = 'entrytype'
    UNION ALL SELECT 'crossref overrides', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT 'waived children', CAST(count(*) AS VARCHAR) FROM region UNION ALL SELECT 'old keys', CAST(count(*) AS VARCHAR) FROM a
    UNION ALL SELECT 'key hints', CAST(count(*) AS VARCHAR) FROM part UNION ALL SELECT 'different entries', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'different contributors', CAST(count(*) AS VARCHAR) FROM labels
    UNION ALL SELECT 'different names', CAST(count(*) AS VARCHAR) FROM benchmark UNION ALL SELECT 'entry flags', CAST(count(*) AS VARCHAR) FROM events""",
    "u AS (SELECT CASE WHEN position = 1 THEN upper(name) ELSE name || '!' END AS n, name FROM r JOIN c ON contributor_id = id)"))
def agg3_all_statistics(spark, sf):
    return upkeep.library_statistics(_tables(spark, sf))


@query("""SELECT p_brand AS metric, '+' || CAST(count(*) FILTER (p_size > 25) AS VARCHAR) AS change FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size > 25) > 0""")
def agg4_session_changes(spark, sf):
    count = lambda rows: rows.groupBy(c("p_brand").alias("metric")).agg(F.count("*").cast("string").alias("value"))
    part = _t(spark, sf, "part")
    brands = part.select(c("p_brand").alias("metric")).distinct()
    before = brands.join(count(part.filter("p_size <= 25")), "metric", "left").na.fill("0")
    return upkeep.session_changes(before, count(part))


# --- look-ups and functions


@query("SELECT p_name AS name, count(*) AS times, arg_min(p_brand, p_partkey) AS chosen FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def agg18_ambiguous_assignments(spark, sf):
    return lookups.ambiguous_assignments(_t(spark, sf, "part").select(c("p_name").alias("name"), c("p_brand").alias("id"), c("p_partkey").alias("at")))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS keys FROM part GROUP BY p_brand")
def agg21_keys_of_groups(spark, sf):
    return lookups.inverted(_t(spark, sf, "part"), "p_brand", "p_type")


@query("""WITH b AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) + 1), lambda i: ord(p_name[i]))) AS x, list_distinct(list_transform(range(1, length(p_brand) + 1), lambda i: ord(p_brand[i]))) AS y FROM part)
    SELECT p_partkey, CAST(len(list_distinct(list_concat(x, y))) AS INT) AS united, CAST(len(list_intersect(x, y)) AS INT) AS common, CAST(len(list_filter(x, lambda e: NOT list_contains(y, e))) AS INT) AS only_a, list_has_all(y, x) AS within FROM b""")  # fmt: skip
def set7_byte_sets(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", lookups.byte_set(c("p_name")).alias("a"), lookups.byte_set(c("p_brand")).alias("b"))
    made = lookups.byte_algebra(c("a"), c("b"))
    return rows.select("p_partkey", *[lookups.byte_count(made[x]).alias(x) for x in ("united", "common", "only_a")], made["within"].alias("within"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END, doc_id) AS turn FROM documents""")
def sort5_by_mode(spark, sf):
    mode = F.when(c("lang") == "en", "full").when(c("lang") == "de", "subset").when(c("lang") == "fr", "harvest").otherwise("other")
    return lookups.by_mode(_t(spark, sf, "documents").select("doc_id", mode.alias("mode")), "mode", "doc_id").select("doc_id", "turn")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def flt28_mapped(spark, sf):
    table = _t(spark, sf, "part").select(c("p_partkey").alias("l_partkey"), F.when(c("p_size") > 25, c("p_name")).otherwise("").alias("value"))
    return lookups.mapped(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table, ["l_partkey"], "value").drop("l_partkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_size > 25 THEN p_name ELSE '' END AS value FROM lineitem JOIN part ON l_partkey = p_partkey")
def set9_map_get(spark, sf):
    table = _t(spark, sf, "part").filter("p_size > 25").select(c("p_partkey").alias("l_partkey"), c("p_name").alias("value"))
    return lookups.map_get(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table, ["l_partkey"], "value").drop("l_partkey")


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 40 OR p_type <> 'ECONOMY' EXCEPT SELECT p_brand, p_type FROM part WHERE p_size = 50")
def set8_multimap(spark, sf):
    part = _t(spark, sf, "part").select("p_brand", "p_type", "p_size")
    keep = part.filter("p_size <= 40 OR p_type <> 'ECONOMY'").drop("p_size")
    return lookups.multimap_change(keep.filter("p_type <> 'PROMO'"), keep.filter("p_type = 'PROMO'"), part.filter("p_size = 50").drop("p_size"))


@query("SELECT n_regionkey, bool_or(n_name LIKE 'A%') AND bool_or(n_name LIKE 'I%') AS there FROM nation GROUP BY n_regionkey")
def set5_membership(spark, sf):
    per = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_set(F.left("n_name", F.lit(1))).alias("letters"))
    return per.select("n_regionkey", lookups.contains_all(c("letters"), F.array(F.lit("A"), F.lit("I"))).alias("there"))


@query(ad.with_sql("a", "SELECT canonical AS entry_key, alias FROM a JOIN part ON canonical = p_partkey WHERE p_brand = 'Brand#11'"))
def rnd4_group_aliases(spark, sf):
    groups = _t(spark, sf, "part").select(c("p_brand").alias("group_name"), c("p_partkey").alias("entry_key"))
    return lookups.group_aliases(groups, "Brand#11", ad.aliases(spark, sf))


@query("SELECT s_suppkey, array_to_string([s_name, '{' || s_name || ' b}', 'c{d e}f'], '|') AS tokens FROM supplier")
def fn22_split_unbraced(spark, sf):
    text = F.concat("s_name", F.lit("  {"), "s_name", F.lit(" b} c{d e}f"))
    return _t(spark, sf, "supplier").select("s_suppkey", F.array_join(fn.split_unbraced(text), "|").alias("tokens"))


@query("""SELECT p_partkey, 'DBLP:conf/x/' || CAST(p_partkey AS VARCHAR) AS key, 'conf/x/' || CAST(p_partkey AS VARCHAR) AS bare, 'conf/x' AS parent, md5(p_name) AS hash, 'dblp' AS source, '2020-01-02T03:04:05' AS jr, 'a/b' AS stem, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS lang, CAST(p_size AS VARCHAR) AS year FROM part""")
def fn43_keys_and_hashes(spark, sf):
    key = F.concat(F.lit("conf/x/"), _text("p_partkey"))
    return _t(spark, sf, "part").select(
        "p_partkey", fn.dblp_key(key).alias("key"), fn.bare_dblp_key(fn.dblp_key(key)).alias("bare"), fn.dblp_parent(key).alias("parent"), fn.person_hash(c("p_name")).alias("hash"), fn.key_source(fn.dblp_key(key)).alias("source"),
        fn.clean_jr_date(F.lit("2020-01-02 03:04:05 +0100")).alias("jr"), fn.stem(F.lit("a/b.bib")).alias("stem"), fn.language_id(F.when(c("p_size") > 25, c("p_brand")).otherwise("english"), "english").alias("lang"), fn.year(F.concat(F.lit(" "), _text("p_size"))).alias("year"),
    )


@query("""WITH d AS (SELECT s_suppkey, 1 + s_nationkey AS a, 1 + s_suppkey % 28 AS b FROM supplier) SELECT s_suppkey, CASE WHEN a > 12 AND b > 12 THEN CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || '.2020'
    WHEN a > 12 THEN '2020-' || lpad(CAST(b AS VARCHAR), 2, '0') || '-' || lpad(CAST(a AS VARCHAR), 2, '0') ELSE '2020-' || lpad(CAST(a AS VARCHAR), 2, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0') END AS day FROM d""")  # fmt: skip
def fn9_dotted_dates(spark, sf):
    raw = F.concat_ws(".", _text(c("s_nationkey") + 1), _text(c("s_suppkey") % 28 + 1), F.lit("2020"))
    return _t(spark, sf, "supplier").select("s_suppkey", fn.date(raw).alias("day"))


@query("""SELECT user_id // 3 AS entry_key, CASE WHEN user_id % 3 = 2 THEN 'warn' ELSE 'plain' END AS kind, array_to_string(list_sort(['all', CASE user_id % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'rest' END]), ',') AS groups FROM (SELECT DISTINCT user_id FROM events)""")
def dsl1_else_if(spark, sf):
    users = _t(spark, sf, "events").select("user_id").distinct()
    rows = users.select(c("user_id").alias("entry_key"), F.create_map(F.lit("volume"), _text(c("user_id") % 3), F.lit("entrytype"), F.lit("book")).alias("fields"), F.array(F.lit("all")).alias("groups"))
    script = 'if field volume = "0" then add group "zero" else if field volume = "1" then add group "one" else add group "rest"\nif in group "rest" then warn "rest"'
    out = rules.apply_rules(rows, script)
    return out.select(F.expr("entry_key div 3").alias("entry_key"), F.when(F.size("warnings") > 0, "warn").otherwise("plain").alias("kind"), F.array_join("groups", ",").alias("groups"))


@query(ad.with_sql("r c", "SELECT DISTINCT CAST(entry_key AS VARCHAR) AS entry_key FROM r JOIN c ON contributor_id = id WHERE id IN (1, 2) OR id = 3 UNION SELECT CAST(page_id AS VARCHAR) FROM pages"))
def dsl3_people_and_files(spark, sf):
    people = ad.contributors(spark, sf).withColumn("orcid", F.concat(F.lit("o"), _text("id")))
    tables = {"roles": ad.roles(spark, sf), "contributors": people, "files": _t(spark, sf, "pages").select(c("page_id").alias("entry_key"))}
    first = "Supplier#000000001"
    return rules.select(f'name "{first}"\norcid "o2"\ncontributor "3"\nhas_pdf', ad.entries(spark, sf), ad.groups(spark, sf), tables)


@query("""SELECT user_id AS node, CAST(user_id AS VARCHAR) || ' ' || CAST(user_id + 1 AS VARCHAR) || ' ' || CAST(user_id + 2 AS VARCHAR) AS path FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0 AND user_id + 1 IN (SELECT user_id FROM events) AND user_id + 2 IN (SELECT user_id FROM events)""")
def grf6_cycle_paths(spark, sf):
    users = _t(spark, sf, "events").select(c("user_id").alias("x")).distinct()
    return upkeep.cycle_paths(users.select("x", F.when(c("x") % 3 == 2, c("x") - 2).otherwise(c("x") + 1).alias("y")), "x", "y")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS entry_key, CASE WHEN p_size % 3 = 0 THEN 'arXiv' ELSE '' END AS eprinttype, CASE WHEN p_size % 3 = 0 THEN '20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.00001' ELSE '' END AS eprint,
    CASE WHEN p_size % 3 = 0 THEN '10.48550/arXiv.20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.00001' WHEN p_size % 3 = 1 THEN '10.1/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS doi,
    CASE WHEN p_size % 3 = 2 THEN 'https://a.org/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS url, CASE WHEN p_size % 3 = 2 THEN '2021-03-04' ELSE '' END AS urldate, CASE WHEN p_size % 3 = 2 THEN '2021' ELSE '' END AS year, CASE WHEN p_size % 3 = 2 THEN 'See there' ELSE '' END AS note FROM part""")  # fmt: skip
def chk1_check_entries(spark, sf):
    """The 26 steps on records made from parts: e-prints by URL, DOIs by URL, and URLs and access dates in notes."""
    k, kind = _text("p_partkey"), c("p_size") % 3
    arxiv = F.concat(F.lit("https://arxiv.org/abs/20"), F.lpad(_text("p_size"), 2, "0"), F.lit(".00001"))
    rows = _t(spark, sf, "part").select(
        c("p_partkey").alias("entry_key"), F.lit("misc").alias("entrytype"), c("p_name").alias("title"),
        F.when(kind == 0, arxiv).when(kind == 1, F.concat(F.lit("http://dx.doi.org/10.1/"), k)).otherwise("").alias("url"),
        F.when(kind == 2, F.concat(F.lit("See there, \\url{ https://a.org/"), k, F.lit("}. Accessed: 4.3.2021"))).otherwise("").alias("note"),
    )
    return entry_checks.check_entries(rows)[0].select("entry_key", "eprinttype", "eprint", "doi", "url", "urldate", "year", "note")


@query("SELECT CAST(p_partkey AS VARCHAR) AS entry_key, check_name AS \"check\" FROM (SELECT p_partkey, unnest(CASE WHEN p_size % 4 = 0 THEN ['key', 'title'] WHEN p_size % 4 = 1 THEN ['key', 'isbn'] WHEN p_size % 4 = 2 THEN ['key', 'chapter', 'year'] ELSE ['key', 'contributor'] END) AS check_name FROM part)")
def chk1_warnings(spark, sf):
    kind = c("p_size") % 4
    rows = _t(spark, sf, "part").select(
        c("p_partkey").alias("entry_key"), F.lit("inbook").alias("entrytype"), F.when(kind == 0, "").otherwise(c("p_name")).alias("title"), F.when(kind == 1, "123").otherwise("").alias("isbn"),
        F.when(kind == 2, "IIII").otherwise("").alias("chapter"), F.when(kind == 2, "20x").otherwise("").alias("year"), F.when(kind == 3, "A, B, C, D").otherwise("").alias("author"),
    )
    return entry_checks.check_entries(rows, entry_checks.Settings(key_prefix="EP"))[1].select("entry_key", "check")


@query("""WITH o AS (SELECT user_id AS entry_key, event_type AS field, max(CAST(event_id AS VARCHAR)) AS value FROM events GROUP BY ALL) SELECT entry_key, field, 'dblp' AS source, value FROM o WHERE field <> 'view'""")
def dml18_changed_signatures(spark, sf):
    rows = _t(spark, sf, "events").groupBy(c("user_id").alias("entry_key"), c("event_type").alias("field")).agg(F.max(_text("event_id")).alias("value")).withColumn("source", F.lit("dblp"))
    return upkeep.changed_signatures(rows, rows.filter("field = 'view'").withColumnRenamed("value", "signature"))


@query(ad.with_sql("r", "SELECT entry_key, role, CAST(row_number() OVER (PARTITION BY entry_key, role ORDER BY position) AS BIGINT) AS place FROM r"))
def win3_places(spark, sf):
    rows = ad.roles(spark, sf).withColumn("list", F.concat_ws("/", "entry_key", "role"))
    return upkeep.first_position(rows, "list", "position").select("entry_key", "role", "place")
