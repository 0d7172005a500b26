"""Queries of sources, absorption, keys, maps and synchronisation: data that Spark derives from the driver's tables is written, read back and worked on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import adapters as ad
from quire.catalogue import query
from quire.functions import maps
from quire.library import Library
from quire.operators import absorb, contributors, grouping, keys, store, sync
from quire.operators import log as tablelog
from quire.scratch import fresh_dir
from quire.sources import bib, dblp, tables

c = F.col


def _t(spark, sf, name):
    return ad.table(spark, sf, name)


def _text(x):
    return (c(x) if isinstance(x, str) else x).cast("string")


# --- dumps: orders are articles, customers are home pages, and nations are what orders refer to


def _xml(x):
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _dump(spark, sf, compressed=True):
    """The path of a dump in XML that the tasks of a write made, with records of all kinds."""
    orders = _t(spark, sf, "orders").join(_t(spark, sf, "customer").select(c("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    article = F.concat(
        F.lit('<article key="o/'), _text("o_orderkey"), F.lit('" mdate="'), _text(c("o_orderdate").cast("date")), F.lit('">\n<author>'), _xml(c("c_name")), F.lit("</author><title>"), _xml(c("o_orderpriority")), F.lit(" <i>"), _xml(c("o_orderstatus")),
        F.lit("</i>.</title>\n<crossref>n/"), _text("c_nationkey"), F.lit("</crossref></article>"),
    )
    page = F.concat(F.lit('<www key="homepages/'), _text("c_custkey"), F.lit('" mdate="2020-01-01"><author>'), _xml(c("c_name")), F.lit("</author><author>"), _xml(c("c_mktsegment")), F.lit(" "), _text("c_custkey"), F.lit("</author><url>https://orcid.org/0000-0000-0000-"), F.lpad(_text("c_nationkey"), 4, "0"), F.lit("</url></www>"))
    lines = orders.select(article.alias("value")).unionByName(_t(spark, sf, "customer").select(page.alias("value")))
    path = fresh_dir(spark, "dump")
    lines.write.option("compression", "gzip" if compressed else "none").text(path)
    return path


_DUMP = """a AS (
        SELECT 'o/' || o_orderkey AS record_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS mdate, c_name, o_orderpriority || ' <i>' || o_orderstatus || '</i>' AS title, 'n/' || c_nationkey AS parent
        FROM orders JOIN customer ON o_custkey = c_custkey),
    h AS (SELECT 'homepages/' || c_custkey AS record_key, c_name, c_mktsegment || ' ' || c_custkey AS other, '0000-0000-0000-' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS orcid FROM customer)"""
#: Compressed bytes from one restart point to the next, so that small dumps have several.
_EVERY = 20_000


@query(f"""WITH {_DUMP}
    SELECT record_key, mdate, '' AS field, '' AS value, 0 AS pos FROM a UNION ALL SELECT record_key, mdate, 'author', c_name, 1 FROM a UNION ALL SELECT record_key, mdate, 'title', title, 2 FROM a UNION ALL SELECT record_key, mdate, 'crossref', parent, 3 FROM a
    UNION ALL SELECT record_key, '2020-01-01', '', '', 0 FROM h UNION ALL SELECT record_key, '2020-01-01', 'author', c_name, 1 FROM h UNION ALL SELECT record_key, '2020-01-01', 'author', other, 2 FROM h
    UNION ALL SELECT record_key, '2020-01-01', 'url', 'https://orcid.org/' || orcid, 3 FROM h""")
def src7_dump_ranges(spark, sf):
    return dblp.read(spark, _dump(spark, sf), every=_EVERY).select("record_key", "mdate", "field", "value", "pos")


@query(f"WITH {_DUMP} SELECT record_key AS person, array_to_string([c_name, other], '|') AS names, c_name AS canonical, orcid FROM h")
def src8_persons(spark, sf):
    return dblp.persons(dblp.read(spark, _dump(spark, sf), every=_EVERY)).withColumn("names", F.array_join("names", "|"))


@query(f"WITH {_DUMP} SELECT record_key, mdate FROM a UNION ALL SELECT record_key, '2020-01-01' FROM h")
def src9_keys_only(spark, sf):
    return dblp.manifest(dblp.read(spark, _dump(spark, sf, compressed=False), keys_only=True, every=_EVERY))


@query(f"WITH {_DUMP} SELECT parent, record_key AS child FROM a")
def src10_crossrefs(spark, sf):
    return dblp.children(dblp.read(spark, _dump(spark, sf), every=_EVERY))


@query(f"WITH {_DUMP} SELECT record_key, 'article' AS entrytype, mdate, title, parent AS crossref, 1 AS authors FROM a UNION ALL SELECT record_key, 'www', '2020-01-01', NULL, NULL, 2 FROM h")
def src12_json_walk(spark, sf):
    """The nested JSON store, written and walked."""
    path = fresh_dir(spark, "json")
    dblp.write_json(dblp.read(spark, _dump(spark, sf), every=_EVERY), path, buckets=8)
    return dblp.read_json(spark, path).select("record_key", "entrytype", "mdate", c("fields")["title"].alias("title"), c("fields")["crossref"].alias("crossref"), F.size("authors").alias("authors"))


@query("SELECT DISTINCT md5(lower(o_orderpriority)) AS hash, 'o/' || o_orderkey AS record_key FROM (SELECT o_orderkey, regexp_replace(o_orderpriority || '<i>' || o_orderstatus || '<i>', '[{}()$~.,\"''`^*=!?_:;/| -]', '', 'g') AS o_orderpriority FROM orders)")
def src14_title_links(spark, sf):
    """The title index, written and read; titles have their markup."""
    path = fresh_dir(spark, "links")
    dblp.write_title_links(dblp.title_links(dblp.read(spark, _dump(spark, sf), every=_EVERY)), path)
    return dblp.read_title_links(spark, path)


# --- tables


@query("SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
def src17_csv_round_trip(spark, sf):
    """A quoted CSV, written in one global order and scanned."""
    path = fresh_dir(spark, "csv")
    bib.write_csv(_t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), path, ["c_custkey"])
    return bib.csv_table(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").drop("_corrupt_record")


@query("SELECT 'supplier' AS name, s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def src20_registry_round_trip(spark, sf):
    """Tables exported by a registry and loaded by another, which validates each before it replaces any."""
    made, again, path = tables.Registry(spark), tables.Registry(spark), fresh_dir(spark, "registry")
    rows = {"supplier": _t(spark, sf, "supplier").select(c("s_suppkey").cast("long").alias("key"), c("s_name").alias("value")), "nation": _t(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("key"), c("n_name").alias("value"))}
    for name, df in rows.items():
        made.add(tables.Table(name, "key long, value string", ["key"]), df)
        again.add(tables.Table(name, "key long, value string", ["key"], valid=lambda: c("value") != ""), df.limit(0))
    made.export(path)
    again.load(path)
    one = lambda n: again.rows[n].select(F.lit(n).alias("name"), "key", "value")
    return one("supplier").unionByName(one("nation"))


# --- contributors: suppliers and customers with persons from nations and regions


def _people(spark, sf):
    """person, name: two spellings for each supplier's person."""
    s = _t(spark, sf, "supplier")
    name = F.concat(F.lit("Name"), _text("s_suppkey"), F.lit(", "), F.substring("s_name", 1, 1))
    return s.select(F.concat(F.lit("p"), _text("s_suppkey")).alias("person"), name.alias("name")).unionByName(s.select(F.concat(F.lit("p"), _text("s_suppkey")).alias("person"), c("s_name").alias("name")))


def _contributors(spark, sf):
    """Customers: those of one supplier have its person's key, its ORCID, its name, or a key of another with its name, by their own number."""
    k, s = c("c_custkey"), c("c_custkey") % 50 + 1
    kind = F.pmod(F.floor(k / 50), F.lit(4))
    name = F.when(kind.isin(2, 3), F.concat(F.lit("Name"), _text(s), F.lit(", S"))).otherwise(F.concat(F.lit("Other"), _text(k), F.lit(", S")))
    key = F.when(kind == 0, F.concat(F.lit("p"), _text(s))).when(kind == 3, F.concat(F.lit("p"), _text(s % 50 + 1))).otherwise("")
    orcid = F.when(kind == 1, F.concat(F.lit("x"), _text(s))).otherwise("")
    return _t(spark, sf, "customer").select(_text(k).alias("id"), name.alias("name"), key.alias("dblp_key"), orcid.alias("orcid"))


def _absorbed(spark, sf):
    persons = _t(spark, sf, "supplier").select(F.concat(F.lit("p"), _text("s_suppkey")).alias("person"), F.concat(F.lit("x"), _text("s_suppkey")).alias("orcid"))
    rows = _contributors(spark, sf)
    return absorb.absorb(rows, rows.select("id", "name").limit(0), _people(spark, sf), persons)


#: Whom a customer stands for: its key's person, else its ORCID's, else its name's.
_ABSORB = """k AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 50 + 1 AS s, (c_custkey // 50) % 4 AS kind FROM customer),
    w AS (
        SELECT id, kind, s, CASE WHEN kind = 3 THEN s % 50 + 1 ELSE s END AS p FROM k),
    u AS (SELECT w.* FROM w SEMI JOIN supplier ON p = s_suppkey),
    b AS (SELECT p, min(id) FILTER (kind IN (0, 3)) AS keyed, coalesce(min(id) FILTER (kind IN (0, 3)), min(id)) AS new FROM u GROUP BY p)"""


@query(f"WITH {_ABSORB} SELECT id AS old, new FROM u JOIN b USING (p) WHERE id <> new")
def res8_absorb_merges(spark, sf):
    return _absorbed(spark, sf).merges


@query(f"WITH {_ABSORB} SELECT 'key' AS what, new AS id, 'p' || p AS value FROM b WHERE keyed IS NULL UNION ALL SELECT 'orcid', new, 'x' || p FROM b JOIN k ON k.id = b.new WHERE kind <> 1")
def res9_absorb_keys_and_orcids(spark, sf):
    found = _absorbed(spark, sf)
    return found.keys.select(F.lit("key").alias("what"), "id", c("person").alias("value")).unionByName(found.orcids.select(F.lit("orcid").alias("what"), "id", c("orcid").alias("value")))


@query(f"WITH {_ABSORB} SELECT id, 'p' || p AS person, 'p' || s AS other FROM w SEMI JOIN supplier ON s = s_suppkey WHERE kind = 3 AND p <> s")
def dml9_split_candidates(spark, sf):
    return _absorbed(spark, sf).splits


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS entry_key, l_suppkey % 10 AS c, l_suppkey AS s FROM lineitem),
    m AS (SELECT entry_key, c FROM r GROUP BY entry_key, c HAVING count(*) FILTER (s = c + 10) > 0 AND count(*) FILTER (s <> c + 10) = 0)
    SELECT r.entry_key, CASE WHEN m.c IS NULL THEN CAST(r.c AS VARCHAR) ELSE 'dblp:q' || r.c END AS contributor_id FROM (SELECT DISTINCT entry_key, c FROM r) r LEFT JOIN m USING (entry_key, c)""")
def dml9_split_roles(spark, sf):
    """Contributors are the last digits of suppliers; what only the supplier c + 10 delivered to goes to the other person's contributor."""
    lines = _t(spark, sf, "lineitem").select(c("l_orderkey").alias("entry_key"), (c("l_suppkey") % 10).alias("d"), c("l_suppkey").alias("s")).distinct()
    roles = lines.select("entry_key", _text("d").alias("contributor_id")).distinct()
    mine, other = F.concat(F.lit("p"), _text("d")), F.concat(F.lit("q"), _text("d"))
    publications = lines.select(F.when(c("s") == c("d") + 10, other).otherwise(mine).alias("person"), "entry_key").distinct()
    splits = lines.select(_text("d").alias("id"), mine.alias("person"), other.alias("other")).distinct()
    known = splits.select("id", F.concat(F.lit("Name "), "id").alias("name"), c("person").alias("dblp_key"))
    return absorb.split_roles(roles, splits, publications, known, splits.select(c("other").alias("person"), c("other").alias("name")))[0]


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 40 AS g FROM lineitem),
    k AS (SELECT s, min(g) AS g FROM l GROUP BY s)
    SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS torn FROM (SELECT s FROM k UNION ALL SELECT DISTINCT -1 - g FROM l)""")
def grf7_constrained(spark, sf):
    """Groups of suppliers and part classes in which no two classes of unlike parity meet: how many nodes, and how many groups are torn."""
    links = store.cut(_t(spark, sf, "lineitem").select(c("l_suppkey").cast("long").alias("a"), (-1 - c("l_partkey") % 40).cast("long").alias("b")).distinct().withColumn("level", F.lit(1)))
    labels = links.select(c("b").alias("node"), F.lit("parity").alias("kind"), _text(F.abs("b") % 2).alias("value")).distinct()
    found = grouping.constrained_components(links, labels)
    groups = found.join(labels, "node", "left").groupBy("root").agg(F.count_distinct("node").alias("nodes"), F.count_distinct("value").alias("values"))
    return groups.agg(F.sum("nodes").alias("nodes"), F.count_if(c("values") > 1).alias("torn"))


@query("SELECT DISTINCT 'c' || substr(md5(s_name), 1, 12) AS id, s_name AS name FROM supplier WHERE s_nationkey % 2 = 1")
def dml13_seeded(spark, sf):
    s = _t(spark, sf, "supplier")
    return contributors.seed(s.select(c("s_name").alias("name")), s.filter("s_nationkey % 2 = 0").select(c("s_name").alias("name")))


# --- entries


@query(ad.with_sql("e", """SELECT coalesce(m.new, e.entry_key) AS entry_key, field, CASE WHEN max(e.value) FILTER (m.new IS NULL) IS NULL THEN min(e.value) ELSE max(e.value) FILTER (m.new IS NULL) END AS value
    FROM e LEFT JOIN m ON m.old = e.entry_key GROUP BY 1, 2""", "m AS (SELECT CAST(p_partkey AS VARCHAR) AS old, CAST(p_partkey - 1 AS VARCHAR) AS new FROM part WHERE p_partkey % 4 = 2 AND length(CAST(p_partkey AS VARCHAR)) = length(CAST(p_partkey - 1 AS VARCHAR)))"))  # fmt: skip
def res1_merged_entries(spark, sf):
    links = _t(spark, sf, "part").filter("p_partkey % 4 = 2").select(_text(c("p_partkey") - 1).alias("a"), _text("p_partkey").alias("b")).filter(F.length("a") == F.length("b"))
    return Library.of(ad.entries(spark, sf)).merge_entries(links).entries


@query("""WITH o AS (SELECT doc_id, lower(substr(lang, 1, 2)) AS l, 1990 + doc_id % 7 AS y, 'word' || chr(CAST(97 + doc_id % 5 AS INT)) AS w FROM documents WHERE lang IS NOT NULL)
    SELECT CAST(doc_id AS VARCHAR) AS entry_key, l || y || w AS alias FROM o QUALIFY row_number() OVER (PARTITION BY l, y, w ORDER BY CAST(doc_id AS VARCHAR)) = 1""")
def chk12_preferred_aliases(spark, sf):
    """Entries from documents with one keyword each: of those of a surname, year and keyword the first gets the alias."""
    rows = _t(spark, sf, "documents").filter("lang IS NOT NULL").select(
        _text("doc_id").alias("entry_key"), F.lit("misc").alias("entrytype"), F.concat(F.initcap(F.substring("lang", 1, 2)), F.lit(", A")).alias("author"), F.lit("").alias("editor"), F.lit("").alias("publisher"), _text(1990 + c("doc_id") % 7).alias("year"),
        F.concat(F.lit("The Word"), F.char(97 + c("doc_id") % 5)).alias("title"), F.lit("").alias("dblp"), F.lit("").alias("crossref"), F.lit("").alias("preferredalias"),
    )
    return keys.derived_aliases(rows, rows.select(c("entry_key").alias("alias"), c("entry_key").alias("canonical")).limit(0))


def _quoted(x):
    return "'" + x.replace("'", "''") + "'"


_MAP = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in maps.Maps().characters.items()) + "}"


@query(rf"""SELECT doc_id, md5(array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda x: coalesce(m[x], CASE WHEN x = '&' THEN '\&' WHEN unicode(x) >= 128 THEN '\unicode{{' || unicode(x) || '}}' ELSE x END)), '')) AS latex
    FROM documents, (SELECT {_MAP} AS m)""")
def fn36_raw_to_latex(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(maps.dblp_to_latex(c("text"))).alias("latex"))


@query(rf"""SELECT doc_id, sum(len(x)) AS n FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), ''), lambda x: coalesce(m[x], CASE WHEN unicode(x) >= 128 THEN '\unicode{{' || unicode(x) || '}}' ELSE x END))) AS x
    FROM documents, (SELECT {_MAP} AS m)) GROUP BY doc_id""")
def fn38_unicode_to_tex(spark, sf):
    return _t(spark, sf, "documents").filter("text <> ''").select("doc_id", F.length(maps.unicode_to_tex(c("text"))).cast("long").alias("n"))


# --- synchronisation: orders as the file has them, as the library has them, and as both were


def _sides(spark, sf):
    o = _t(spark, sf, "orders").select(_text("o_orderkey").alias("entry_key"), "o_orderstatus", c("o_custkey").alias("k"), "o_orderpriority")
    side = lambda rows, value: rows.select("entry_key", value.alias("fingerprint"))
    source = side(o.filter("k % 7 <> 0"), F.when(c("k") % 5 == 0, "edited").otherwise(c("o_orderpriority")))
    library = side(o.filter("k % 11 <> 0"), F.when(c("k") % 3 == 0, c("o_orderstatus")).otherwise(c("o_orderpriority")))
    return source, library, side(o.filter("k % 13 <> 0"), c("o_orderpriority")), o.filter("k % 17 <> 0").select("entry_key")


_SIDES = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS entry_key, o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders),
    v AS (SELECT entry_key, k, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'edited' ELSE p END END AS x, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 3 = 0 THEN s ELSE p END END AS y, CASE WHEN k % 13 <> 0 THEN p END AS b, k % 17 <> 0 AS inside FROM o),
    t AS (
        SELECT entry_key, CASE WHEN y IS NULL THEN CASE WHEN x IS NULL THEN 'gone' WHEN b IS NOT NULL THEN 'deleted-in-library' ELSE 'new-in-source' END
            WHEN x IS NULL THEN CASE WHEN NOT inside THEN 'out-of-scope' WHEN b IS NULL THEN 'new-in-library' ELSE 'deleted-in-source' END
            WHEN x = y THEN 'unchanged' WHEN b IS NULL THEN 'both-changed' WHEN b = y THEN 'source-changed' WHEN b = x THEN 'library-changed' ELSE 'both-changed' END AS status
        FROM v WHERE x IS NOT NULL OR y IS NOT NULL OR b IS NOT NULL OR inside)"""


def _plan(spark, sf, mode):
    return sync.plan(mode, *_sides(spark, sf)).filter("NOT (status = 'gone')")


@query(f"""WITH {_SIDES} SELECT entry_key, status, CASE status WHEN 'unchanged' THEN 'keep' WHEN 'source-changed' THEN 'take' WHEN 'new-in-source' THEN 'take' WHEN 'deleted-in-library' THEN 'drop' WHEN 'out-of-scope' THEN 'drop' ELSE 'write' END AS action,
    CASE WHEN status IN ('both-changed', 'deleted-in-source') THEN 'needs-review' ELSE 'ready' END AS state FROM t WHERE status <> 'gone'""")
def syn6_subset(spark, sf):
    return _plan(spark, sf, "subset")


@query(f"WITH {_SIDES} SELECT entry_key, status, CASE WHEN status IN ('new-in-source', 'deleted-in-library', 'out-of-scope') THEN 'drop' WHEN status = 'unchanged' THEN 'keep' ELSE 'write' END AS action, 'ready' AS state FROM t WHERE status <> 'gone'")
def syn6_pull(spark, sf):
    return _plan(spark, sf, "pull")


@query(f"""WITH {_SIDES} SELECT entry_key, status, CASE WHEN status IN ('new-in-library', 'deleted-in-source', 'deleted-in-library', 'out-of-scope') THEN 'drop' WHEN status IN ('unchanged', 'new-in-source') THEN 'keep' ELSE 'write' END AS action, 'ready' AS state
    FROM t WHERE status <> 'gone'""")
def syn6_follow(spark, sf):
    return _plan(spark, sf, "follow")


@query(f"WITH {_SIDES} SELECT entry_key, status, CASE WHEN status = 'new-in-source' THEN 'take' ELSE 'keep' END AS action, 'ready' AS state FROM t WHERE status <> 'gone'")
def syn6_harvest(spark, sf):
    return _plan(spark, sf, "harvest")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_key FROM orders WHERE NOT (o_custkey % 4 = 0 OR o_custkey % 4 = 1 AND o_orderstatus = 'F')")
def syn7_still_waiting(spark, sf):
    """Orders that weren't skipped with their present status."""
    o = _t(spark, sf, "orders")
    past = o.filter("o_custkey % 4 < 2").select(_text("o_orderkey").alias("source_key"), F.when(c("o_custkey") % 4 == 0, "ignored").otherwise("skip-content").alias("status"), F.when(c("o_custkey") % 4 == 0, c("o_orderstatus")).otherwise("F").alias("fingerprint"))
    return sync.still_waiting(o.select(_text("o_orderkey").alias("source_key"), c("o_orderstatus").alias("fingerprint")), sync.with_status(past.limit(0), past)).select("source_key")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment END AS v, CAST(1 AS BIGINT) AS version FROM customer
    UNION ALL SELECT c_custkey, 'second', -1 FROM customer WHERE c_custkey % 6 = 0""")
def dml32_two_writers(spark, sf):
    """Two writers change a table from its first version: the second gets the rows that both changed, and the table is the first's."""
    rows = _t(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_mktsegment").alias("v"))
    log = tablelog.TableLog(spark, fresh_dir(spark, "log"), ["k"])
    log.start(rows)
    log.commit(0, rows.filter("k % 3 = 0").withColumn("v", F.lit("first")))
    lost = log.commit(0, rows.filter("k % 2 = 0").withColumn("v", F.lit("second")))
    return log.read().select("k", "v", F.lit(log.head()).cast("long").alias("version")).unionByName(lost.conflicts.select("k", c("mine.v").alias("v"), F.lit(-1).cast("long").alias("version")))
