"""Sources, checks, contributors, rendering and streams on small fixtures."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from quire import catalogue, catalogue_ext, catalogue_flows, catalogue_more  # noqa: F401  add their queries
from quire.functions import render
from quire.operators import entry_checks, checks, contributors
from quire.sources import bib, dblp
from quire.streaming import changes

XML = """<?xml version="1.0" encoding="ISO-8859-1"?><dblp>
<article key="journals/x/A1" mdate="2020-01-01"><author orcid="0000-0001-0000-0000">Ann B</author><author>J&ouml;rg C</author><title>On <i>x</i>.</title><year>1999</year>
<ee>http://web/a</ee><ee>https://doi.org/10.1/a</ee><crossref>conf/y</crossref></article>
<www key="homepages/1/2" mdate="2021-02-02"><author>Ann B</author><author>Ann Bee</author><url>https://orcid.org/0000-0002-1825-0097</url></www>
<www key="homepages/9/9" mdate="2021-02-02"><crossref>homepages/1/2</crossref></www>
<article key="journals/x/A1" mdate="2022-01-01"><title>On x</title></article></dblp>"""


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def dump(spark):
    return dblp.parse(spark.createDataFrame([(bytearray(gzip.compress(XML.encode("iso-8859-1"))),)], "content binary"))


def test_dump(spark, dump):
    first = dump.filter("record_key = 'journals/x/A1' AND mdate = '2020-01-01'")
    assert ("title", "On <i>x</i>") in pairs(first, "field", "value") and ("author", "Jörg C") in pairs(first, "field", "value")
    assert pairs(dblp.manifest(dump), "record_key", "mdate") == [("homepages/1/2", "2021-02-02"), ("homepages/9/9", "2021-02-02"), ("journals/x/A1", "2022-01-01")]
    assert pairs(dblp.persons(dump), "person", "canonical", "orcid") == [("homepages/1/2", "Ann B", "0000-0002-1825-0097")]
    assert pairs(dblp.redirects(dump), "old", "new") == [("homepages/9/9", "homepages/1/2")]
    assert pairs(dblp.identifiers(dump), "doi", "url") == [("10.1/a", "http://web/a")]
    assert pairs(dblp.children(dump.filter("entrytype = 'article'")), "parent", "child") == [("conf/y", "journals/x/A1")]
    record = dblp.nested(first).first()
    assert record["fields"]["year"] == "1999" and [a["name"] for a in record["authors"]] == ["Ann B", "Jörg C"] and record["multi"]["ee"] == ["http://web/a", "https://doi.org/10.1/a"]


def test_json_store(spark, dump, tmp_path):
    dblp.write_json(dump.filter("mdate < '2022'"), str(tmp_path / "j"))
    assert pairs(dblp.read_json(spark, str(tmp_path / "j")).filter("record_key = 'journals/x/A1'"), "entrytype", "mdate") == [("article", "2020-01-01")]


def test_bib_files(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "entrytype", "book"), ("k1", "title", "A {B} C"), ("k1", "note", ""), ("k2", "title", "no type")], "entry_key string, field string, value string")
    bib.write(rows, str(tmp_path / "out"))
    assert pairs(bib.read(spark, str(tmp_path / "out")), "entry_key", "field", "value") == [("k1", "entrytype", "book"), ("k1", "title", "A {B} C")]


def test_csv_tables(spark, tmp_path):
    rows = spark.createDataFrame([("b;x", 'q"q'), ("a", "é")], "k string, v string")
    bib.write_csv(rows, str(tmp_path / "c"), ["k"])
    assert pairs(bib.csv_table(spark, str(tmp_path / "c"), "k string, v string"), "k", "v") == [("a", "é"), ("b;x", 'q"q')]


def record(spark, **fields):
    return spark.createDataFrame([("k", *fields.values())], "entry_key string, " + ", ".join(f"{f} string" for f in fields))


def test_repairs(spark):
    fix = lambda **f: entry_checks.check_entries(record(spark, **f))[0].first()
    assert fix(url="https://doi.org/10.1/a")["doi"] == "10.1/a" and fix(url="https://doi.org/10.1/a")["url"] == ""
    r = fix(url="https://arxiv.org/abs/2001.01234", urldate="2020-01-01")
    assert (r["eprint"], r["eprinttype"], r["doi"]) == ("2001.01234", "arXiv", "10.48550/arXiv.2001.01234")
    assert fix(eprint="x")["eprint"] == "" and fix(isbn="1234-567X")["issn"] == "1234-567X"
    r = fix(note="See \\url{http://a.b/c}, Accessed: 13.4.2026")
    assert (r["url"], r["urldate"], r["note"]) == ("http://a.b/c", "2026-04-13", "See")
    assert fix(entrytype="book", title="T")["booktitle"] == "T"


def test_warnings(spark):
    rows = record(spark, entrytype="article", title="T", year="'99", issn="x", urldate="2020-13-99", eprint="1")
    assert [c for _, c in pairs(checks.warnings(rows), "entry_key", "check")] == ["eprint", "issn", "year"]


def test_magic(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.4 x"),), (bytearray(b" <!DOCTYPE html>"),), (bytearray(b"%!PS"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in rows.select(checks.magic(F.col("c"))).collect()] == ["pdf", "html", "postscript", "other"]


def test_contributors(spark):
    people = spark.createDataFrame([(1, "Bee, Ann", "o1"), (2, "Ann Bee", "o1"), (3, "Cee, Dan", "")], "id long, name string, orcid string")
    assert pairs(contributors.merge_by_orcid(people), "old", "new") == [(2, 1)]
    names = spark.createDataFrame([("Ann Bee",), ("Eve, Zoe",), ("Zoe Eve",), ("New Name",)], "name string")
    assert [n for _, n in pairs(contributors.seed(names, people), "id", "name")].__len__() == 2
    forms = spark.createDataFrame([(1, "Z", False), (1, "A, B", False), (2, "x", True), (2, "a, b", False)], "id long, name string, is_primary boolean")
    assert pairs(contributors.best_name(forms), "id", "name") == [(1, "A, B"), (2, "x")]
    roles = spark.createDataFrame([("e1", "author", 1, "p"), ("e2", "author", 1, "p")], "entry_key string, role string, position int, contributor_id string")
    theirs = spark.createDataFrame([("q", "e2")], "person string, entry_key string")
    assert pairs(contributors.split(roles, theirs, "q", "p", "new"), "entry_key", "contributor_id") == [("e1", "p"), ("e2", "new")]


def test_citations(spark):
    rows = record(spark, entrytype="inproceedings", author="Bee, Ann and Cee, Dan", editor="Eff, G.", title="On {X}.", booktitle="Proc", pages="1--2", publisher="P", year="1999")
    assert render.citation(rows, "text").first()["citation"] == "Ann Bee and Dan Cee. “On X”. In: G. Eff (ed.), Proc, pp. 1-2. P, 1999."
    assert "<em>Proc</em>" in render.citation(rows).first()["citation"]
    assert render.citation(record(spark, entrytype="", title="")).first()["citation"] == ""


def test_stream_of_changes(spark, tmp_path):
    schema = "k long, ts long, v string"
    source, table = str(tmp_path / "in"), changes.SnapshotTable(spark, str(tmp_path / "t"), schema)

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes.keep_latest(spark.readStream.schema(schema).parquet(source), table, "k", ["ts"], str(tmp_path / "c")).awaitTermination()
        assert len(table.versions()) == n

    arrive(1, [(1, 1, "a"), (2, 5, "b"), (1, 2, "c")])
    arrive(2, [(2, 4, "late"), (3, 1, "new")])
    assert pairs(table.read(), "k", "v") == [(1, "c"), (2, "b"), (3, "new")]


def test_queries_have_oracles_and_stable_columns(spark):
    assert len(catalogue.QUERIES) >= 110 and set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_oracles_agree(spark):
    """Every query of the catalogue against its SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    for name, sql in catalogue.ORACLE.items():
        df = catalogue.QUERIES[name](spark, sf)
        want = c.sql(sql)
        columns = sorted(df.columns)
        assert sorted(want.columns) == columns, name
        rows = [tuple(r[want.columns.index(x)] for x in columns) for r in want.fetchall()]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()), name


def test_title_classes_are_whole(spark):
    """No group of equal texts is without its links, whatever its ids."""
    sf = "/root/testdata/sf0.001"
    classes = {r["id"]: r["first"] for r in catalogue.QUERIES["join17_title_classes"](spark, sf).filter("kind = 'document'").collect()}
    least = {}
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert len(classes) == len(rows)
    assert all(classes[i] == classes[least.setdefault(text, i)] <= least[text] for i, text in rows)
    assert any(i % 10 and least[text] % 10 and i != least[text] for i, text in rows)


def test_whole_tables_are_harvested_and_searched(spark):
    """Matches don't depend on remainders of keys, and all lines count as uses."""
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["res7_harvest_orders"](spark, sf).collect()
    assert {r["rule"] for r in got} == {"key", "dblp", "title", "new"}
    keys = {r["p_partkey"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert all((r["rule"] == "key") == (r["source_key"] in keys) for r in got)
    assert any(int(r["entry_key"]) % 10 for r in got if r["rule"] == "title")
    used = {r["l_orderkey"] for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    every = {r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    assert {r["id"] for r in catalogue.QUERIES["join6_orphan_orders"](spark, sf).collect()} == every - used
