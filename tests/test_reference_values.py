"""Values that follow from the specification of each function, case by case; checks and languages on small records."""

import io
import gzip

import pytest
from pyspark.sql import functions as F

from quire.functions import normalise as fn
from quire.operators import enrich, entry_checks, lookups, relational as rel, resolve, upkeep
from quire.plans import rules
from quire.sources import bib, dblp
from tests.test_operators import entries, pairs, values


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (fn.pages, [("12-12, 3:1-3:10, 5---9", "12, 3:1--10, 5--9"), ("1 - 5", "1--5"), ("1--2--3", "1-2-3"), ("3:5-4:10", "3:5--4:10"), ("2:3-7", "2:3--7"), ("", "")]),
        (fn.number, [("3---4", "3--4"), ("a--b", "a-b")]),
        (fn.doi, [("https://doi.org/10.1/a\\_b", "10.1/a_b"), ("http://any.host.org/10.1/x", "10.1/x"), ("10.1/{$\\_$}x", "10.1/_x"), ("10.1/{_}", "10.1/_")]),
        (fn.issn, [("ISSN: 12345678, 87654321", "1234-5678"), ("1234567X 11112222", "1234-567X"), ("12-3", "12-3")]),
        (fn.isbn, [("ISBN-13: 978-3-16-148410-0, 1", "978-3-16-148410-0"), ("isbn 316148410X", "316148410X"), ("12", "12")]),
        (fn.date, [("13.4.2026", "2026-04-13"), ("4.5.2026", "2026-04-05"), ("2026.4.5", "2026-04-05"), ("April 23, 2026", "2026-04-23"), ("23 April 2026", "2026-04-23"), ("5 Apr 2026", "2026-04-05"), ("99.99.2026", "99.99.2026"), ("2026-13-45", "2026-13-45"), ("32 May 2026", "32 May 2026")]),
        (fn.title_index, [("The {UML}: a Re-View!", "theumlareview"), ("C++ in C", "c++inc"), ("C# in C", "c#inc"), ("C in C", "cinc"), ("Stra\\ss e", "strase"), ("\\emph{A} \\textbf{B}", "ab"), ("\\unicode{x41}z", "z"), ("\\AA rhus", "aarhus"), ("R\\&D", "r&d"), ("\\backslash x", "x")]),
        (fn.compress_initials, [("Proper, H. A.", "Proper, H.A."), ("H. A. Proper", "H. A. Proper"), ("Doe, J. A. B.", "Doe, J.A.B.")]),
        (fn.first_last, [("Proper, Erik", "Erik Proper"), ("Smith, Jr, Ann", "Ann Smith Jr."), ("Smith, Jr., Ann", "Ann Smith Jr."), ("Plato", "Plato")]),
        (fn.url, [("http://hdl.handle.net/1/2", "https://doi.org/1/2"), ("https://onlinelibrary.wiley.com/doi/10.1/x", "https://doi.org/10.1/x"), ("http://arxiv.org/abs/hep-th/9901001", "https://doi.org/10.48550/arXiv.hep-th/9901001"), ("http://ceur-ws.org/a%5Cb", "https://ceur-ws.org/a_b"), ("https://www.mitpressjournals.org/doi/abs/1", "https://doi.org/1")]),
        (fn.keywords, [("Proceedings of the International Workshop on C++ and UML", ["c", "uml"]), ("As into 3d art", ["as", "into", "art"])]),
        (fn.split_unbraced, [("John {Smith Kline} x", ["John", "{Smith Kline}", "x"]), ("a  b", ["a", "b"]), ("{a b", ["{a b"]), ("", [])]),
        (rel.is_chapter, [("IIII", False), ("VX", False), ("Xii", True), ("MCMXCIX", True), ("12", True), ("", False)]),
        (rel.is_isbn, [("978-3-16-148410-0", True), ("316148410X", True), ("3161484", False)]),
        (fn.clean_jr_date, [("2020-01-02 03:04:05 +0100", "2020-01-02T03:04:05")]),
        (fn.repaired_bibtex, [("@a{k, month=Nov, t={x} }", "@a{k, month={Nov}, t={x} }")]),
        (lambda x: fn.located(x, {"USA": "United States"}), [("Conf, Ohio, USA", "Conf, Ohio, United States"), ("USA", "United States")]),
        (enrich.to_latex, [("a <i>b</i> & c", "a {\\emph{b}} \\& c")]),
        (enrich.compare_encoding, [("{\\'{e}} & a_b #1 5%", "{\\'e} \\& a{\\_}b {\\#}1 5{\\%}"), ("x_{2} \\& {\\_}", "x_{2} \\& {\\_}")]),
    ],
)
def test_values(spark, f, cases):
    values(spark, f, cases)


def test_every_entry_gets_an_alias_while_it_has_proposals(spark):
    rows = [(f"e{i}", r, f"a{r}") for i in range(7) for r in range(7)]
    got = pairs(resolve.free_alias(spark.createDataFrame(rows, "entry_key string, rank int, alias string")), "entry_key", "alias")
    assert len(got) == 7 and len({a for _, a in got}) == 7
    assert resolve.free_alias(spark.createDataFrame([], "entry_key string, rank int, alias string")).count() == 0


def test_reading_goes_on_at_any_at_sign(spark):
    text = spark.createDataFrame([("p", "@book{a, title = {x}, 5} @article{b, title = {y}}")], "path string, text string")
    rows = bib.parse(text)
    assert [r["value"] for r in rows.filter("entry_key = 'b' AND field = 'title'").collect()] == ["y"] and rows.filter("field = '_error'").count() == 1


def test_all_record_kinds_of_a_dump_are_read_as_a_stream(spark, tmp_path):
    kinds = ["article", "inproceedings", "proceedings", "book", "incollection", "inbook", "phdthesis", "mastersthesis", "www", "data", "misc"]
    xml = "<dblp>" + "".join(f'<{k} key="{k}/{i}" mdate="2020-01-0{i}"><title>T{i}.</title></{k}>' for k in kinds for i in range(1, 4)) + "</dblp>"
    raw = xml.encode("iso-8859-1")
    want = [*dblp.records(xml)]
    for source in (raw, gzip.compress(raw)):
        assert [*dblp.stream(io.BytesIO(source), block=64)] == want
    (tmp_path / "d.xml.gz").write_bytes(gzip.compress(raw))
    got = dblp.read(spark, str(tmp_path / "d.xml.gz"))
    assert {r["entrytype"] for r in got.collect()} == set(kinds) and got.filter("field = 'title'").count() == 33
    dblp.write_json(got, str(tmp_path / "json"), buckets=4)
    found = dblp.look_up(spark, str(tmp_path / "json"), ["book/1", "none/1"], buckets=4).collect()
    assert [r["record_key"] for r in found] == ["book/1"] and found[0]["fields"]["title"] == "T1"
    links = dblp.title_links(got)
    dblp.write_title_links(links, str(tmp_path / "links"))
    h = spark.range(1).select(fn.title_hash(F.lit("T1"))).first()[0]
    assert pairs(dblp.read_title_links(spark, str(tmp_path / "links"), [h]), "record_key") == sorted((f"{k}/1",) for k in kinds)
    assert pairs(dblp.read_title_links(spark, str(tmp_path / "links")), "hash", "record_key") == pairs(links, "hash", "record_key")


def record(key, **fields):
    return {"entry_key": key, **fields}


def checked(spark, rows, **settings):
    fields = ["entry_key", *entry_checks.FIELDS]
    df = spark.createDataFrame([tuple(r.get(f, "") for f in fields) for r in rows], ", ".join(f"{f} string" for f in fields))
    out, warnings = entry_checks.check_entries(df, entry_checks.Settings(**settings))
    found = {}
    for r in warnings.collect():
        found.setdefault(r["entry_key"], []).append(r["check"])
    return {r["entry_key"]: r for r in out.collect()}, found


def test_steps_of_the_entry_check(spark):
    rows = [
        record("k", entrytype="conference", title="t", crossref="k"),
        record("jstor", entrytype="article", title="t", doi="10.2307/123"),
        record("half", entrytype="article", title="t", eprint="1"),
        record("how", entrytype="misc", title="t", howpublished="\\url{https://a.org/x} [accessed 14 June 2013]"),
        record("other", entrytype="misc", title="t", url="https://b.org", note="\\url{https://a.org/x}"),
        record("later", entrytype="misc", title="t", url="https://b.org", urldate="2020-01-01", note="x; accessed February 24, 2025"),
        record("parent", entrytype="proceedings", title="P", publisher="Pub", isbn=""),
        record("child", entrytype="inproceedings", title="c", crossref="parent", booktitle="P", year="2001", publisher="Pub", doi="10.1007/978-3-16-148410-0", url="u"),
        record("lost", entrytype="inbook", title="c", crossref="nowhere"),
        record("wrong", entrytype="article", title="c", crossref="parent"),
        record("moved", entrytype="article", title="c", isbn="1234-5678"),
        record("day", entrytype="misc", title="t", url="https://b.org", urldate="Zugegriffen: 03.04.2021"),
        record("gone", entrytype="misc", title="t", withdrawn="2020-01-01", author="A"),
        record("red", entrytype="misc", title="t", url="https://doi.org/10.1/X", doi="10.1/x", urldate="2020-01-01"),
        record("alias", entrytype="misc", title="t", preferredalias="Bee1999"),
    ]
    got, found = checked(spark, rows)
    assert got["k"]["entrytype"] == "inproceedings" and got["k"]["crossref"] == "" and "crossref" in found["k"]
    assert (got["jstor"]["eprinttype"], got["jstor"]["eprint"]) == ("jstor", "123") and got["half"]["eprint"] == ""
    assert (got["how"]["url"], got["how"]["howpublished"], got["how"]["urldate"], got["how"]["year"]) == ("https://a.org/x", "", "2013-06-14", "2013")
    assert got["other"]["note"] == "" and "note" in found["other"]
    assert (got["later"]["urldate"], got["later"]["note"]) == ("2025-02-24", "x;")
    assert (got["child"]["booktitle"], got["child"]["year"], got["child"]["publisher"]) == ("", "", "")
    assert (got["parent"]["year"], got["parent"]["booktitle"], got["parent"]["isbn"]) == ("2001", "P", "978-3-16-148410-0") and got["child"]["doi"] == ""
    assert "crossref" in found["lost"] and "crossref" in found["wrong"]
    assert (got["moved"]["issn"], got["moved"]["isbn"]) == ("1234-5678", "") and got["day"]["urldate"] == "2021-04-03"
    assert "withdrawn" in found["gone"] and (got["red"]["url"], got["red"]["urldate"]) == ("", "") and "alias" in found["alias"]
    empty, none = checked(spark, [])
    assert not empty and not none


def test_settings_of_the_entry_check(spark):
    rows = [record("Q-2020-01-02-03-04-05", entrytype="article", title="", chapter="3", url="https://a.org", pages="1"), record("bad", entrytype="poem", title="t")]
    status = spark.createDataFrame([("https://a.org", "parked")], "url string, status string")
    titles = spark.createDataFrame([("https://a.org", "Told")], "url string, title string")
    got, found = checked(spark, rows, key_prefix="Q", allowed={"article": ["title", "url", "pages"]}, ignored=["chapter"], page_status=status, page_titles=titles, mappings=[("pages", "1", "note", "one")])
    first = got["Q-2020-01-02-03-04-05"]
    assert (first["chapter"], first["title"], first["note"]) == ("", "Told", "one") and found["Q-2020-01-02-03-04-05"] == ["url"] and found["bad"] == ["key", "type"]


def test_resolver_rules(spark):
    cases = [
        ("title", "{A}", "A long title of a thing", "abbreviation", "A long title of a thing"), ("title", "A.", "B", "ask", "A."), ("crossref", "", "x", "crossref-was-empty", "x"), ("crossref", "y", "x", "crossref", "y"),
        ("url", "u", "https://doi.org/10.1/X", "redundant-url", ""), ("doi", "10.1/a", "10.1/A", "doi-case", "10.1/A"), ("doi", "10.1/A", "10.1/a", "doi-case", "10.1/A"), ("modificationdate", "2021", "2020", "earlier-date", "2020"),
        ("publisher", "A", "B", "auto-accept", "B"), ("volume", "1", "2", "ask", "1"), ("note", "m", "n", "mapping", "n"), ("groups", "b", "a, b", "groups", "a, b"),
    ]
    rows = [(i, f, a, b, 0, 0, False, False, "10.1/x", "n" if f == "note" else "") for i, (f, a, b, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, field string, current string, challenger string, current_priority int, challenger_priority int, edited boolean, required boolean, doi string, mapped string")
    got = {r["i"]: (r["rule"], r["value"]) for r in resolve.resolve_fields(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(x[3], x[4]) for x in cases]


def test_rule_chains(spark):
    rows = spark.createDataFrame([("1", {"volume": "3"}, ["a"]), ("2", {"volume": "9"}, []), ("3", {}, ["a", "b"])], "entry_key string, fields map<string,string>, groups array<string>")
    script = 'define s a b\nif field volume = "3" then add group "x" else if field volume > 5 then warn "big" else remove group "a"\nif groups several in s then warn "both"'
    got = {r["entry_key"]: (r["groups"], r["warnings"]) for r in rules.apply_rules(rows, script).collect()}
    assert got == {"1": (["a", "x"], []), "2": ([], ["big"]), "3": (["b"], [])}
    for bad in ("if then", 'if field a = "b"', 'if field a = "b" then warn "x" else warn "y" else warn "z"'):
        with pytest.raises(rules.RuleError):
            rules.apply_rules(rows, bad)


def test_empty_tables(spark):
    none = entries(spark, [])
    for f in (rel.live, rel.ghosts, lookups.field_names, lambda x: rel.duplicate_groups(x, "title"), lambda x: rel.records(x, ["title"]), lambda x: fn.fingerprint(x)):
        assert f(none).count() == 0
    assert lookups.classes(none, "entry_key", F.col("value")).count() == 0
    start = spark.createDataFrame([(1,)], "k int")
    assert pairs(upkeep.drain(start, lambda x: x.filter("k < 4").select((F.col("k") + 1).alias("k")), "k"), "k") == [(1,), (2,), (3,), (4,)]
    assert upkeep.drain(start.limit(0), lambda x: x, "k").count() == 0


def test_maps_and_conflicts(spark):
    aliases = spark.createDataFrame([("a", "b"), ("c", "d")], "alias string, canonical string")
    changes = spark.createDataFrame([("b", "z"), ("c", "")], "alias string, canonical string")
    assert pairs(upkeep.map_names(aliases, changes), "alias", "canonical") == [("a", "z"), ("b", "z")]
    have = spark.createDataFrame([("10.1/a", "e1")], "doi string, entry_key string")
    new = spark.createDataFrame([("https://doi.org/10.1/A", "e2"), ("10.1/b", "e3"), ("10.1/a", "e1")], "doi string, entry_key string")
    kept, conflicts = upkeep.add_doi_aliases(have, new.filter("entry_key <> 'e1'"))
    assert pairs(kept, "doi", "entry_key") == [("10.1/a", "e1"), ("10.1/b", "e3")] and pairs(conflicts, "doi", "entry_key", "kept") == [("10.1/a", "e2", "e1")]
    config = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert pairs(upkeep.set_config(config, spark.createDataFrame([("a", ""), ("c", "3")], "key string, value string")), "key", "value") == [("b", "2"), ("c", "3")]
