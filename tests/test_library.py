import pytest

from quire.library import Library

BIB = """@proceedings{p1, title = {Proc of X}, year = {1999}, publisher = {Pub}}
@inproceedings{a1, title = {The Art}, author = {Bee, Ann}, crossref = {p1}, dblp = {k/1}}
@article{a2, title = {the {Art}!}, author = {Bee, Ann}, year = {1999}, url = {https://doi.org/10.1/x}}
@misc{m1, title = {Zed}, year = {19x9}}
"""


@pytest.fixture
def library(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text(BIB)
    (tmp_path / "in" / "b.bib").write_text("@misc{m1, title = {Other}}")
    base = Library.import_bib(spark, str(tmp_path / "in"))
    return base.add_to_groups(spark.createDataFrame([("g", "a1"), ("g", "a2")], "group_name string, entry_key string"))


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_queries(spark, library):
    assert pairs(library.find_entries("title", "ART"), "entry_key") == [("a1",), ("a2",)]
    assert pairs(library.find_entries("group", "G"), "entry_key") == [("a1",), ("a2",)]
    assert pairs(library.show_entry("m1"), "field", "value")[1:] == [("title", "Zed"), ("year", "19x9")]
    assert pairs(library.duplicates(), "keys") == [("a1|a2",)]
    assert ("m1", "year") in pairs(library.check(), "entry_key", "check")
    assert pairs(library.select('group "g*"\nkey "m1"'), "entry_key") == [("a1",), ("a2",), ("m1",)]
    assert dict(pairs(library.render_as_text(), "entry_key", "citation"))["a1"] == "Ann Bee. “The Art”. Pub, 1999."


def test_edits(spark, library):
    edited = library.set_fields(spark.createDataFrame([("m1", "year", "1999 "), ("m1", "title", ""), ("m1", "crossref", "m1"), ("m1", "pages", "1---2")], "entry_key string, field string, value string"))
    assert pairs(edited.show_entry("m1"), "field", "value") == [("entrytype", "misc"), ("pages", "1--2"), ("year", "1999")]
    assert ("a2", "10.1/x") in pairs(library.fix().entries.filter("field = 'doi'"), "entry_key", "value")
    gone = library.delete_entries(spark.createDataFrame([("a1",)], "entry_key string"))
    assert pairs(gone.groups, "entry_key") == [("a2",)] and gone.show_entry("a1").count() == 0


def test_merging_and_aliases(spark, library):
    merged = library.merge_entries(spark.createDataFrame([("a1", "a2")], "a string, b string"))
    assert dict(pairs(merged.show_entry("a1"), "field", "value"))["title"] == "The Art" and ("url", "https://doi.org/10.1/x") in pairs(merged.show_entry("a1"), "field", "value")
    assert pairs(merged.groups, "entry_key") == [("a1",)]
    found = merged.add_aliases(spark.createDataFrame([("old", "a2"), ("m1", "a1")], "alias string, canonical string")).resolve_keys(spark.createDataFrame([("old",), ("a2",), ("m1",), ("?",)], "key string"))
    assert pairs(found, "key", "entry_key") == [("?", ""), ("a2", "a1"), ("m1", "m1"), ("old", "a1")]


def test_sync_and_round_trip(spark, library, tmp_path):
    library.save(str(tmp_path / "v1"))
    base = Library.load(spark, str(tmp_path / "v1"))
    mine = base.set_fields(spark.createDataFrame([("m1", "year", "2000")], "entry_key string, field string, value string"))
    theirs = base.delete_entries(spark.createDataFrame([("a2",)], "entry_key string"))
    assert dict(pairs(mine.sync_status(theirs, base), "entry_key", "status")) == {"p1": "unchanged", "a1": "unchanged", "a2": "deleted-left", "m1": "right-changed"}
    assert dict(pairs(base.harvest(mine), "source_key", "rule"))["a1"] == "key"
    base.export_bib(str(tmp_path / "out"))
    assert pairs(Library.import_bib(spark, str(tmp_path / "out")).entries, "entry_key", "field", "value") == pairs(base.entries, "entry_key", "field", "value")
    got = base.apply_rules('if type = misc then add group "odd"')
    assert dict(pairs(got, "entry_key", "groups"))["m1"] == ["odd"]
