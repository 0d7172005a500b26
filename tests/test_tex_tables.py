import pytest
from pyspark.sql import functions as F

from quire.functions import tex
from quire.sources import tables


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("The UML and DeepRest", "The {UML} and {DeepRest}"),
        ("A study: The end", "A study: {The} end"),
        ("On C++ and X3 use", "On {C++} and {X3} use"),
        ("{Kept} As is", "{Kept} As is"),
        ("In the U.S.A. today", "In the {U.S.A.} today"),
        ("plain words, only", "plain words, only"),
        ("Use \\LaTeX now", "Use {\\LaTeX} now"),
        ("A  B", "A B"),
        ("", ""),
        (None, None),
    ],
)
def test_protect(title, want):
    assert tex.protect(title) == want
    assert tex.protect(tex.protect(title)) == want


def test_protected_rows(spark):
    rows = spark.createDataFrame([(1, "The UML"), (2, "The UML"), (3, None)], "k long, title string")
    assert sorted((r["k"], r["protected"]) for r in tex.protected(rows, "title").collect()) == [(1, "The {UML}"), (2, "The {UML}"), (3, None)]


def test_accents_and_escapes(spark):
    cases = {'G{\\"o}del and \\\'{e}': "Gödel and é", "\\v{S}ar{\\o}": "Šarø", "stra{\\ss}e": "straße", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in rows.select("x", tex.to_unicode(F.col("x")).alias("y")).collect()} == cases
    rows = spark.createDataFrame([("a\\unicode{233}b\\unicode{0x1F600}",), ("\\unicode{x}",)], "x string")
    assert [r[0] for r in rows.select(tex.unescape(F.col("x"))).collect()] == ["aéb😀", "\\unicode{x}"]


def test_hyphenation_and_places(spark):
    rows, words = spark.createDataFrame([(1, "Manuscripts  and (manuscripts)")], "k long, t string"), spark.createDataFrame([("manuscripts", "manu\\-scripts")], "word string, hinted string")
    assert tex.hyphenate(rows, "t", words, "k").first()["hyphenated"] == "Manu\\-scripts and (manu\\-scripts)"
    got = rows.select(tex.location(F.lit("Austin, {Tex.}"), {"Tex.": "Texas"}, {"Texas": "USA"}), tex.key_time(F.lit("k-2020-01-02-03-04-05")), tex.argument_keys(F.lit("\\cite{a, b}"))).first()
    assert list(got) == ["Austin, Texas, USA", "2020-01-02", ["a", "b"]]


def test_registry(spark, tmp_path):
    r, path = tables.Registry(spark), str(tmp_path)
    rows = spark.createDataFrame([("b", "2"), ("a", "1")], "k string, v string")
    r.add(tables.Table("t", "k string, v string", ["k"], lambda: F.col("v") != "", ["u"]), rows)
    r.add(tables.Table("u", "k string", ["k"], cascades=["t"]), rows.select("k"))
    assert r.export(path) == ["t", "u"] and r.export(path) == []
    assert r.load(path, ["t"]) == ["t", "u"]
    assert sorted(map(tuple, r.rows["t"].collect())) == [("a", "1"), ("b", "2")]
    r.replace("t", spark.createDataFrame([("c", "")], "k string, v string"))
    assert r.export(f"{path}/2") == ["t"]
    with pytest.raises(tables.InvalidImport):
        r.load(f"{path}/2", ["t"])


def test_metadata_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("e", "p", "1"), ("e", "q", "2"), ("f", "p", "3")], "entry_key string, property string, value string")
    back = tables.read_metadata(tables.metadata_json(rows))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF" + (b"1" if name != "c" else b"2"))
    hashes = tables.file_hashes(spark, str(tmp_path))
    crossref = spark.createDataFrame([("b", "a")], "entry_key string, parent string")
    assert [(r["keys"], r["related"]) for r in tables.duplicate_files(hashes, crossref).collect()] == [(["a", "b"], True)]


def test_stale(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2020-01-01'), (2, TIMESTAMP '2020-03-01'), (3, NULL) AS t(k, at)")
    assert sorted(r["k"] for r in tables.stale(rows, "at", F.lit("2020-03-15").cast("date")).collect()) == [1, 3]
