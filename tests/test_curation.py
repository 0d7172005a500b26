from pyspark.sql import functions as F

from quire.operators import curation as cu


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, schema, *rows):
    return spark.createDataFrame([*rows], schema)


def test_garbled(spark):
    cases = {"Bee, Ann": "", "King, Jr., Martin": "", "A, B, C": "commas", "A, B, C, D": "commas", "{A": "braces", "Mu\\\"": "accent", "A and B": "several", "{A and B}": ""}
    rows = table(spark, "x string", *[(k,) for k in cases])
    assert {r["x"]: r["y"] for r in rows.select("x", cu.garbled(F.col("x")).alias("y")).collect()} == cases


def test_mappings(spark):
    entries = table(spark, "entry_key string, field string, value string", ("1", "address", "NYC"), ("2", "address", "NYC"), ("3", "crossref", "x"))
    generic = table(spark, "field string, challenger string, winner string", ("address", "NYC", "New York"), ("crossref", "x", "3"))
    specific = table(spark, "entry_key string, field string, challenger string, winner string", ("2", "address", "New York", "Albany"))
    assert pairs(cu.map_values(entries, generic, specific), "entry_key", "value") == [("1", "New York"), ("2", "Albany"), ("3", "")]


def test_aliases(spark):
    rows = table(spark, "entry_key string, author string, editor string, publisher string, title string, year string", ("1", "Bee, Ann and C", "", "", "The Art of Bees", "1999"), ("2", "", "", "", "", ""), ("3", "", "Van Eff, G.", "", "x", "2000"))
    assert pairs(cu.alias_base(rows), "entry_key", "base") == [("1", "Bee1999"), ("2", "anon"), ("3", "Eff2000")]
    assert pairs(cu.alias_proposals(rows), "entry_key", "rank", "alias")[:2] == [("1", 1, "Bee1999-art"), ("1", 2, "Bee1999-bees")]


def test_parents(spark):
    children = table(spark, "entry_key string, crossref string, venue string, year string", ("a", "p1", "v", "1"), ("b", "", "v", "1"), ("c", "", "w", "1"), ("d", "", "z", "1"))
    parents = table(spark, "parent string, venue string, year string, volume string, title string", ("p1", "v", "1", "2", ""), ("p0", "v", "1", "1", ""), ("q-2", "w", "1", "", "x"), ("q-1", "w", "1", "3", "x"), ("r", "z", "1", "", ""))
    assert pairs(cu.parent_candidates(children, parents), "entry_key", "rule", "parent") == [("a", "claim", "p1"), ("b", "volume", "p0"), ("c", "suffix", "q-1"), ("d", "ask", "")]


def test_policies(spark):
    rows = table(spark, "entry_key string, field string, value string", ("1", "url", "u"), ("2", "url", "u"), ("2", "urldate", "2020-01-01"), ("1", "entrytype", "misc"), ("2", "note", "N"))
    assert pairs(cu.export_policy(rows), "entry_key", "field") == [("1", "entrytype"), ("2", "note"), ("2", "url"), ("2", "urldate")]
    assert ("2", "note", "N. Accessed on 2020-01-01") in pairs(cu.export_policy(rows, date_in_note=True), "entry_key", "field", "value")
    assert pairs(cu.export_policy(rows, include=["url"], url_needs_date=False), "entry_key", "field") == [("1", "entrytype"), ("1", "url"), ("2", "url")]
    file = table(spark, "entry_key string, field string, value string", ("2", "url", "u"))
    assert pairs(cu.fields_to_clear(rows, file, ["entrytype"]), "entry_key", "field") == [("2", "note"), ("2", "urldate")]


def test_group_blocks(spark):
    plist = "BibDesk Static Groups{<plist><array><dict><key>group name</key>\n<string>g1</string><key>keys</key><string>a,b</string></dict></array></plist>}"
    lines = "jabref-meta: grouping:\n0 AllEntriesGroup:;\n1 StaticGroup:g2\\;0\\;c\\;d\\;;"
    assert pairs(cu.group_blocks(table(spark, "value string", (plist,), (lines,))), "group_name", "entry_key") == [("g1", "a"), ("g1", "b"), ("g2", "c"), ("g2", "d")]


def test_names_works_buckets(spark):
    got = cu.name_pairs(table(spark, "a string, b string", ("X and Y", "X and Z"), ("X", "X and Y"))).collect()
    assert [(r["relation"], r["differing"] and [(d["position"], d["theirs"]) for d in r["differing"]]) for r in got] == [("mixed", [(2, "Z")]), ("subset", None)]
    works = table(spark, "orcid string, doi string", ("o", "10.1/A"), ("o", "10.1/b"))
    entries = table(spark, "entry_key string, field string, value string", ("1", "doi", "10.1/a"))
    assert pairs(cu.works_missing(works, entries, table(spark, "doi string", ("10.2/x",))), "orcid", "doi") == [("o", "10.1/b")]
    titles = table(spark, "entry_key string, title string", ("1", "T"), ("2", "t!"), ("3", "{T}"), ("4", "u"))
    known = table(spark, "a string, b string", ("2", "1"), ("1", "2"), ("1", "4"))
    assert pairs(cu.unresolved_buckets(titles, known), "bucket", "n", "open") == [("t", 3, 2)]
    a = table(spark, "key string, target string", ("k", "x"), ("m", "y"))
    assert pairs(cu.contradictions(a, table(spark, "key string, target string", ("k", "z"), ("m", "y"))), "key") == [("k",)]
    assert cu.overlaid('{"a": 1, "old": 2}', '{"a": 3}', {"old": "new"}) == {"a": 3, "new": 2}
