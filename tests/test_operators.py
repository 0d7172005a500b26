"""Operators on small relations, with the traps of their semantics."""

import pytest
from pyspark.sql import functions as F

from quire.functions import normalise as fn
from quire.operators import graph, relational as rel, resolve, store
from quire.plans import rules
from quire.sources import bib


def values(spark, f, cases):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i long, x string")
    got = {r["i"]: r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).collect()}
    for i, (a, want) in enumerate(cases):
        assert got[i] == want, (a, got[i], want)


def entries(spark, rows):
    return spark.createDataFrame(rows, "entry_key string, field string, value string")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (fn.pages, [("12-12, 3:1-3:10, 5---9", "12, 3:1--10, 5--9"), (None, ""), ("7", "7")]),
        (fn.number, [("3---4", "3--4"), ("a--b", "a-b"), (None, "")]),
        (fn.doi, [("https://doi.org/10.1/a\\_b", "10.1/a_b"), ("doi: 10.1/x", "10.1/x"), ("10.1/{_}", "10.1/_")]),
        (fn.issn, [("ISSN: 12345678, 87654321", "1234-5678"), ("abc", "abc"), ("1234-567X", "1234-567X")]),
        (fn.date, [("13.4.2026", "2026-04-13"), ("4.5.2026", "2026-04-05"), ("4.13.2026", "2026-04-13"), ("April 23, 2026", "2026-04-23"), ("2 May 2020", "2020-05-02"), ("soon", "soon")]),
        (fn.title_index, [("The {UML}: a Re-View!", "theumlareview"), ("\\emph{A} B", "ab"), (None, "")]),
        (fn.et_al, [("Ann and et al.", "Ann and others"), ("Ann et.al.", "Ann and others"), ("Etal", "Etal")]),
        (fn.compress_initials, [("Proper, H. A.", "Proper, H.A."), ("Proper, H. A. B.", "Proper, H.A.B.")]),
        (fn.first_last, [("Proper, Erik", "Erik Proper"), ("King, Jr, Martin", "Martin King Jr."), ("Plato", "Plato")]),
        (fn.split_names_braced, [("A and {B and C} and D", ["A", "{B and C}", "D"]), ("", []), ("{A and B", ["{A and B"])]),
        (fn.split_names, [("A and {B and C}", ["A", "{B", "C}"])]),
        (fn.group_list, [("b, a,,b", "a, b")]),
        (fn.plain, [("{}", ""), (" x ", "x")]),
        (fn.keywords, [("The art of 3 Arts: the Art", ["art", "arts"])]),
        (fn.to_html, [("\\emph{A}--B & {C}", "<em>A</em>&ndash;B &amp; C")]),
    ],
)
def test_normalisers(spark, f, cases):
    values(spark, f, cases)


def test_normalisers_are_idempotent(spark):
    rows = spark.createDataFrame([("12-12, 5---9",), ("doi:10.1/a",), ("13.4.2026",), ("b, a",)], "x string")
    for f in (fn.pages, fn.doi, fn.date, fn.group_list, fn.title_index, fn.number):
        got = rows.select(f(F.col("x")).alias("a"), f(f(F.col("x"))).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), f


def test_substring_has_no_wildcards(spark):
    rows = entries(spark, [("1", "title", "100% of a_b"), ("2", "title", "100 of axb"), ("3", "note", "100%")])
    assert pairs(rel.find_by_field(rows, "title", "100%"), "entry_key") == [("1",)]
    assert pairs(rel.find_by_field(rows, "title", "A_B"), "entry_key") == [("1",)]


def test_live_needs_a_type(spark):
    rows = entries(spark, [("1", "entrytype", "book"), ("1", "title", "x"), ("2", "title", "x"), ("3", "entrytype", "")])
    assert pairs(rel.live(rows), "entry_key", "field") == [("1", "entrytype"), ("1", "title")]


@pytest.mark.parametrize(("pattern", "name", "match"), [("a*", "ab", True), ("a*", "a/b", False), ("?b", "ab", True), ("[!a]b", "ab", False), ("[ab]c", "bc", True), ("a.c", "abc", False)])
def test_glob(spark, pattern, name, match):
    rows = spark.createDataFrame([(name, 1)], "group_name string, entry_key long")
    assert bool(rel.find_by_glob(rows, pattern).count()) is match


def test_year_window_is_strict(spark):
    rows = spark.createDataFrame([("2000", "2002"), ("2000", "2003"), ("2000", "n.d.")], "a string, b string")
    assert [r[0] for r in rows.select(rel.within_years(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_flatten_chains_and_cycles(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "X"), ("Z", "X"), ("S", "S")], "alias string, canonical string")
    assert pairs(graph.flatten(edges), "alias", "canonical") == [("A", "C"), ("B", "C")]
    assert pairs(graph.on_cycles(edges, "alias", "canonical"), "alias") == [("S",), ("X",), ("Y",), ("Z",)]
    flat = graph.flatten(edges)
    assert pairs(graph.flatten(flat), "alias", "canonical") == pairs(flat, "alias", "canonical")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(pairs(graph.components(links, "a", "b"), "node", "root"))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_saturate_keeps_the_first(spark):
    facts = entries(spark, [("1", "a", "x")])
    rule = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", "z"), ("c", "z", "a", "other")], "source_field string, source_value string, target_field string, target_value string")
    assert pairs(graph.saturate(facts, rule), "field", "value") == [("a", "x"), ("b", "y"), ("c", "z")]


def test_three_way_is_symmetric(spark):
    t = lambda *x: spark.createDataFrame([*x], "k long, v string")
    base, left, right = t((1, "a"), (2, "a"), (3, "a")), t((1, "b"), (2, "a"), (4, "n")), t((1, "b"), (2, "c"), (3, "a"))
    there = dict(pairs(store.three_way(base, left, right, "k", "v"), "k", "status"))
    assert there == {1: "same-change", 2: "right-changed", 3: "deleted-left", 4: "new-left"}
    swap = lambda s: s.replace("left", "#").replace("right", "left").replace("#", "right")
    assert dict(pairs(store.three_way(base, right, left, "k", "v"), "k", "status")) == {k: swap(v) for k, v in there.items()}


def test_membership_cases(spark):
    t = lambda *x: spark.createDataFrame([(y,) for y in x], "k long")
    got = store.merge_memberships(t(1, 3, 5), t(2, 4, 5), t(3, 4), ["k"])
    assert dict(pairs(got, "k", "action")) == {1: "add-to-db", 2: "add-to-bib", 3: "remove-from-bib", 4: "remove-from-db"}


def test_coalesce_upsert(spark):
    t = lambda *x: spark.createDataFrame([*x], "k long, v string")
    assert pairs(store.coalesce_upsert(t((1, "a"), (2, "b")), t((1, ""), (2, "c"), (3, "d")), ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_free_alias(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "z"), ("c", 1, "z")], "entry_key string, rank int, alias string")
    # b loses x to a in the first round, and z was given to c in the same one
    assert pairs(resolve.free_alias(rows), "entry_key", "alias") == [("a", "x"), ("c", "z")]


def test_rules_see_earlier_groups(spark):
    records = spark.createDataFrame([("1", {"entrytype": "book", "year": "1999"}, ["old"])], "entry_key string, fields map<string,string>, groups array<string>")
    script = 'if type = book then add group "b" # comment\nif in group "b" and field year < 2000 then warn "a # b"\nif in group "old" then remove group "old"\nif not field x is empty then warn "no"'
    r = rules.apply_rules(records, script).first()
    assert (r["groups"], r["warnings"]) == (["b"], ["a # b"])
    with pytest.raises(rules.RuleError):
        rules.apply_rules(records, "if nonsense then warn x")


def test_bib_scan_recovers(spark):
    text = '@string{p = "Press"}\n@book{k1, Title = {A {B}}, publisher = p # " X", month = jan,}\n@book{k2, title = {never closed\n@article(k3, year = 1999)\n@comment{c {d}}'
    rows = bib.parse(spark.createDataFrame([("f", text)], "path string, text string"))
    got = pairs(rows, "entry_key", "field", "value")
    assert ("k1", "title", "A {B}") in got and ("k1", "publisher", "Press X") in got and ("k1", "month", "January") in got
    assert ("k3", "year", "1999") in got and any(f == "_error" for _, f, _ in got) and ("", "_comment", "c {d}") in got


def test_resolver_cascade(spark):
    row = lambda f, a, b, p=0, e=False: (f, a, b, p, 0, e, False)
    cases = [row("title", "a", "a"), row("title", "", "b"), row("date", "2020-01-02", "2020-01-01"), row("title", "x", "y", 100), row("title", "x", "y", 0, True), row("year", "1", "2"), row("title", "x", "y"), row("note", "A b", "ab")]
    rows = spark.createDataFrame(cases, "field string, current string, challenger string, current_priority int, challenger_priority int, edited boolean, required boolean")
    got = [(r["rule"], r["value"], r["needs_review"]) for r in resolve.resolve_fields(rows).collect()]
    assert got == [("equal", "a", False), ("was-empty", "b", False), ("earlier-date", "2020-01-01", False), ("lower-priority", "x", False), ("edited", "x", False), ("auto-accept", "2", False), ("ask", "x", True), ("same-index", "A b", False)]


def test_line_formats(spark):
    lines = spark.createDataFrame([("a;b",), ("c # x",), ("",), ('orcid "0000"; # Ann',)], "value string")
    assert pairs(bib.keys_file(lines.limit(3)), "local", "canonical") == [("a", "b"), ("c", "c")]
    assert pairs(bib.watch_file(lines), "kind", "value", "comment") == [("orcid", "0000", "Ann")]
