"""Absorption, preferred aliases, character maps, synchronisation and the table log."""

import pytest
from pyspark.sql import functions as F

from quire.functions import maps
from quire.functions import normalise as fn
from quire.library import Library
from quire.operators import absorb, enrich, entry_checks, keys, sync, upkeep
from quire.operators.log import TableLog
from quire.operators.store import spread
from quire.scratch import fresh_dir
from quire.sources import bib


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


# --- absorption

PEOPLE = [("p1", "Bee, Ann"), ("p1", "Ann B. Bee"), ("p2", "Bee, Andrew"), ("p3", "Cee, Carl"), ("p3", "Shared, Name"), ("p4", "Shared, Name"), ("p5", "Dee, Dora"), ("p6", "Twin, Tom")]
PERSONS = [("p1", "o1"), ("p2", "o2"), ("p3", "o3"), ("p4", ""), ("p5", "o5"), ("p6", None), ("p7", "o7")]


def test_absorb(spark):
    known = [
        ("1", "Ann Bee", "", ""), ("2", "Bee, A.", "p1", ""), ("3", "X", "", "o1"),  # one person by name, key and ORCID
        ("4", "Andrew Bee", "p3", ""),  # key of another: stays with its key, to be split
        ("5", "Shared, Name", "", ""),  # a name of two persons says nothing
        ("6", "Dee, Dora", "", "o9"),  # another ORCID than the person's: a conflict, not a merge
        ("7", "Twin, Tom", "", ""), ("8", "Tom Twin", "", ""), ("9", "Nobody", "", ""), ("10", "", None, None), ("10", "", None, None),
    ]
    args = table(spark, known, "id string, name string, dblp_key string, orcid string"), table(spark, [("3", "Bee, Ann")], "id string, name string"), table(spark, PEOPLE, "person string, name string"), table(spark, PERSONS, "person string, orcid string")
    got = absorb.absorb(*args)
    assert pairs(got.merges, "old", "new") == [("1", "2"), ("3", "2"), ("8", "7")]
    assert pairs(got.keys, "id", "person") == [("7", "p6")]
    assert pairs(got.orcids, "id", "orcid") == [("2", "o1"), ("4", "o3")]
    assert pairs(got.splits, "id", "person", "other") == [("4", "p3", "p2")]
    assert pairs(got.conflicts, "id", "orcid", "other") == [("6", "o9", "o5")]
    names = pairs(got.names, "id", "name")
    assert ("2", "Ann B. Bee") in names and ("2", "Ann Bee") in names and ("4", "Cee, Carl") in names and not [n for i, n in names if i in "1356"]
    # known to be different: only one of the two goes with the person
    apart = absorb.absorb(*args, different=table(spark, [("7", "8")], "a string, b string"))
    assert [m for m in pairs(apart.merges, "old", "new") if m[0] in "78"] == [] and len(pairs(apart.keys, "id")) == 1
    none = absorb.absorb(*[a.limit(0) for a in args])
    assert all(df.count() == 0 for df in (none.merges, none.keys, none.orcids, none.names, none.splits, none.conflicts))


def test_split_roles(spark):
    roles = table(spark, [("e1", "author", 1, "4"), ("e2", "author", 1, "4"), ("e3", "author", 1, "4"), ("e1", "author", 2, "9")], "entry_key string, role string, position int, contributor_id string")
    splits = table(spark, [("4", "p3", "p2"), ("4", "p3", "p8")], "id string, person string, other string")
    publications = table(spark, [("p2", "e1"), ("p2", "e2"), ("p3", "e2"), ("p8", "e1")], "person string, entry_key string")
    known = table(spark, [("4", "Andrew Bee", "p3"), ("9", "Z", "")], "id string, name string, dblp_key string")
    people = table(spark, PEOPLE, "person string, name string")
    moved, added = absorb.split_roles(roles, splits, publications, known, people)
    # e1 is the other's alone, e2 is both's
    assert pairs(moved, "entry_key", "position", "contributor_id") == [("e1", 1, "dblp:p2"), ("e1", 2, "9"), ("e2", 1, "4"), ("e3", 1, "4")]
    assert pairs(added, "id", "name", "dblp_key") == [("dblp:p2", "Bee, Andrew", "p2")]
    holder = known.unionByName(table(spark, [("20", "Bee", "p2")], "id string, name string, dblp_key string"))
    moved, added = absorb.split_roles(roles, splits, publications, holder, people)
    assert ("e1", 1, "20") in pairs(moved, "entry_key", "position", "contributor_id") and added.count() == 0


# --- checks through the library, keys


def test_preferred_aliases(spark):
    bibtex = """@article{a, author = {van Bee, Ann and C, D}, year = {2002}, title = {The {Graphs} of Flow}}
@article{b, author = {Ann {van Bee}}, year = {2002}, title = {Graphs}}
@article{c, author = {van Bee, Ann}, year = {2002}, title = {Graphs of Flow}, preferredalias = {Wrong Shape}}
@article{d, author = {van Bee, Ann}, year = {2002}, title = {Any}, preferredalias = {vanbee2002any}}
@misc{e, author = {Ann}, title = {No year}}
@proceedings{p, editor = {Dee, E.}, year = {1999}, title = {Proceedings of X}, dblp = {conf/icis/1999}}
@inproceedings{q, crossref = {p}, author = {{Group 20}}, title = {Modelling}}
@inproceedings{r, crossref = {p}, title = {Alone}}
"""
    rows = bib.parse(table(spark, [("f", bibtex)], "path string, text string")).filter("entry_key <> ''").select("entry_key", "field", "value")
    made = Library.of(rows).with_preferred_aliases()
    got = dict(pairs(made.entries.filter("field = 'preferredalias'"), "entry_key", "value"))
    assert got == {"a": "vanbee2002graphs", "c": "vanbee2002flow", "d": "vanbee2002any", "p": "dee1999icis", "r": "dee1999alone"}  # b's only proposal is taken, and the others' names have no such alias
    assert set(pairs(made.aliases, "alias", "canonical")) >= {("vanbee2002graphs", "a"), ("vanbee2002flow", "c"), ("dee1999icis", "p")}
    assert pairs(made.with_preferred_aliases().entries, "entry_key", "field", "value") == pairs(made.entries, "entry_key", "field", "value")


def test_library_commands_use_the_steps(spark):
    rows = [("k1", "entrytype", "misc"), ("k1", "title", "T"), ("k1", "url", "http://dx.doi.org/10.1/x"), ("k1", "author", "A, B"), ("k2", "entrytype", "article"), ("k2", "isbn", "12"), ("k3", "entrytype", "inbook"), ("k3", "crossref", "none"), ("k3", "title", "U")]
    library = Library.of(table(spark, rows, "entry_key string, field string, value string"))
    assert set(pairs(library.check(), "entry_key", "check")) == {("k2", "title"), ("k2", "isbn"), ("k3", "crossref")}
    assert ("k1", "key") in pairs(library.check(entry_checks.Settings(key_prefix="EP")), "entry_key", "check")
    fixed = library.fix()
    assert ("k1", "10.1/x") in pairs(fixed.entries.filter("field = 'doi'"), "entry_key", "value") and not pairs(fixed.entries.filter("field = 'url'"), "value")
    stats = dict(pairs(library.statistics(), "metric", "value"))
    assert len(stats) == 21 and stats["entries"] == "3" and stats["name spellings"] == "1"
    assert dict(pairs(library.statistics(flags=table(spark, [("k1",)], "key string")), "metric", "value"))["entry flags"] == "1"
    assert Library.of(library.entries.limit(0)).check().count() == 0


def test_repeated_and_empty_keys_of_the_check(spark):
    a = ("a", "misc", "T")
    rows = table(spark, [a, a, a, ("a", "misc", "S"), ("c", "inproceedings", "U"), (None, "misc", "V"), ("", "misc", "W")], "entry_key string, entrytype string, title string").withColumn("crossref", F.when(F.col("entry_key") == "c", "a").otherwise(""))
    after, found = entry_checks.check_entries(rows)
    assert pairs(after, "entry_key", "title") == [("", "V"), ("a", "S"), ("c", "U")]
    assert ("a", "key", "the key has several records: 4") in pairs(found, "entry_key", "check", "message")
    assert entry_checks.check_entries(rows.limit(0))[0].count() == 0


def test_empty_keys_are_spread(spark):
    """With nine in ten crossrefs and URLs empty, no task of the joins gets most rows."""
    n = 4000
    rows = spark.range(n).select(F.col("id").cast("string").alias("entry_key"), F.lit("inproceedings").alias("entrytype"), F.lit("T").alias("title"), F.when(F.col("id") % 10 == 0, (F.col("id") + 1).cast("string")).otherwise("").alias("crossref"), F.lit("").alias("url"))
    for key in ("crossref", "url"):
        parts = rows.withColumn("_key", spread(key, "entry_key")).repartition(8, "_key").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < n / 4
    other = table(spark, [("", "bad"), ("11", "good")], "url string, status string")
    told = entry_checks._told(rows.withColumn("url", F.col("crossref")), other, "url")
    assert pairs(told.filter("status IS NOT NULL"), "entry_key", "status") == [("10", "good")]


def test_broken_entries_are_not_read_again(spark):
    text = "@misc{a, note = {see @book{q, title = {Q}} here} and, x = }\n@misc{b, title = {B}}\n@misc{c, author {a@b.org}, year = {1}}\n@misc{d, title = {D}}\n@misc{e, title = {never closed @misc{f, title = {F}}\n"
    rows = bib.parse(table(spark, [("f", text)], "path string, text string"))
    assert pairs(rows.filter("field = 'entrytype'"), "entry_key") == [("b",), ("d",)]
    assert rows.filter("field = '_error'").count() == 3  # a, c and e: the address isn't the start of an entry


@pytest.mark.parametrize("n", [70, 3000])
def test_long_cycles(spark, n):
    ring = [(i, (i + 1) % n) for i in range(n)]
    rest = [(10_000, 10_001), (10_001, 10_000), (10_002, 10_000), (20_000, 20_000), (30_000, 30_001)]
    got = dict(pairs(upkeep.cycle_paths(table(spark, ring + rest, "a long, b long"), "a", "b"), "node", "path"))
    assert got == {0: " ".join(map(str, range(n))), 10_000: "10000 10001", 20_000: "20000"}


# --- maps


def test_character_maps(spark, tmp_path):
    made = maps.Maps()
    spot = {"é": "{\\'e}", "Å": "{\\AA}", "č": "{\\v{c}}", "ğ": "{\\u{g}}", "ő": "{\\H{o}}", "ĝ": "{\\^g}", "ż": "{\\.z}", "ą": "{\\k{a}}", "ů": "{\\r{u}}", "ā": "{\\={a}}", "ş": "{\\c{s}}", "ß": "{\\ss}", "đ": "{\\dh}", "ı": "{\\i}", "İ": "{\\.I}", "ÿ": '{\\"y}', "Ÿ": '{\\"Y}',
            "λ": "\\(\\lambda\\)", "Ω": "\\(\\Omega\\)", "ε": "\\(\\varepsilon\\)", "μ": "\\(\\mu\\)", "\xa0": " ", "\xad": "", "–": "--", "“": "``", "？": "? ", "С": "{\\cyrchar\\CYRS}", "€": "{\\euro}", "×": "\\(\\times\\)"}
    assert {k: made.characters[k] for k in spot} == spot and "ħ" not in made.characters
    spot = {"igrave": "{\\`\\i}", "iacute": "{\\'\\i}", "Igrave": "{\\`I}", "eacute": "{\\'e}", "szlig": "{\\ss}", "Alpha": "\\(A\\)", "Gamma": "\\(\\Gamma\\)", "epsilon": "\\(\\varepsilon\\)", "omicron": "\\(o\\)", "nbsp": " ", "Scaron": "{\\v{S}}", "THORN": "{\\TH}"}
    assert {k: made.entities[k] for k in spot} == spot and "sigmaf" not in made.entities
    # files in place of what's built in; what is written is read back
    made.save(str(tmp_path))
    assert maps.Maps.load(spark, str(tmp_path)) == made
    (tmp_path / "unicode_map.csv").write_text('# mine\n#\n\n233,"a ""q"", b"\n160," "\nx,y\n-1,z\n8364\n', encoding="utf-8")
    (tmp_path / "latex_indexer.csv").unlink()
    other = maps.Maps.load(spark, str(tmp_path))
    assert other.characters == {"é": 'a "q", b', "\xa0": " "} and other.macros == maps.MACROS and other.tags == maps.TAGS


def test_transducer(spark):
    made = maps.Transducer({"a": "1", "ab": "2", "abc": "3", "1": "x", "": "no"})
    assert made("abcab aa1b") == "32 11xb"  # longest first, and what was written isn't read again
    texts = ["<i>K&uuml;hn</i> & S&oslash;n &amp; <b>x</b>", "x<sup>2</sup>, &iacute;&unknown; é–中", "plain", "", None]
    want = ["{\\emph{K{\\\"u}hn}} \\& S{\\o}n \\&amp; <b>x</b>", "x\\({}^{\\mbox{2}}\\), {\\'\\i}\\&unknown; {\\'e}--\\unicode{20013}", "plain", "", ""]
    df = spark.createDataFrame([*enumerate(texts)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(maps.dblp_to_latex(F.col("x"))).collect()] == want
    assert [r[0] for r in df.orderBy("i").select(maps.unicode_to_tex(F.col("x"))).collect()][1:2] == ["x<sup>2</sup>, &iacute;&unknown; {\\'e}--\\unicode{20013}"]


def test_title_index_to_the_end(spark):
    """Wrappers that come about when others go are found however deep, and texts without commands give the same words."""
    texts = {"\\em\\em\\em\\emphphphphWord": "word", "\\backslashbackslashbackslashemph x": "x", "\\textbf{A} \\mathcal{B}": "ab", "Plain, Text: (İ)": "plaintexti̇"}
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", fn.title_index(F.col("x")).alias("y")).collect()} == texts
    titles = ["The Graphs of Flow, 3D and {Data}-Bases", "K~ueche ./(x) Ünï İx 7up", "", None, "a\\emph{b} c", "- , -"]
    df = spark.createDataFrame([*enumerate(titles)], "i int, x string")
    words = F.filter(F.split(F.coalesce("x", F.lit("")), "[ :,./~(]+"), lambda y: ~F.contains(y, F.lit("\\unicode{")))
    words = F.transform(words, lambda y: F.regexp_replace(fn.title_index(y), r"[^a-z0-9]", ""))
    plain = F.array_distinct(F.filter(words, lambda y: (y != "") & ~y.isin(fn.STOP_WORDS) & ~y.rlike(r"\A[0-9]")))
    assert all(r[0] == r[1] for r in df.select(fn.keywords(F.col("x")), plain).collect())


def test_compare_forms(spark):
    cases = {"{\\'{e}} {\\emph{W}} {\\emph{WW}} {-} {\\c x} a & b \\& _x _{y} \\_ # \\# % \\%": "{\\'e} \\emph{W} {\\emph{WW}} - {\\c{x}} a \\& b \\& {\\_}x _{y} {\\_} {\\#} {\\#} {\\%} {\\%}"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", enrich.compare_encoding(F.col("x")).alias("y")).collect()} == cases
    titles = {"a~b\\,c \\textcopyright \\not= \\^{} \\^ \\varepsilon": "a bc \\copyright \\neq ^ ^ \\epsilon", "\\textless\\textgreater\\textquestiondown": "<>?"}
    df = spark.createDataFrame([(k,) for k in titles], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", enrich.compare_title(F.col("x")).alias("y")).collect()} == titles
    assert spark.range(1).select(enrich.compare_fallback(F.lit("({X}): of I and A}.{B"))).first()[0] == "{(X):} of {I} and A.B"


# --- synchronisation

LIBRARY = [("a", "title", "A"), ("b", "title", "B2"), ("c", "title", "C"), ("d", "title", "D"), ("g", "title", "G2"), ("h", "title", "H")]
SOURCE = [("a", "title", "A"), ("b", "title", "B"), ("c", "title", "C2"), ("e", "title", "E"), ("g", "title", "G1"), ("x", "title", "X")]
BEFORE = [("a", "title", "A"), ("b", "title", "B"), ("c", "title", "C"), ("d", "title", "D"), ("g", "title", "G"), ("x", "title", "X")]


def sides(spark):
    frame = lambda rows: table(spark, rows, "entry_key string, field string, value string")
    snapshot = fn.fingerprint(frame(BEFORE)).select("entry_key", "fingerprint")
    return frame(SOURCE), frame(LIBRARY), snapshot, table(spark, [(k,) for k in "abcdegh"], "entry_key string")


def test_subset_is_resumed(spark):
    source, library, snapshot, scope = sides(spark)
    folder = fresh_dir(spark, "sync")
    made = {}

    class Killed(Exception):
        pass

    class Run(sync.Run):
        def step(self, name, make):
            if name == made.get("stop"):
                raise Killed
            return super().step(name, lambda: made.setdefault(name, 0) or made.update({name: made[name] + 1}) or make())

    answers = table(spark, [("g", "take"), ("a", "remove")], "entry_key string, action string")
    for made["stop"] in ("decided", "file"):
        with pytest.raises(Killed):
            Run(spark, folder).go("subset", source, library, snapshot, scope, answers=answers)
        library = library.limit(0)  # what changes after the plan was made isn't looked at again
    made["stop"] = None
    rows, ours, file, after = Run(spark, folder).go("subset", source, sides(spark)[1], snapshot, scope, answers=answers)
    assert {k: v for k, v in made.items() if k != "stop"} == {"plan": 1, "decided": 1, "library": 1, "file": 1, "snapshot": 1}
    assert {r["entry_key"]: (r["status"], r["action"], r["state"]) for r in rows.collect()} == {
        "a": ("unchanged", "keep", "ready"), "b": ("library-changed", "write", "ready"), "c": ("source-changed", "take", "ready"), "d": ("deleted-in-source", "write", "needs-review"), "e": ("new-in-source", "take", "ready"),
        "g": ("both-changed", "take", "ready"), "h": ("new-in-library", "write", "ready"), "x": ("deleted-in-library", "drop", "ready"),
    }


def test_modes(spark):
    source, library, snapshot, scope = sides(spark)
    run = lambda mode, **more: sync.Run(spark, fresh_dir(spark, "sync")).go(mode, source, library, snapshot, scope, **more)
    rows, ours, file, after = run("subset", trusted=True)
    assert dict(pairs(ours, "entry_key", "value")) == {"a": "A", "b": "B2", "c": "C2", "e": "E", "g": "G1", "h": "H"}
    assert pairs(file, "entry_key", "value") == pairs(ours, "entry_key", "value")
    assert pairs(after, "entry_key", "fingerprint") == pairs(fn.fingerprint(file), "entry_key", "fingerprint")
    rows, ours, file, after = run("subset")
    assert dict(pairs(ours, "entry_key", "value")) == {"a": "A", "b": "B2", "c": "C2", "d": "D", "e": "E", "g": "G2", "h": "H"}
    assert dict(pairs(file, "entry_key", "value")) == {"a": "A", "b": "B2", "c": "C2", "e": "E", "g": "G1", "h": "H"}  # what waits stays as the file has it
    assert dict(pairs(after, "entry_key", "fingerprint"))["g"] == dict(pairs(snapshot, "entry_key", "fingerprint"))["g"]
    # the next run asks the same again, and nothing else
    again = sync.plan("subset", fn.fingerprint(file), fn.fingerprint(ours), after, scope)
    assert pairs(again.filter("action <> 'keep'"), "entry_key", "status") == [("d", "deleted-in-source"), ("g", "both-changed")]
    rows, ours, file, after = run("pull")
    assert pairs(ours, "entry_key", "value") == sorted((k, v) for k, _, v in LIBRARY) == pairs(file, "entry_key", "value")
    rows, ours, file, after = run("follow")
    assert dict(pairs(file, "entry_key", "value")) == {"a": "A", "b": "B2", "c": "C", "e": "E", "g": "G2"}
    rows, ours, file, after = run("harvest")
    assert dict(pairs(ours, "entry_key", "value")) == {k: v for k, _, v in LIBRARY} | {"e": "E"}
    with pytest.raises(ValueError, match="none of"):
        sync.plan("other", source, library, snapshot, scope)


def test_matched_and_statuses(spark):
    source = table(spark, [("out1",), ("old",), ("new",)], "entry_key string")
    snapshot = table(spark, [("k1", "out1"), ("k2", "zz")], "entry_key string, output_key string")
    aliases = table(spark, [("k1", "k9"), ("old", "k3")], "alias string, canonical string")
    assert pairs(sync.matched(source, snapshot, aliases), "output_key", "entry_key") == [("new", "new"), ("old", "k3"), ("out1", "k9")]
    buried = table(spark, [("e",)], "entry_key string")
    s, y, b, scope = sides(spark)
    got = sync.statuses(fn.fingerprint(s), fn.fingerprint(y), b, scope, deleted=buried)
    assert dict(pairs(got, "entry_key", "status"))["e"] == "deleted-in-library"


# --- the log


def test_two_writers(spark):
    first = table(spark, [(i, f"v{i}", 0) for i in range(10)], "k long, v string, n int")
    log = TableLog(spark, fresh_dir(spark, "log"), ["k"])
    with pytest.raises(ValueError, match="no version"):
        log.read()
    assert log.head() == -1 and log.start(first) == 0
    with pytest.raises(ValueError, match="has versions"):
        TableLog(spark, log.folder, ["k"]).start(first)
    one, two = TableLog(spark, log.folder, ["k"]), TableLog(spark, log.folder, ["k"])
    rows = lambda *x: table(spark, list(x), "k long, v string, n int")
    gone = lambda *x: table(spark, [(i,) for i in x], "k long")
    assert one.commit(0, rows((1, "one", 1), (50, "new", 1)), gone(2, 3)).version == 1
    lost = two.commit(0, rows((1, "two", 2), (4, "two", 2)), gone(3))
    assert lost.version is None and [(r["k"], r["theirs"]["v"], r["mine"]["v"]) for r in lost.conflicts.collect()] == [(1, "one", "two")]
    assert two.commit(0, rows((4, "two", 2)), gone(3)).version == 2  # the same deletion is no conflict
    assert two.commit(1, rows((2, "back", 2))).version == 3
    lost = one.commit(0, rows((2, "x", 1)))
    assert [(r["theirs"]["v"]) for r in lost.conflicts.collect()] == ["back"]
    assert [r["mine"] for r in one.commit(1, None, gone(2)).conflicts.collect()] == [None]
    want = {(i, f"v{i}") for i in range(10)} - {(1, "v1"), (2, "v2"), (3, "v3"), (4, "v4")} | {(1, "one"), (50, "new"), (4, "two"), (2, "back")}
    assert set(pairs(one.read(), "k", "v")) == want and set(pairs(one.read(0), "k", "v")) == {(i, f"v{i}") for i in range(10)}
    with pytest.raises(ValueError, match="twice"):
        one.commit(3, rows((7, "a", 1), (7, "b", 1)))
    with pytest.raises(ValueError, match="nothing"):
        one.commit(3)


def test_only_one_makes_a_version(spark, monkeypatch):
    """A writer that finds the next version taken between its look and its claim looks again."""
    log = TableLog(spark, fresh_dir(spark, "log"), ["k"])
    log.start(table(spark, [(1, "a")], "k long, v string"))
    other, real, raced = TableLog(spark, log.folder, ["k"]), TableLog._claim, []

    def claim(self, version, label):
        if self is log and not raced:
            raced.append(other.commit(0, table(spark, [(2, "other")], "k long, v string")).version)
        return real(self, version, label)

    monkeypatch.setattr(TableLog, "_claim", claim)
    assert log.commit(0, table(spark, [(3, "mine")], "k long, v string")).version == 2 and raced == [1]
    assert pairs(log.read(), "k", "v") == [(1, "a"), (2, "other"), (3, "mine")]
    for i in range(3, 18):  # past a version that holds the whole table
        assert log.commit(i - 1, table(spark, [(i % 4, f"v{i}")], "k long, v string")).version == i
    assert pairs(log.read(), "k", "v") == [(0, "v16"), (1, "v17"), (2, "v14"), (3, "v15")] and pairs(log.read(15), "k", "v")[0] == (0, "v12")
