"""Steps whose work must not grow faster than their input or their result, on inputs whose groups are large."""

import itertools

import pytest
from pyspark.sql import functions as F

from quire.operators import absorb, curation, enrich, graph, grouping
from quire.operators import relational as rel
from quire.sources import dblp


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(rel, "BLOCK", 4)


def test_pairs_of_a_large_group(spark, small_blocks):
    """Each pair once, also of keys that occur twice, without nulls, and no cell has a large group."""
    rows = [(f"k{i}", "x") for i in range(30)] + [("k3", "x"), (None, "x"), ("z", None), ("z", "y"), ("a", "y")]
    found = rel.pairs(spark.createDataFrame(rows, "key string, value string"), "value", "key")
    got = sorted(tuple(sorted((r["a_key"], r["b_key"]))) for r in found.collect())
    keys = [k for k, v in rows if v == "x" and k is not None]
    want = sorted([tuple(sorted(p)) for p in itertools.combinations(keys, 2) if p[0] != p[1]] + [("a", "z")])
    assert got == want
    assert {r["_blocks"] for r in rel._dealt(spark.createDataFrame(rows, "key string, value string"), "value", "key").filter("value = 'x'").collect()} == {8}


def test_duplicate_pairs_in_blocks(spark, small_blocks):
    rows = [(f"k{i}", f, v) for i in range(20) for f, v in (("dblp", "d"), ("entrytype", "book"))] + [("k99", "dblp", "d")]
    found = rel.duplicate_pairs(spark.createDataFrame(rows, "entry_key string, field string, value string"), "dblp")
    keys = sorted(f"k{i}" for i in range(20))
    assert sorted((r["key_a"], r["key_b"], r["value"]) for r in found.collect()) == sorted((a, b, "d") for a, b in itertools.combinations(keys, 2))


def test_duplicate_pairs_are_not_compared_again(spark):
    """Blocks are ranges, so pairs come with the smaller key first and no row is compared for that; a block's keys come as one array."""
    rows = [(f"k{i}", f, v) for i in range(20) for f, v in (("dblp", "d"), ("entrytype", "book"))]
    plan = rel.duplicate_pairs(spark.createDataFrame(rows, "entry_key string, field string, value string"), "dblp")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_keys" in plan
    made = plan[: plan.index("Generate explode(_keys")]
    assert "least(" not in made and "greatest(" not in made


def test_same_names_in_blocks(spark, small_blocks):
    """Pairs known to be different are left out in either order, whatever blocks they're in, and no pair is shuffled for that."""
    people = spark.createDataFrame([(i, "x") for i in range(24)] + [(50, "y")], "id long, name string")
    known = [(i, i + 7) for i in range(0, 10, 2)] + [(i + 5, i) for i in range(9)] + [(3, 3), (1, 50), (5, 0)]
    found = rel.same_names(people, spark.createDataFrame(known, "id_a long, id_b long"))
    apart = {tuple(sorted(k)) for k in known}
    assert sorted((r["id_a"], r["id_b"]) for r in found.collect()) == [p for p in itertools.combinations(range(24), 2) if p not in apart]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_blocks_are_ranges_of_keys(spark, small_blocks):
    """So that only keys of one block have to be compared: all of a block's come before those of the next, and a is the smaller of each pair."""
    rows = spark.createDataFrame([(f"k{i * 37 % 101}", "x") for i in range(101)] + [("k5", "y")], "key string, value string")
    dealt = rel._dealt(rows, "value", "key").filter("value = 'x'").groupBy("_own").agg(F.min("key").alias("least"), F.max("key").alias("most")).orderBy("_own").collect()
    assert len(dealt) > 4
    assert all(a["most"] < b["least"] for a, b in zip(dealt, dealt[1:]))
    found = rel.pairs(rows, "value", "key").collect()
    assert len(found) == len({(r["a_key"], r["b_key"]) for r in found}) == 101 * 50
    assert all(r["a_key"] < r["b_key"] for r in found)


def test_copies_of_a_row_do_not_grow_with_its_group(spark, small_blocks):
    rows = spark.range(400).select(F.col("id").alias("key"), F.lit("x").alias("value"))
    assert {r["_blocks"] for r in rel._dealt(rows, "value", "key").collect()} == {16}
    assert rel.pairs(rows, "value", "key").count() == 400 * 399 // 2


def test_a_row_finds_known_pairs_before_it_is_copied(spark, small_blocks, monkeypatch):
    """Also a contributor who is known to be different from most of the name, over several lists; copies for blocks aren't shuffled for that."""
    monkeypatch.setattr(rel, "SPAN", 2)
    people = spark.createDataFrame([(i, "x") for i in range(50)] + [(7, "x"), (60, "y")], "id long, name string")
    known = [(3, i) for i in range(50) if i % 9] + [(49, 0), (20, 21), (2, 60)]
    found = rel.same_names(people, spark.createDataFrame(known, "id_a long, id_b long"))
    apart = {tuple(sorted(k)) for k in known}
    ids = sorted([*range(50), 7])
    assert sorted((r["id_a"], r["id_b"]) for r in found.collect()) == sorted(p for p in itertools.combinations(ids, 2) if p[0] != p[1] and p not in apart)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lists = plan.index("Join LeftOuter", plan.index("RepartitionByExpression"))
    assert plan.index("AS _j") < lists or plan.index("[_j") < lists


def test_different_publications_come_from_cells(spark):
    """The pairs of flt18 are dealt over cells: its join has them among its keys."""
    import __spark_entry__

    plan = __spark_entry__.queries()["flt18_different_publications"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and "_j" in plan


def test_parents_are_summed_up_before_they_meet_children(spark):
    """As many rows reach the children's join as there are venues and years; a child that occurs under two venues has the candidates of both."""
    parents = spark.createDataFrame([(f"p{i}", "v", "1", str(90 - i), "") for i in range(40)] + [("q", "w", "1", "7", ""), ("r", "u", "1", "", "")], "parent string, venue string, year string, volume string, title string")
    children = spark.createDataFrame([(i, "", "v", "1") for i in range(9)] + [(20, "", "v", "1"), (20, "", "w", "1"), (30, "", "v", "1"), (30, "", "u", "1"), (40, "p5", "v", "1")], "entry_key long, crossref string, venue string, year string")
    found = curation.parent_candidates(children, parents)
    want = {(i, "volume", "p39") for i in range(9)} | {(20, "volume", "q"), (30, "ask", ""), (40, "claim", "p5")}
    assert {tuple(r) for r in found.collect()} == want
    text = found._jdf.queryExecution().optimizedPlan().toString()
    join = text.index("Join Inner, ((venue")
    assert "Aggregate [venue" in text[join:]


def test_candidate_count_makes_no_pairs(spark):
    """Equal to counting the pairs of candidates(), without a join of titles and records."""
    titles = [(f"e{i}", "title", "Some title" if i < 12 else "Another") for i in range(14)] + [("e0", "dblp", "x"), ("e20", "title", "Alone"), ("e21", "title", "")]
    entries = spark.createDataFrame(titles, "entry_key string, field string, value string")
    links = spark.createDataFrame([("Some title", "DBLP:r1"), ("Some title", "r1"), ("Some title", "r2"), ("Another", "r3"), ("Another", None)], "title string, record_key string").select(enrich.title_hash(F.col("title")).alias("hash"), "record_key")
    known = [("e1", "DBLP:r1"), ("e2", "DBLP:r1"), ("e2", "DBLP:r2"), ("e2", "DBLP:r2"), ("e12", "DBLP:r3"), ("e3", "DBLP:r9")]
    different = spark.createDataFrame(known, "entry_key string, record string")
    want = enrich.candidates(entries, links, different).agg(F.count_distinct("entry_key")).first()[0]
    found = enrich.candidate_count(entries, links, different)
    assert found.first()["n"] == want == 12
    assert "record_key" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]


def test_halves_are_rounded_to_even(spark, tmp_path):
    """As the SQL's cast of a double does."""
    import __spark_entry__

    spark.createDataFrame([(1, 2.5), (1, 3.5), (3, 0.5), (3, 0.25), (2, 1.5)], "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = __spark_entry__.queries()["res2_resolver"](spark, str(tmp_path)).collect()
    assert sorted((r["user_id"], r["rule"], r["value"]) for r in rows) == [(1, "auto-accept", "4"), (2, "equal", "2"), (3, "equal", "0")]


@pytest.mark.parametrize("packed", [False, True])
def test_a_dump_has_a_bounded_number_of_ranges(spark, tmp_path, monkeypatch, packed):
    """Ranges don't grow with the dump, and all records are read."""
    monkeypatch.setattr(dblp, "MOST", 4)
    names = spark.range(20000).select(F.concat(F.lit('<article key="a/'), F.col("id"), F.lit('"><title>'), F.md5(F.col("id").cast("string")), F.lit("</title></article>")).alias("value"))
    names.coalesce(1).write.option("compression", "gzip" if packed else "none").text(f"{tmp_path}/dump")
    assert 2 <= dblp.ranges(spark, f"{tmp_path}/dump", every=1000).count() <= 6
    found = dblp.read(spark, f"{tmp_path}/dump", keys_only=True, every=1000)
    assert found.count() == found.select("record_key").distinct().count() == 20000


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    names = spark.range(400).select(F.concat(F.lit("a/"), F.col("id")).alias("record_key"), *[F.lit(x).alias(x) for x in ("entrytype", "mdate", "publtype", "field", "value", "orcid")], F.lit(0).alias("pos"))
    dblp.write_json(names, f"{tmp_path}/json", buckets=2)
    assert dblp.read_json(spark, f"{tmp_path}/json").count() == 400
    assert all(len(list(tmp_path.glob(f"json/bucket={b}/*.json"))) > 1 for b in range(2))
    assert [r["record_key"] for r in dblp.look_up(spark, f"{tmp_path}/json", ["a/7"], buckets=2).collect()] == ["a/7"]


def test_a_frequent_title_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.range(2000).select(F.md5(F.lit("one title")).alias("hash"), F.concat(F.lit("a/"), F.col("id")).alias("record_key"))
        dblp.write_title_links(links, f"{tmp_path}/links")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("links/*/*.txt"))) > 1
    assert dblp.read_title_links(spark, f"{tmp_path}/links").exceptAll(links).isEmpty()
    assert dblp.read_title_links(spark, f"{tmp_path}/links").count() == 2000


def test_rounds_end_with_the_longest_chain(spark, monkeypatch):
    """Cycles don't go on for as many doublings as there are aliases, and what leads to them is dropped; no table is broadcast."""
    made, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(df) or plain(df))
    chain = [(i, i + 1) for i in range(1, 12)] + [(12, 3000), (40, 11)]
    cycles = [(i, i + 1 if i % 2 == 0 else i - 1) for i in range(100, 1100)] + [(50, 100), (51, 50), (60, 60)]
    found = graph.flatten(spark.createDataFrame(chain + cycles, "alias long, canonical long"))
    assert {tuple(r) for r in found.collect()} == {(a, 3000) for a, _ in chain}
    assert len(made) <= 7
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in made)


@pytest.fixture
def made(monkeypatch):
    """Tables that rounds write."""
    found, plain = [], graph.cut
    for module in (graph, grouping, absorb):
        monkeypatch.setattr(module, "cut", lambda df: found.append(df) or plain(df))
    return found


def broadcasts(frames):
    return [df for df in frames if "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()]


def test_a_star_takes_one_round(spark, made):
    """Rounds don't grow with a hub's leaves, nor with what of a level is left whole, and no table is broadcast."""
    star = [(0, i, 1) for i in range(1, 400)] + [(i, i + 1, 2) for i in range(500, 530)] + [(399, 500, 2)]
    labels = [(0, "key", "a"), (399, "key", "b"), (7, "key", "a")]
    links = spark.createDataFrame(star, "a long, b long, level int"), spark.createDataFrame(labels, "node long, kind string, value string")
    found = grouping.constrained_components(*links)
    assert sorted(tuple(r) for r in found.collect()) == [(i, 0) for i in range(399)] + [(i, 399) for i in (399, *range(500, 531))]
    assert len(made) <= 75
    assert not broadcasts([*made, found])


def test_dense_bipartite_groups_take_few_rounds(spark, made):
    """As grf7's: many nodes, each linked to the same few of unlike labels, go to one of these in the first round."""
    links = spark.createDataFrame([(s, -1 - g, 1) for s in range(60) for g in range(6)], "a long, b long, level int")
    labels = spark.createDataFrame([(-1 - g, "parity", str(g % 2)) for g in range(6)], "node long, kind string, value string")
    found = {r["node"]: r["root"] for r in grouping.constrained_components(links, labels).collect()}
    groups = [{n for n, r in found.items() if r == root} for root in set(found.values())]
    assert sorted(map(len, groups)) == [1, 1, 1, 63] and all(len({n % 2 for n in g if n < 0}) == 1 for g in groups)
    assert len(made) <= 40
    assert not broadcasts(made)


def test_components_of_an_ascending_chain(spark, made):
    """Rounds don't grow by one with each node."""
    found = graph.components(spark.range(60).select("id", (F.col("id") + 1).alias("next")), "id", "next")
    assert {r["root"] for r in found.collect()} == {0} and found.count() == 61
    assert len(made) <= 40
    assert not broadcasts(made)


def test_components_join_all_nodes_once(spark, made):
    """Tables that have all nodes are the first round's and the two that end it, however many rounds there are."""
    found = graph.components(spark.range(60).select("id", (F.col("id") + 1).alias("next")), "id", "next")
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(61)}
    assert sum(df.count() == 61 for df in made) <= 3


def test_links_of_a_query_are_read_once(spark, made, monkeypatch):
    """grf7 reads lines for the table of its links, and no round, label or result reads them again; the links of the first state are written twice: as they're put together, and without those between unlike nodes."""
    import __spark_entry__
    from quire.operators import store

    plain = store.cut
    monkeypatch.setattr(store, "cut", lambda df: made.append(df) or plain(df))
    path = "/root/testdata/sf0.001"
    found = __spark_entry__.queries()["grf7_constrained"](spark, path)
    reads = [any("lineitem" in f for f in df.inputFiles()) for df in [*made, found]]
    assert sum(reads) == 1
    want = spark.read.parquet(f"{path}/lineitem.parquet").select("l_suppkey").distinct().count() + 40
    assert [tuple(r) for r in found.collect()] == [(want, 0)]
    n = made[0].count()
    assert sum(df.columns == ["what", "a", "b", "kind", "value", "level"] and df.filter("what = 'link'").count() == n for df in made) <= 2


def test_absorbing_broadcasts_nothing(spark, made):
    known = spark.createDataFrame([("1", "Bee, Ann", "p2", ""), ("2", "Bee, Ann", "", ""), ("3", "X", "", "o1"), ("4", "Y", "", "o1")], "id string, name string, dblp_key string, orcid string")
    people = spark.createDataFrame([("p1", "Bee, Ann"), ("p2", "Cee, Carl")], "person string, name string")
    got = absorb.absorb(known, known.select("id", "name").limit(0), people, spark.createDataFrame([("p1", "o1"), ("p2", "")], "person string, orcid string"))
    assert sorted(map(tuple, got.merges.collect())) == [("3", "2"), ("4", "2")]
    assert [tuple(r) for r in got.splits.collect()] == [("1", "p2", "p1")]
    assert not broadcasts([*made, got.merges, got.keys, got.orcids, got.names, got.splits, got.conflicts])


def test_roles_are_summed_up_in_tasks_of_bounded_lines(spark, monkeypatch):
    """Tasks follow from the number of lines, nothing is summed up before lines are dealt, and entries need no further shuffle of them."""
    import __spark_entry__
    from quire import adapters

    monkeypatch.setattr(adapters, "LINES", 500)
    path = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{path}/lineitem.parquet").count() // 500 + 1
    found = __spark_entry__.queries()["join11_without_dblp"](spark, path).hint("merge")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and f"{n}), REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 2
    lines = plan[plan.index("REPARTITION_BY_NUM") :]
    assert "HashAggregate" not in lines
