"""Groups under constraints: links bring nodes together, unless nodes known to be different would meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import contracted, flatten
from quire.operators.store import cut

#: Levels are strengths of evidence, which are taken one after another.
LEVELS = 20


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def constrained_components(links: DataFrame, labels: DataFrame | None = None, different: DataFrame | None = None) -> DataFrame:
    """node, root (the group's smallest node) of every node that a link names.

    links: a, b, level.  labels: node, kind, value: nodes of one group have at most one value of
    a kind, but for a node that has several itself, of which the smallest counts.  different:
    a, b: pairs that must not be in one group.  Levels are taken in ascending order; when one is
    done, every one of its links that's still between two groups would join different
    nodes.  Which of several such results is returned depends on the links and hashes of the nodes alone, so
    runs agree.  Links of a node with itself and with nulls, and repeated rows, say nothing.

    1. Components of all links: those in which nothing is different are groups.
    2. The others are contracted in rounds, each level by itself.  A round makes hubs and leaves, and a leaf
       picks a hub that it's linked to.  A leaf joins unless its labels
       differ from those that the hub, or else the hub's first leaf, brings, or it
       must not meet an earlier leaf of the hub.  The first leaf of a hub always joins, and links between
       groups that have become different go.
    3. A level's first hubs are the nodes with more links than all that they're linked to, so
       stars of whatever size take one round.  Then components of what is left of the level, in which
       nothing is different, are joined as they are.  After that coins, which are hashes of group and round,
       make the hubs in every other round, so rounds are about the logarithm of a torn group's
       size, of whatever form its links are.

    All joins are by merging: each table here grows with the input, and none goes to the driver.
    """
    links = cut(links.filter("a <> b").select(*_pair("a", "b"), F.col("level").cast("int")).groupBy("a", "b").agg(F.min("level").alias("level")))
    kind = links.schema["a"].dataType
    whole = contracted(links)
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.lit("").alias("kind"), F.lit("").alias("value")).limit(0)
    if different is None:
        different = links.select("a", "b").limit(0)
    labels = cut(labels.filter("value IS NOT NULL").select(F.col("node").cast(kind), F.col("kind").cast("string"), F.col("value").cast("string")).hint("merge").join(whole, "node").groupBy("root", "node", "kind").agg(F.min("value").alias("value")))
    at = lambda x: whole.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    pairs = different.filter("a <> b").select(F.col("a").cast(kind), F.col("b").cast(kind)).select(*_pair("a", "b")).distinct()
    pairs = cut(pairs.hint("merge").join(at("a"), "a").hint("merge").join(at("b"), "b").filter("root_a = root_b").select("a", "b", F.col("root_a").alias("root")))
    torn = labels.groupBy("root", "kind").agg(F.min("value").alias("x"), F.max("value").alias("y")).filter("x <> y").select("root")
    torn = cut(torn.unionByName(pairs.select("root")).distinct())
    if torn.isEmpty():
        return whole
    held = cut(whole.hint("merge").join(torn, "root", "left_semi").select("node"))
    # links, labels and pairs of what is left in one table, so that a round writes one
    none = F.lit(None).cast(kind)
    rows = lambda df, what, a, b, label, value, level: df.select(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), label.alias("kind"), value.alias("value"), level.alias("level"))
    no, zero = F.lit(None).cast("string"), F.lit(0)
    state = rows(links.hint("merge").join(held.withColumnRenamed("node", "a"), "a", "left_semi"), "link", F.col("a"), F.col("b"), no, no, F.col("level"))
    state = state.unionByName(rows(labels.hint("merge").join(torn, "root", "left_semi"), "label", F.col("node"), none, F.col("kind"), F.col("value"), zero))
    state = state.unionByName(rows(pairs, "pair", F.col("a"), F.col("b"), no, no, zero))
    state, moves = _allowed(cut(state)), None  # without repeated rows, as its parts are
    levels = [r[0] for r in links.select("level").distinct().limit(LEVELS + 1).collect()]
    if len(levels) > LEVELS:
        raise ValueError(f"more than {LEVELS} levels")
    turn = 0
    for level in sorted(levels):
        first = turn + 1
        while not (now := state.filter((F.col("what") == "link") & (F.col("level") == level))).isEmpty():
            turn += 1
            joined = cut(_whole(state, now) if turn == first + 1 else _joined(state, _stars(now, turn) if (turn - first) % 2 == 0 else _coins(now, turn), turn))
            moves = joined if moves is None else moves.unionByName(joined)
            to = lambda x: joined.select(F.col("leaf").alias(x), F.col("hub").alias(f"_{x}"))  # noqa: B023, E731
            moved = state.hint("merge").join(to("a"), "a", "left").hint("merge").join(to("b"), "b", "left").select("what", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "kind", "value", "level")
            state = _allowed(_once(moved))
    if moves is None:
        ends = held.select("node", F.col("node").alias("group"))
    else:
        ends = held.hint("merge").join(flatten(cut(moves), "leaf", "hub").withColumnRenamed("leaf", "node"), "node", "left").select("node", F.coalesce("hub", "node").alias("group"))
    least = ends.groupBy("group").agg(F.min("node").alias("root"))
    return whole.hint("merge").join(torn, "root", "left_anti").select("node", "root").unionByName(ends.hint("merge").join(least, "group").select("node", "root"))


def _once(state: DataFrame) -> DataFrame:
    """The state without links within a group and repeated rows, links and pairs from the smaller group to the larger."""
    ordered = F.when(F.col("what") == "label", F.struct("a", "b")).otherwise(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rows = state.withColumn("p", ordered).select("what", "p.a", "p.b", "kind", "value", "level")
    links = rows.filter("what = 'link' AND a <> b").groupBy("what", "a", "b", "kind", "value").agg(F.min("level").alias("level"))
    return cut(links.unionByName(rows.filter("what <> 'link'").distinct()))


def _allowed(state: DataFrame) -> DataFrame:
    """The state, as _once() leaves it, without links between groups that are different."""
    links, labels = state.filter("what = 'link'"), state.filter("what = 'label'").select("a", "kind", "value")
    mine, theirs = labels.toDF("a", "k", "x"), labels.toDF("b", "k", "y")
    apart = links.select("a", "b").hint("merge").join(mine, "a").hint("merge").join(theirs, ["b", "k"]).filter("x <> y").select("a", "b")
    apart = apart.unionByName(state.filter("what = 'pair'").select("a", "b")).distinct()
    return cut(links.hint("merge").join(apart, ["a", "b"], "left_anti").select(*state.columns).unionByName(state.filter("what <> 'link'")))


def _both(links: DataFrame) -> DataFrame:
    """leaf, hub: links in both directions."""
    return links.select(F.col("a").alias("leaf"), F.col("b").alias("hub")).unionByName(links.select(F.col("b").alias("leaf"), F.col("a").alias("hub")))


def _coins(links: DataFrame, turn: int) -> DataFrame:
    """leaf, hub: a coin says who is a hub; of its hubs a leaf picks one."""
    heads = lambda x: F.pmod(F.xxhash64(x, F.lit(turn)), F.lit(2)) == 0
    return _both(links).filter(~heads("leaf") & heads("hub")).groupBy("leaf").agg(F.min_by("hub", F.struct(F.xxhash64("hub", F.lit(turn)), F.col("hub"))).alias("hub"))


def _stars(links: DataFrame, turn: int) -> DataFrame:
    """leaf, hub: a hub has more links than every node that it's linked to (of equally many, a hash decides); a leaf picks the neighbour that has most, if that is a hub."""
    both = _both(links)
    rank = cut(both.groupBy(F.col("leaf").alias("hub")).agg(F.count("*").alias("n")).select("hub", F.struct("n", F.xxhash64("hub", F.lit(turn)).alias("h"), "hub").alias("rank")))
    most = both.hint("merge").join(rank, "hub").groupBy("leaf").agg(F.max("rank").alias("most"))
    seen = cut(most.hint("merge").join(rank.select(F.col("hub").alias("leaf"), F.col("rank").alias("own")), "leaf"))
    hubs = seen.filter("own > most").select(F.col("leaf").alias("hub"))
    return seen.filter("own < most").select("leaf", F.col("most.hub").alias("hub")).hint("merge").join(hubs, "hub", "left_semi").select("leaf", "hub")


def _whole(state: DataFrame, links: DataFrame) -> DataFrame:
    """leaf, hub of the components of links in which nothing is different."""
    parts = contracted(links)
    labels = state.filter("what = 'label'").select(F.col("a").alias("node"), "kind", "value").hint("merge").join(parts, "node")
    torn = labels.groupBy("root", "kind").agg(F.min("value").alias("x"), F.max("value").alias("y")).filter("x <> y").select("root")
    at = lambda x: parts.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    pairs = state.filter("what = 'pair'").select("a", "b").hint("merge").join(at("a"), "a").hint("merge").join(at("b"), "b").filter("root_a = root_b").select(F.col("root_a").alias("root"))
    return parts.filter("node <> root").hint("merge").join(torn.unionByName(pairs).distinct(), "root", "left_anti").select(F.col("node").alias("leaf"), F.col("root").alias("hub"))


def _joined(state: DataFrame, picked: DataFrame, turn: int) -> DataFrame:
    """leaf, hub of the leaves that join the hub that they picked in this round."""
    order = F.struct(F.xxhash64("leaf", F.lit(turn), F.lit(1)).alias("h"), F.col("leaf"))
    picked = cut(picked.withColumn("order", order))
    # what the first leaf that has a kind of label brings; a hub's own labels don't differ from those of what it's linked to
    labels = picked.hint("merge").join(state.filter("what = 'label'").select(F.col("a").alias("leaf"), "kind", "value"), "leaf")
    first = labels.groupBy("hub", "kind").agg(F.min_by("value", "order").alias("first"))
    differs = labels.hint("merge").join(first, ["hub", "kind"]).filter("value <> first").select("leaf")
    pairs = state.filter("what = 'pair'").select("a", "b")
    one = lambda x: picked.select(F.col("leaf").alias(x), F.col("hub").alias(f"hub_{x}"), F.col("order").alias(f"order_{x}"))
    meet = pairs.hint("merge").join(one("a"), "a").hint("merge").join(one("b"), "b").filter("hub_a = hub_b").select(F.when(F.col("order_a") < F.col("order_b"), F.col("b")).otherwise(F.col("a")).alias("leaf"))
    return picked.hint("merge").join(differs.unionByName(meet).distinct(), "leaf", "left_anti").select("leaf", "hub")
