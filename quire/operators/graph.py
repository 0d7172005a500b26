"""Alias, mapping and crossref graphs.  All are distributed; rounds grow with the logarithm of a path's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.store import cut


def flatten(edges: DataFrame, alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """alias, canonical: every alias directly to the end of its chain.

    Pointer jumping: each round replaces a target by its target's target, so chains
    of length n take log2(n) rounds.  Aliases on a cycle, or that lead to one, have no end and are dropped: when
    a round brings no alias to its end, none of the rest has one, for of a longer chain that ends
    a part would have been as long as the round reaches.  An alias with several targets keeps the smallest.
    Joins are by merging: tables of aliases grow with the input, and stay off the driver.
    """
    now = cut(edges.filter(F.col(alias) != F.col(canonical)).groupBy(F.col(alias).alias("a")).agg(F.min(canonical).alias("c")))
    known = now.select(F.col("a").alias("c"), F.lit(False).alias("done"))
    step = cut(now.hint("merge").join(known, "c", "left").select("a", "c", F.coalesce("done", F.lit(True)).alias("done")))
    ended, rest = step.filter("done"), step.filter("NOT done")
    while not rest.isEmpty():
        to = ended.unionByName(rest).select(F.col("a").alias("c"), F.col("c").alias("next"), "done")
        step = cut(rest.select("a", "c").hint("merge").join(to, "c").select("a", F.col("next").alias("c"), "done"))
        new, rest = step.filter("done"), step.filter("NOT done")
        if new.isEmpty():
            break
        ended = ended.unionByName(new)
    return ended.select(F.col("a").alias(alias), F.col("c").alias(canonical))


def on_cycles(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes from which a chain of single targets never ends: those on a cycle or leading to one."""
    ended = flatten(edges, source, target).select(source)
    return edges.filter(F.col(source) != F.col(target)).select(source).distinct().hint("merge").join(ended, source, "left_anti").unionByName(edges.filter(F.col(source) == F.col(target)).select(source)).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node of each component.

    By contraction along smallest neighbours, in the order of a hash: chains of ascending nodes
    get shorter by a share in each round, not by one node.  Joins are by merging: nodes grow with
    the input, and stay off the driver.
    """
    rest = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    return contracted(rest)


def contracted(links: DataFrame) -> DataFrame:
    """components() of links a, b that are read from a table, without repeated rows and links of a node with itself."""
    rest, steps = links.select("a", "b"), []
    order = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("n"))
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min(order("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", order("a"))["n"].alias("next")))
        steps.append(step)
        x, y = step.select(F.col("node").alias("a"), F.col("next").alias("x")), step.select(F.col("node").alias("b"), F.col("next").alias("y"))
        rest = cut(rest.hint("merge").join(x, "a").hint("merge").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    # from the last step, which is the smallest, back to the first, so that all nodes are joined once
    every = steps.pop().withColumnRenamed("next", "root")
    while steps:
        step = steps.pop().withColumnRenamed("next", "via")
        every = cut(step.hint("merge").join(every.withColumnRenamed("node", "via"), "via", "left").select("node", F.coalesce("root", "via").alias("root")))
    least = every.groupBy("root").agg(F.min("node").alias("least"))
    return cut(every.hint("merge").join(least, "root").select("node", F.col("least").alias("root")))


def reachable(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """node: everything that start (node) leads to, itself included; breadth first, each node once."""
    seen = cut(start.select("node").distinct())
    front = seen
    while not front.isEmpty():
        new = edges.join(front.withColumnRenamed("node", source), source).select(F.col(target).alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def saturate(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Applies (source_field, source_value) -> (target_field, target_value) until nothing is new; the first value of a field stays.

    facts: entry_key, field, value.  Of several new values of one field the smallest is taken.
    """
    rules = rules.select(F.col("source_field").alias("field"), F.col("source_value").alias("value"), "target_field", "target_value")
    now = cut(facts.select("entry_key", "field", "value"))
    front = now
    while True:
        made = front.join(rules, ["field", "value"]).groupBy("entry_key", F.col("target_field").alias("field")).agg(F.min("target_value").alias("value"))
        front = cut(made.join(now, ["entry_key", "field"], "left_anti").select("entry_key", "field", "value"))
        if front.isEmpty():
            return now
        now = cut(now.unionByName(front))


def mapping_conflicts(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Rows whose target is itself a source."""
    return edges.join(edges.select(F.col(source).alias(target)).distinct(), target, "left_semi").select(*edges.columns)
