"""Small operators that queries are put together from: flags, properties, indexes, multimaps, byte sets, orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_names(entries: DataFrame) -> DataFrame:
    """field: every field that some entry has."""
    return entries.filter("value <> ''").select("field").distinct()


def flagged(flags: DataFrame, key: str, flag: str) -> DataFrame:
    """key of the rows whose flag is set: 1 or true."""
    return flags.filter(F.coalesce(F.col(flag).cast("int") == 1, F.lit(False))).select(key)


def properties(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, property, value: a row for each property that isn't empty; one scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("property"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value")) for n in names])
    return rows.select(key, F.explode(F.filter(pairs, lambda x: x["value"] != "")).alias("x")).select(key, "x.*")


def classes(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """key, class (the smallest key of equal content), size of its class: in place of all pairs.

    Rows without content are their own.  What is shuffled is a digest; a large class is
    aggregated before the shuffle and its rows meet one row of it.
    """
    digest = rows.select(F.col(key).alias("k"), F.when(content != "", F.md5(content)).alias("h"))
    least = digest.filter("h IS NOT NULL").groupBy("h").agg(F.min("k").alias("class"), F.count("*").alias("size"))
    return digest.join(least, "h", "left").select(F.col("k").alias(key), F.coalesce("class", "k").alias("class"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def class_links(classed: DataFrame, key: str) -> DataFrame:
    """key, links: with how many others each row shares its content."""
    return classed.select(key, "class", (F.col("size") - 1).alias("links"))


def key_search(rows: DataFrame, key: str, part: str, most: int | None = None) -> DataFrame:
    """Keys that contain a text, in order; most is for display."""
    found = rows.filter(F.contains(F.col(key), F.lit(part))).select(key)
    return found if most is None else found.orderBy(key).limit(most)


def title_classes(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """kind, id, first: rows (kind, id, index) of both sides with the smallest id of left that has their index; two have a link when these are the same."""
    first = left.filter(F.col(index) != "").groupBy(index).agg(F.min("id").alias("first"))
    return left.unionByName(right).join(first, index, "left").select("kind", "id", "first")


def title_matches(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """id, match: rows of left with the smallest id of right that has their index, as many as left has at most."""
    first = right.filter(F.col(index) != "").groupBy(index).agg(F.min("id").alias("match"))
    return left.join(first, index).select("id", "match")


def children_of(rows: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Rows whose parent is one of parents (one column of that name)."""
    return rows.join(parents.select(parent).distinct(), parent, "left_semi").select(*rows.columns)


def distinct_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n: how many different values each group has."""
    return rows.groupBy(by).agg(F.count_distinct(value).alias("n"))


def pair_counts(rows: DataFrame, one: str, two: str) -> DataFrame:
    """one, two, n."""
    return rows.groupBy(one, two).agg(F.count("*").alias("n"))


def least_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the smallest value, so that every group has one row."""
    return rows.groupBy(*by).agg(F.min(value).alias(value))


def inverted(rows: DataFrame, by: str, key: str, glue: str = ",") -> DataFrame:
    """by, keys: an index from values to their sorted distinct keys, as text."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), glue).alias("keys"))


def digest_groups(rows: DataFrame, content: str) -> DataFrame:
    """md5, n of contents that several rows have."""
    return rows.filter(F.col(content).isNotNull()).groupBy(F.md5(content).alias("md5")).agg(F.count("*").alias("n")).filter("n > 1")


def distinct_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns).distinct()


# --- strings, sets and maps


def mapped(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a non-empty value under their keys (one to three of them)."""
    return rows.join(table.filter(F.coalesce(value, F.lit("")) != "").select(*keys).distinct(), keys, "left_semi").select(*rows.columns)


def map_get(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the value under their keys, '' where there's none."""
    return rows.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(""))).select(*rows.columns, value)


def map_set(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after values were set; changes have one row for each key."""
    return table.join(changes.select(*keys), keys, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def multimap_change(table: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """A multimap, rows of keys and a value, after rows were added and others deleted."""
    return table.unionByName(added.select(*table.columns)).distinct().join(deleted.select(*table.columns).distinct(), table.columns, "left_anti")


def contains_all(elements: Column, wanted: Column) -> Column:
    """True if every wanted element is there."""
    return F.size(F.array_except(wanted, elements)) == 0


def byte_set(x: Column) -> Column:
    """The distinct bytes of a text as four longs of 64 bits; unite, intersect and subtract them with byte_algebra()."""
    bytes_ = F.transform(F.regexp_extract_all(F.hex(F.encode(F.coalesce(x, F.lit("")), "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    word = lambda w: F.aggregate(F.filter(bytes_, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))
    return F.array(*[word(w) for w in range(4)])


def byte_algebra(a: Column, b: Column) -> dict[str, Column]:
    """united, common, only_a (byte sets), equal and within (booleans)."""
    each = lambda f: F.zip_with(a, b, f)
    only = each(lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    return {"united": each(lambda x, y: x.bitwiseOR(y)), "common": each(lambda x, y: x.bitwiseAND(y)), "only_a": only, "equal": a == b, "within": F.forall(only, lambda x: x == 0)}


def byte_count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


#: In which order files are synchronised; fixed values.
MODES = ["full", "subset", "harvest"]


def by_mode(files: DataFrame, mode: str = "mode", order: str = "pos") -> DataFrame:
    """Adds turn: full files first, then subsets, then harvested ones, then others; files of one mode keep their order."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MODES)), F.col(mode)), F.lit(0)), F.lit(len(MODES) + 1))
    least = files.groupBy(place.alias("_place")).agg(F.count("*").alias("_n"))  # a row for each mode
    before = least.withColumn("_before", F.sum("_n").over(Window.orderBy("_place")) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_place").orderBy(order))
    return files.withColumn("_place", place).join(F.broadcast(before), "_place").withColumn("turn", (F.col("_before") + rank).cast("long")).drop("_place", "_n", "_before")


def ambiguous_assignments(choices: DataFrame) -> DataFrame:
    """name, times, chosen of (name, id, at): how often a name that several people have was assigned, and to whom first."""
    return choices.groupBy("name").agg(F.count("*").alias("times"), F.min_by("id", "at").alias("chosen"), F.count_distinct("id").alias("ids")).filter("ids > 1").drop("ids")


def group_aliases(groups: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """entry_key, alias of a group's entries, in both orders."""
    return groups.filter(F.col("group_name") == name).select("entry_key").join(aliases.select(F.col("canonical").alias("entry_key"), "alias"), "entry_key")
