"""Filters, joins, aggregates, rankings and set operators over entries, roles, groups and names.

Entries are rows (entry_key, field, value); an absent value and '' mean the same.  An
entry is live if it has a type.  No function collects or loops; plans are left to
Catalyst, and small sides are broadcast by its own size estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.normalise import ISBN

TYPE = "entrytype"
#: Rows of one value that meet in one cell of pairs(), on either side and on average; larger groups are dealt over several.
BLOCK = 4096
#: Blocks of a value beyond which these become larger, up to LARGEST times BLOCK rows, so that the copies of a row don't grow with its group.
MOST, LARGEST = 16, 8
#: Keys of a block that are looked at to see where the blocks of a value begin.
BOUND = 16
#: Blocks whose keys that a row isn't paired with reach it as one list.
SPAN = 64


# --- filters and predicates


def live_keys(entries: DataFrame) -> DataFrame:
    """Keys of the entries that have a type."""
    return entries.filter((F.col("field") == TYPE) & (F.col("value") != "")).select("entry_key")


def live(entries: DataFrame) -> DataFrame:
    return entries.join(live_keys(entries), "entry_key", "left_semi")


def find_by_field(entries: DataFrame, field: str, part: str | None = None) -> DataFrame:
    """Entries that have a field, and with part those whose value contains it, ignoring case.  No character is a wildcard."""
    rows = entries.filter(F.col("field") == field)
    return rows if part is None else rows.filter(F.contains(F.lower("value"), F.lower(F.lit(part))))


def find_by_group(groups: DataFrame, name: str, ignore_case: bool = True) -> DataFrame:
    value, wanted = (F.lower("group_name"), name.lower()) if ignore_case else (F.col("group_name"), name)
    return groups.filter(value == wanted)


def find_by_glob(groups: DataFrame, pattern: str) -> DataFrame:
    """Groups whose whole name matches: * and ? stand for characters other than /, [...] for one of a class."""
    return groups.filter(F.col("group_name").rlike(glob(pattern)))


def glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c in "*?":
            out += "[^/]" + ("*" if c == "*" else "")
        else:
            out += "\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c
        i += 1
    return rf"\A{out}\z"


def lookup(entries: DataFrame, keys: DataFrame, field: str) -> DataFrame:
    """The value of one field for every key, '' where it's absent."""
    values = entries.filter(F.col("field") == field).select("entry_key", "value")
    return keys.join(values, "entry_key", "left").select("entry_key", F.coalesce("value", F.lit("")).alias("value"))


def records(entries: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each entry, a column for each field, '' where it's absent: one shuffle, no joins."""
    picked = entries.filter(F.col("field").isin(fields))
    return picked.groupBy("entry_key").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit("")).alias(f) for f in fields])


def illegal_fields(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """entry_key, type, field of fields that allowed (type, field) doesn't have for the entry's type."""
    kinds = entries.filter(F.col("field") == TYPE).select("entry_key", F.col("value").alias("type"))
    rows = entries.filter(F.col("field") != TYPE).join(kinds, "entry_key")
    return rows.join(allowed, ["type", "field"], "left_anti").select("entry_key", "type", "field")


def missing_fields(entries: DataFrame, required: DataFrame) -> DataFrame:
    """entry_key, type, field of required (type, field) that are absent or empty."""
    kinds = entries.filter(F.col("field") == TYPE).select("entry_key", F.col("value").alias("type"))
    there = entries.filter(F.col("value") != "").select("entry_key", "field")
    return kinds.join(required, "type").join(there, ["entry_key", "field"], "left_anti").select("entry_key", "type", "field")


def is_issn(x: Column) -> Column:
    return x.rlike(r"\A[0-9]{4}-[0-9]{3}[0-9,X]\z")


def is_isbn(x: Column) -> Column:
    return x.rlike(ISBN)


def is_year(x: Column) -> Column:
    return x.rlike(r"\A[0-9]{4}\z")


def is_date(x: Column) -> Column:
    """The shape alone; no calendar."""
    return x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")


def is_orcid(x: Column) -> Column:
    """Four groups of four digits, the last may end in X; no checksum."""
    return x.rlike(r"\A[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]\z")


def is_chapter(x: Column) -> Column:
    """Digits, or a Roman numeral below 5000 in either case."""
    return (x != "") & x.rlike(r"(?i)\A(?:[0-9]+|M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\z")


def redundant_url(url: Column, doi: Column) -> Column:
    return (doi != "") & (F.lower(url) == F.lower(F.concat(F.lit("https://doi.org/"), doi)))


def evidently_unequal(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a != b)


def within_years(a: Column, b: Column, window: int = 3) -> Column:
    """Years less than window apart; true unless both are whole numbers."""
    number = lambda x: F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("int"))
    return F.coalesce(F.abs(number(a) - number(b)) < window, F.lit(True))


def different_publications(pairs: DataFrame) -> DataFrame:
    """Adds different: dblp keys differ, or dois differ ignoring case, or two books' volumes differ.

    pairs has columns a_<x> and b_<x> for x in dblp, doi, volume and book (boolean).
    """
    doi = evidently_unequal(F.lower("a_doi"), F.lower("b_doi"))
    volume = F.col("a_book") & F.col("b_book") & evidently_unequal(F.col("a_volume"), F.col("b_volume"))
    return pairs.withColumn("different", evidently_unequal(F.col("a_dblp"), F.col("b_dblp")) | doi | volume)


# --- joins


def _dealt(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Adds _blocks, into how many blocks the rows of one value are dealt, and _own, the row's: by ranges of its key, so that keys ascend from block to block."""
    rows = rows.filter(F.col(by).isNotNull() & F.col(key).isNotNull())
    held = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("_n") / MOST), F.lit(LARGEST * BLOCK)))
    large = rows.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK).select(by, F.ceil(F.col("_n") / held).cast("int").alias("_blocks"))
    # where ranges begin follows from about BOUND keys of a block, chosen by their hash; they decide the blocks' sizes only, and no row is left out
    some = rows.filter(F.pmod(F.xxhash64(key), F.lit(max(BLOCK // BOUND, 1))) == 0).join(F.broadcast(large), by).groupBy(by, "_blocks").agg(F.sort_array(F.collect_list(key)).alias("_some"))
    begins = F.transform(F.sequence(F.lit(1), F.col("_blocks") - 1), lambda k: F.get("_some", F.floor(k * F.size("_some") / F.col("_blocks")).cast("int")))
    # a row for every BLOCK of the input at most
    dealt = rows.join(F.broadcast(large.join(some.select(by, begins.alias("_begins")), by, "left")), by, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.when(F.col("_begins").isNull(), 0).otherwise(F.size(F.filter("_begins", lambda x: x <= F.col(key))))
    return dealt.withColumn("_own", own).drop("_begins")


def pairs(rows: DataFrame, by: str, key: str, without: DataFrame | None = None) -> DataFrame:
    """by, and a_<x> and b_<x> for every other column: each pair of different keys with one value once, a's the smaller, but for those of without (a < b).

    The work grows with the pairs.  It's dealt out by value and pair of blocks: a cell
    holds about BLOCK rows of each side (up to LARGEST times as many of very large groups), so no group stays with one task, and one task holds no group.
    A row of a meets the keys of b's equal rows as one array, and only in cells of a block with itself are keys compared.
    """
    dealt = _dealt(rows, by, key)
    rest = [c for c in rows.columns if c != by]
    n = 16 * rows.sparkSession.sparkContext.defaultParallelism
    cell = [by, "_i", "_j"]
    a = dealt.select(by, *[F.col(c).alias(f"a_{c}") for c in rest], F.col("_own").alias("_i"), "_blocks")
    if without is None:
        a = a.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_blocks") - 1)))
    else:
        a = _with_apart(a, dealt, by, key, without)
    others = [c for c in rest if c != key]
    blocks = dealt.groupBy(by, "_own", *[F.col(c).alias(f"b_{c}") for c in others]).agg(F.collect_list(key).alias("_keys"))
    b = blocks.select(by, F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"), *[f"b_{c}" for c in others], "_keys")
    met = a.drop("_blocks").repartition(n, *cell).join(b.repartition(n, *cell).hint("merge"), cell)
    both = met.withColumn(f"b_{key}", F.explode("_keys")).filter((F.col("_i") < F.col("_j")) | (F.col(f"a_{key}") < F.col(f"b_{key}")))
    if without is not None:
        both = both.filter(F.col("_apart").isNull() | ~F.array_contains("_apart", F.col(f"b_{key}")))
    return both.select(by, *[f"a_{c}" for c in rest], *[f"b_{c}" for c in rest])


def _with_apart(a: DataFrame, dealt: DataFrame, by: str, key: str, without: DataFrame) -> DataFrame:
    """Adds _j, each block that a row meets, and _apart, the keys of that block that it isn't paired with.

    A row finds these keys before it's copied for its blocks, SPAN blocks at a time: what's
    shuffled for them grows with the rows and with without, and a list holds at most SPAN blocks.
    """
    at = lambda x: dealt.select(by, F.col(key).alias(x), F.col("_own").alias(f"_{x}")).distinct()
    met = without.join(at("a").select(by, "a").hint("merge"), "a").join(at("b").hint("merge"), ["b", by])
    lists = met.groupBy(by, F.col("a").alias(f"a_{key}"), F.col("_b").alias("_j")).agg(F.collect_list("b").alias("_list"))
    spans = lists.groupBy(by, f"a_{key}", F.expr(f"_j div {SPAN}").alias("_span")).agg(F.map_from_entries(F.collect_list(F.struct("_j", "_list"))).alias("_lists"))
    a = a.withColumn("_span", F.explode(F.sequence(F.expr(f"_i div {SPAN}"), F.expr(f"(_blocks - 1) div {SPAN}"))))
    a = a.join(spans.hint("merge"), [by, f"a_{key}", "_span"], "left")
    first, last = F.greatest(F.col("_i"), F.col("_span") * SPAN), F.least(F.col("_blocks") - 1, F.col("_span") * SPAN + (SPAN - 1))
    a = a.withColumn("_j", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return a.withColumn("_apart", F.try_element_at("_lists", "_j")).drop("_span", "_lists")


def duplicate_pairs(entries: DataFrame, field: str) -> DataFrame:
    """key_a, key_b, value: live entries that share a value, each pair once.

    The result is as large as the pairs; duplicate_groups() has the same in linear size.
    """
    rows = live(entries).filter((F.col("field") == field) & (F.col("value") != "")).select("entry_key", "value")
    return pairs(rows, "value", "entry_key").select(F.col("a_entry_key").alias("key_a"), F.col("b_entry_key").alias("key_b"), "value")


def name_lists(roles: DataFrame, contributors: DataFrame, glue: str = " and ") -> DataFrame:
    """entry_key, role, names: in order of position."""
    named = roles.join(contributors, F.col("contributor_id") == F.col("id"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
    return named.groupBy("entry_key", "role").agg(ordered.alias("x")).select("entry_key", "role", F.array_join(F.transform("x", lambda y: y["name"]), glue).alias("names"))


def same_names(contributors: DataFrame, known_different: DataFrame) -> DataFrame:
    """id_a, id_b of contributors of one name that aren't recorded as different, in either order."""
    known = known_different.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).filter("id_a <> id_b").distinct()
    found = pairs(contributors.select("id", "name"), "name", "id", known.toDF("a", "b"))
    return found.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), "name")


def spurious_contributors(contributors: DataFrame, names: DataFrame, known_different: DataFrame) -> DataFrame:
    """id_a, id_b: the name of a is an alias (id, name) of b, and they aren't recorded as different."""
    a = contributors.select(F.col("id").alias("id_a"), "name")
    pairs = a.join(names.select(F.col("id").alias("id_b"), "name"), "name").filter("id_a <> id_b")
    known = known_different.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")).distinct()
    return pairs.join(known, (F.least("id_a", "id_b") == F.col("lo")) & (F.greatest("id_a", "id_b") == F.col("hi")), "left_anti").select("id_a", "id_b", "name").distinct()


def coauthors(roles: DataFrame) -> DataFrame:
    """id_a, id_b, shared: entries and roles that two contributors share.

    An entry's contributors pair up among themselves, so the size is bounded by list lengths.
    """
    rows = roles.select("entry_key", "role", "contributor_id").distinct()
    a, b = rows.withColumnRenamed("contributor_id", "id_a"), rows.withColumnRenamed("contributor_id", "id_b")
    return a.join(b, ["entry_key", "role"]).filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.count("*").alias("shared"))


def orphans(anchor: DataFrame, dependent: DataFrame, key: str) -> DataFrame:
    """Rows of dependent whose key anchor doesn't have; null keys are orphans."""
    return dependent.join(anchor.select(key).distinct(), key, "left_anti")


def ghosts(entries: DataFrame, field: str = "dblp") -> DataFrame:
    """entry_key, value, live_siblings: entries with the field that aren't live, and how many live ones share the value."""
    rows = entries.filter((F.col("field") == field) & (F.col("value") != ""))
    keys = live_keys(entries)
    siblings = rows.join(keys, "entry_key", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    return rows.join(keys, "entry_key", "left_anti").join(siblings, "value", "left").select("entry_key", "value", F.coalesce("n", F.lit(0)).alias("live_siblings"))


def inherit(children: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills empty columns of children from their parent's; own values stay."""
    given = parents.select(F.col(key), *[F.col(c).alias(f"_parent_{c}") for c in columns])
    joined = children.join(given, key, "left")
    own = lambda c: F.nullif(F.col(c), F.lit("").cast("string"))
    return joined.select(*[F.coalesce(own(c), F.col(f"_parent_{c}"), F.lit("")).alias(c) if c in columns else F.col(c) for c in children.columns])


# --- aggregates


def duplicate_groups(entries: DataFrame, field: str) -> DataFrame:
    """value, n, keys: values that several live entries share, keys in ascending order."""
    rows = live(entries).filter((F.col("field") == field) & (F.col("value") != ""))
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("entry_key")), "|").alias("keys")).filter("n > 1")


def statistics(entries: DataFrame) -> DataFrame:
    """One row: entries, live entries, fields, distinct fields, and the share of live entries with dblp in hundredths."""
    flag = lambda f: F.max(F.when(F.col("field") == f, 1).otherwise(0))
    per = entries.groupBy("entry_key").agg(F.count("*").alias("n"), flag(TYPE).alias("live"), flag("dblp").alias("dblp"))
    return per.agg(
        F.count("*").alias("entries"), F.sum("live").cast("long").alias("live"), F.sum("n").cast("long").alias("fields"),
        F.round(100.0 * F.sum(F.col("live") * F.col("dblp")) / F.sum("live"), 4).alias("dblp_percent"),
    )


def most_frequent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n: the value that occurs most; ties to the smallest.  One aggregate over pre-aggregated counts, no sort."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("x"))
    return best.select(by, f"x.{value}", "x.n")


def ambiguous(rows: DataFrame, name: str, target: str) -> DataFrame:
    """name, targets: names that stand for several targets."""
    return rows.groupBy(name).agg(F.count_distinct(target).alias("targets")).filter("targets > 1")


def name_map(rows: DataFrame, name: str, target: str) -> DataFrame:
    """name, target: '' where several targets claim the name."""
    least, most = F.min(target), F.max(target)
    return rows.groupBy(name).agg(F.when(least == most, least).otherwise("").alias(target))


# --- rankings


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by aggregation rather than a sorted window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*key, "x.*").select(*rows.columns)


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Adds rank and keeps the first n rows of each key; Spark cuts each partition to n before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def positions(rows: DataFrame, key: str, names: Column) -> DataFrame:
    """key, position (from 1), name for every element of a list."""
    return rows.select(key, F.posexplode(names).alias("p", "name")).select(key, (F.col("p") + 1).cast("long").alias("position"), "name")


def lowest_if_all(rows: DataFrame, group: str, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """group, rule, key: the lowest by the first rule that every candidate of the group has a number for, '' and null if none."""
    return lowest_of(lowest_parts(rows, [group], rules, key), group, rules, key)


def lowest_parts(rows: DataFrame, part: list[str], rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """What lowest_of() needs of the candidates of a part of a group: one row for each part."""
    lowest = [F.min(F.struct(value.alias("value"), F.col(key).alias("k"))).alias(f"_k{i}") for i, (_, value) in enumerate(rules)]
    every = [F.every(value.isNotNull()).alias(f"_a{i}") for i, (_, value) in enumerate(rules)]
    return rows.groupBy(*part).agg(*lowest, *every)


def lowest_of(parts: DataFrame, group: str, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """lowest_if_all() of groups that consist of parts."""
    best = parts.groupBy(group).agg(*[F.min(f"_k{i}").alias(f"_k{i}") for i in range(len(rules))], *[F.every(f"_a{i}").alias(f"_a{i}") for i in range(len(rules))])
    name, found = F.lit(""), F.lit(None)
    for i in reversed(range(len(rules))):
        name = F.when(F.col(f"_a{i}"), rules[i][0]).otherwise(name)
        found = F.when(F.col(f"_a{i}"), F.col(f"_k{i}.k")).otherwise(found)
    return best.select(group, name.alias("rule"), found.alias(key))


def parents_first(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Adds depth: 0 for rows that others name as their parent, 1 for the rest; sort by (depth, key)."""
    named = rows.select(F.col(parent).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_named", F.lit(True))
    return rows.join(named, key, "left").withColumn("depth", F.when(F.col("_named"), 0).otherwise(1)).drop("_named")


# --- sets


def set_relation(a: Column, b: Column) -> Column:
    """equal, subset, superset, disjoint or mixed, of two arrays taken as sets."""
    only_a, only_b = F.size(F.array_except(a, b)) > 0, F.size(F.array_except(b, a)) > 0
    return F.when(~only_a & ~only_b, "equal").when(~only_a, "subset").when(~only_b, "superset").when(F.size(F.array_intersect(a, b)) == 0, "disjoint").otherwise("mixed")


def set_text(x: Column, style: str = "and") -> Column:
    """Sorted and quoted: "a", "b" and "c", or in braces."""
    quoted = F.transform(F.array_sort(F.array_distinct(x)), lambda y: F.concat(F.lit('"'), y, F.lit('"')))
    if style == "braces":
        return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))
    head = F.array_join(F.slice(quoted, F.lit(1), F.greatest(F.size(quoted) - 1, F.lit(0))), ", ")
    return F.when(F.size(quoted) < 2, F.array_join(quoted, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(quoted, -1)))
